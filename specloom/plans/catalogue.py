"""Every named query with its DuckDB counterpart, gathered from the plan modules."""

from __future__ import annotations

from specloom.plans import artifacts, diff, graph, rdf, text

MODULES = (text, graph, diff, rdf, artifacts)
QUERIES: dict = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
