"""Queries and oracles of the corpus operators."""

from __future__ import annotations

from specloom.llm import decontamination, html_extract, licenses, lines, mixing, ngram_join, pii, quality, sharding, spans

MODULES = (decontamination, html_extract, ngram_join, pii, quality, mixing, sharding, spans, licenses, lines, pii)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
