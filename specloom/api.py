"""Questions to a stored graph (F9-F13, C4, C6-C10, D9): each is a small query over cached tables."""

from __future__ import annotations

import json
from os import PathLike
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.graph import Graph
from specloom.operators import diff
from specloom.sinks.documents import changelog_document, sparse
from specloom.sources import metadata, registry


def entity(graph: Graph, name: str) -> DataFrame:
    """F12."""
    return graph.entity.where(F.col("name") == name)


def relationships_for(graph: Graph, name: str) -> DataFrame:
    """edges that an entity is at either end of."""
    return graph.relationship.where("scope = 'inferred'").where((F.col("source") == name) | (F.col("target") == name))


def rules_for(graph: Graph, name: str) -> DataFrame:
    """rules that name an entity."""
    return graph.rule.where(F.array_contains("referenced_entities", name))


def rules_by_phase(graph: Graph, phase: str | None = None) -> DataFrame:
    """rules of a phase, or all."""
    return graph.rule if phase is None else graph.rule.where(F.col("phase") == phase)


def search(table: DataFrame, query: str, *columns: str) -> DataFrame:
    """rows with the query in a column, in any case, as plain text."""
    hit = F.lit(False)
    for c in columns or ("name", "description"):
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(query)))
    return table.where(hit)


def changelog(old: Graph, new: Graph) -> DataFrame:
    """Changes of entities, rules and enumerations between two versions."""
    entities = diff.diff_entities(old.entity, new.entity, old.property, new.property)
    enums = diff.diff_enums(old.enum_type.select("name", "values"), new.enum_type.select("name", "values"))
    rule = lambda g: g.rule.select("rule_id", "severity", "phase", "description")
    return entities.unionByName(diff.diff_rules(rule(old), rule(new))).unionByName(enums)


class Catalog:
    """Stored versions under a folder; each is read once and kept."""

    def __init__(self, spark: SparkSession, folder: str | PathLike) -> None:
        self.spark, self.folder, self._loaded = spark, Path(folder), {}

    def graph(self, version: str) -> Graph:
        """S7."""
        if version not in self._loaded:
            self._loaded[version] = metadata.load(self.spark, self.folder, version).cut()
        return self._loaded[version]

    def versions(self) -> list[dict]:
        """C6."""
        return [v._asdict() for v in registry.list_versions()]

    def entities(self, version: str) -> dict[str, Any]:
        """C6."""
        return {"version": version, "entities": [r.name for r in self.graph(version).entity.orderBy("ord").collect()]}

    def _entity(self, version: str, name: str) -> dict[str, Any] | None:
        g = self.graph(version)
        found = entity(g, name).collect()
        if not found:
            return None
        props = [sparse("property", r.asDict()) for r in g.property.where(F.col("entity") == name).orderBy("ord").collect()]
        edges = [sparse("relationship", r.asDict()) for r in g.relationship.where("scope = 'parser'").where(F.col("source") == name).orderBy("ord").collect()]
        return {"version": version, "entity": sparse("entity", found[0].asDict() | {"properties": props, "relationships": edges})}

    def entity(self, version: str, name: str) -> dict[str, Any]:
        """KeyError for an unknown one."""
        if (found := self._entity(version, name)) is None:
            raise KeyError(f"version {version!r} has no entity {name!r}, but {self.entities(version)['entities']}")
        return found

    def query_entity(self, version: str, name: str) -> dict[str, Any]:
        """An error document for an unknown one."""
        return self._entity(version, name) or {"error": f"version {version!r} has no entity {name!r}", "available_entities": sorted(self.entities(version)["entities"])}

    def query_rules(self, version: str, phase: str | None = None) -> dict[str, Any]:
        """C8."""
        rows = rules_by_phase(self.graph(version), phase).orderBy("ord").collect()
        return dict(version=version, phase=phase, rules=[sparse("rule", r.asDict()) for r in rows])

    def search(self, version: str, query: str) -> dict[str, Any]:
        """C10."""
        rows = search(self.graph(version).entity, query).orderBy("ord").collect()
        return dict(version=version, query=query, count=len(rows), results=[{"name": r.name, "description": r.description} for r in rows])

    def diff(self, old: str, new: str, full: bool = False) -> dict[str, Any]:
        """C4: the changelog."""
        return changelog_document(changelog(self.graph(old), self.graph(new)), old, new, full)

    def diff_versions(self, old: str, new: str) -> dict[str, Any]:
        """Names of entities and rules that are new, gone or different; no renames."""

        def whole(g: Graph) -> DataFrame:
            props = g.property.groupBy(F.col("entity").alias("name")).agg(F.sort_array(F.collect_list(F.struct(*[c for c in g.property.columns if c not in ("version", "entity", "source")]))).alias("props"))
            edges = g.relationship.where("scope = 'parser'").groupBy(F.col("source").alias("name")).agg(F.sort_array(F.collect_list(F.struct("ord", F.col("name").alias("edge"), "target", "type", "cardinality", "description"))).alias("edges"))
            # places of rows matter inside an entity only
            flat = lambda c: F.transform(c, lambda x: x.dropFields("ord"))
            return g.entity.select("name", "description", "parent", "aliases", "deprecated", "spec_section").join(props, "name", "left").join(edges, "name", "left").withColumns({"props": flat(F.col("props")), "edges": flat(F.col("edges"))})

        a, b = self.graph(old), self.graph(new)
        by: dict[str, list[str]] = {"added": [], "removed": [], "modified": []}
        for r in diff.diff_shallow(whole(a), whole(b), "name").orderBy("name").collect():
            by[r.change].append(r.name)
        ids = diff.diff_shallow(a.rule.select("rule_id"), b.rule.select("rule_id"), "rule_id").orderBy("rule_id").collect()
        rules = {c: [r.rule_id for r in ids if r.change == c] for c in ("added", "removed")}
        counts = {f"entities_{c}": len(x) for c, x in by.items()} | {f"rules_{c}": len(x) for c, x in rules.items()}
        return {"from_version": old, "to_version": new, "entities": by, "rules": rules, "summary": counts}


def dumps(document: Any) -> str:
    return json.dumps(document, indent=2)
