"""K1-K7: the graph of a version as documents. Spark groups and orders; the driver lays out one version's text."""

from __future__ import annotations

import json
from os import PathLike
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.graph import Graph
from specloom.operators import rdf
from specloom.schemas import CHANGES

#: Fields of every kind of row in documents, and those that are left out when empty.
FIELDS = {
    "property": (("name", "type", "required", "cardinality"), ("description", "enum_values", "reference_target", "array_item_type", "pattern", "deprecated")),
    "entity": (("name", "properties", "relationships"), ("description", "parent", "aliases", "deprecated", "spec_section")),
    "relationship": (("name", "source", "target", "type", "cardinality"), ("description",)),
    "rule": (("rule_id", "description", "severity", "phase", "condition", "action", "referenced_entities", "spec_section", "source_text"), ()),
    "enum_type": (("name", "values", "extensible"), ("description",)),
    "type_alias": (("name", "base_type"), ("cddl_name", "description", "external")),
    "status_code": (("code", "meaning", "url_usage", "category"), ()),
    "spec_version": (("version", "date", "commit_hash", "tag"), ()),
    "change": (("entity", "change"), ("details", "old_value", "new_value")),
}


def sparse(kind: str, row: dict[str, Any]) -> dict[str, Any]:
    """K7: a row as a document, without empty optional fields."""
    always, optional = FIELDS[kind]
    return {k: row[k] for k in always} | {k: row[k] for k in optional if row.get(k)}


def write_json(document: Any, path: str | PathLike) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(document, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def _rows(t: DataFrame, *order: str) -> list[dict]:
    return [r.asDict(recursive=True) for r in t.orderBy(*order).collect()]  # of one version


def metadata(graph: Graph) -> dict[str, Any]:
    """K1: everything of one version, with counts."""
    props: dict[str, list] = {}
    for p in _rows(graph.property, "entity", "ord"):
        props.setdefault(p["entity"], []).append(sparse("property", p))
    own: dict[str, list] = {}
    for e in _rows(graph.relationship.where("scope = 'parser'"), "source", "ord"):
        own.setdefault(e["source"], []).append(sparse("relationship", e))
    keyed = lambda t, kind: {r["name"]: sparse(kind, r) for r in _rows(t, "ord")}
    listed = lambda t, kind: [sparse(kind, r) for r in _rows(t, "ord")]
    versions = _rows(graph.spec_version, "ord")
    conventions = _rows(graph.convention, "version")
    doc: dict[str, Any] = {
        "version": sparse("spec_version", versions[0]) if versions else {},
        "entities": {e["name"]: sparse("entity", e | {"properties": props.get(e["name"], []), "relationships": own.get(e["name"], [])}) for e in _rows(graph.entity, "ord")},
        "relationships": listed(graph.relationship.where("scope = 'inferred'"), "relationship"), "validation_rules": listed(graph.rule, "rule"),
        "enum_types": keyed(graph.enum_type, "enum_type"), "type_aliases": keyed(graph.type_alias, "type_alias"),
        "spec_conventions": json.loads(conventions[0]["document"]) if conventions else {}, "status_codes": listed(graph.status_code, "status_code"),
    }
    names = {"entities": "entity", "relationships": "relationship", "validation_rules": "rule", "enum_types": "enum", "type_aliases": "type_alias", "status_codes": "status_code"}
    return doc | {"stats": {f"{one}_count": len(doc[many]) for many, one in names.items()}}


def context(graph: Graph, base: str = rdf.BASE) -> dict[str, Any]:
    """K3: JSON-LD context."""
    terms: dict[str, Any] = {}
    for t in _rows(rdf.context_terms(graph.entity, graph.property, graph.enum_type, base), "ord"):
        plain = t["ord"]["section"] == 0
        terms[t["term"]] = t["id"] if plain else {"@id": t["id"]} | ({"@type": t["type"]} if t["type"] else {}) | ({"@container": t["container"]} if t["container"] else {})
    return {"@context": terms}


def rules_document(graph: Graph) -> dict[str, Any]:
    """K4: rules by phase and status codes by category, with counts."""
    version = [r["version"] for r in graph.spec_version.collect()]
    counts = [r.asDict() for r in rdf.rule_counts(graph.rule).collect()]
    total = sum(c["n"] for c in counts if c["phase"] is None and c["severity"] is None)
    rules = {g["phase"]: [{k: v for k, v in r.items() if k not in ("s", "ord") and v is not None} for r in g["rules"]] for g in _rows(rdf.rules_by_phase(graph.rule), "phase_ord")}
    codes = {g["category"]: [{k: v for k, v in c.items() if k != "ord" and v is not None} for c in g["codes"]] for g in _rows(rdf.codes_by_category(graph.status_code), "category_ord")}
    return {
        "version": version[0] if version else "", "rule_count": total,
        "summary": {"total": total, "by_phase": {c["phase"]: c["n"] for c in counts if c["phase"] is not None}, "by_severity": {c["severity"]: c["n"] for c in counts if c["severity"] is not None}},
        "phases": rules, "status_codes": codes,
    }


def triples(graph: Graph) -> DataFrame:
    """All triples of one version, each once."""
    parts = [
        rdf.ontology_triples(graph.spec_version), rdf.entity_triples(graph.entity), rdf.property_triples(graph.property), rdf.restriction_triples(graph.property),
        rdf.enum_triples(graph.enum_type), rdf.relationship_triples(graph.relationship),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def turtle_lines(rows: DataFrame) -> DataFrame:
    """K2: a statement for every subject, ``subject`` and ``line``; predicates and objects in order."""
    quoted = F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("o"), r"\\", r"\\\\"), '"', r'\\"'), "\n", r"\\n"), F.lit('"'))
    tag = F.when(F.col("o_lang") != "", F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype") != "", F.concat(F.lit("^^"), "o_datatype")).otherwise("")
    # prefixed names with characters that Turtle escapes are written in full
    name = lambda c: F.when(c.rlike(r"^(_:|[a-z]+:[A-Za-z0-9_.-]*[A-Za-z0-9_-]$|[a-z]+:$)"), c).otherwise(F.concat(F.lit("<"), F.regexp_replace(c, "^spec:", rdf.BASE), F.lit(">")))
    obj = F.when(F.col("o_kind") == "literal", F.concat(quoted, tag)).otherwise(name(F.col("o")))
    verb = F.when(F.col("p") == "rdf:type", "a").otherwise(F.col("p"))
    by = rows.groupBy("s", verb.alias("verb")).agg(F.array_join(F.sort_array(F.collect_list(obj)), ", ").alias("objects"))
    return by.groupBy("s").agg(F.array_join(F.sort_array(F.collect_list(F.concat("verb", F.lit(" "), "objects"))), " ;\n    ").alias("said")).select(
        F.col("s").alias("subject"), F.concat(name(F.col("s")), F.lit(" "), "said", F.lit(" .")).alias("line"))


def write_turtle(graph: Graph, path: str | Path) -> None:
    """K2: one Turtle file of one version."""
    head = "".join(f"@prefix {k}: <{v}> .\n" for k, v in rdf.PREFIXES.items())
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open(mode="w", encoding="utf-8") as f:
        f.write(head + "\n")
        for r in turtle_lines(triples(graph)).orderBy("subject").toLocalIterator():
            f.write(r.line + "\n\n")


def changelog_document(changes: DataFrame, old: str, new: str, full: bool = True) -> dict[str, Any]:
    """K5: changes of every kind in order, with counts; ``full`` adds the total and entities by type of change."""
    order = F.col("ord"), F.when(F.col("kind") == "entity", F.when(F.col("change") == "renamed", F.col("old_value")).otherwise(F.col("entity"))).otherwise(F.col("entity"))
    rows = [r.asDict() for r in changes.orderBy(*order).collect()]
    doc: dict[str, Any] = {"from_version": old, "to_version": new}
    doc |= {f"{k}_changes": [sparse("change", r) for r in rows if r["kind"] == k] for k in ("entity", "rule", "enum")}
    doc["summary"] = {f"{k}_changes": len(doc[f"{k}_changes"]) for k in ("entity", "rule", "enum")}
    if full:
        doc["summary"]["total_changes"] = len(rows)
        by = {c: [r for r in doc["entity_changes"] if r["change"] == c] for c in CHANGES}
        doc["entity_changes_by_type"] = {c: r for c, r in by.items() if r}
    return doc


ARTIFACTS = {"metadata": "metadata.json", "ontology": "ontology.ttl", "context": "context.jsonld", "validation_rules": "validation-rules.json", "predicates": "predicates.json"}


def write_pointer(version: str, folder: str | Path, address: str = "") -> None:
    """K6: which version is there, and where its documents are."""
    paths = {k: f"versions/{version}/{f}" for k, f in ARTIFACTS.items()}
    write_json({"spec_version": version, "artifacts": paths, "urls": {k: f"{address}{p}" for k, p in paths.items()}}, Path(folder, "spec-version.json"))


def write_all(graph: Graph, version: str, folder: str | Path) -> list[Path]:
    """All documents of a version, in its folder."""
    at = Path(folder, version)
    g = graph.of(version).cut()
    write_turtle(g, at / ARTIFACTS["ontology"])
    write_json(context(g), at / ARTIFACTS["context"])
    write_json(rules_document(g), at / ARTIFACTS["validation_rules"])
    write_json(metadata(g), at / ARTIFACTS["metadata"])
    return [at / ARTIFACTS[k] for k in ("ontology", "context", "validation_rules", "metadata")]
