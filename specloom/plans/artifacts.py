"""Queries that parse source files made of tables, and lay out the documents of a graph."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import api
from specloom.graph import Graph
from specloom.operators import diff, rdf
from specloom.sinks import documents
from specloom.sources import cddl, json_schema, metadata
from specloom.session import table

def _version() -> Column:
    return F.lit("1.0").alias("version")


def _text(s: str) -> Column:
    """A template: ``<column>`` is the column's value."""
    out = []
    for i, part in enumerate(s.replace(">", "<").split("<")):
        if part:
            out.append(F.col(part).cast("string") if i % 2 else F.lit(part))
    return F.concat(*out)


def _by_kind(k: Column, texts: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[_text(t) for t in texts]), (k % len(texts) + 1).cast("int"))


#: A file has the fields of so many keys at most, so that no text grows with the table: a larger one is more files.
PER_FILE = 1000


def _file(k: Column) -> Column:
    """Number of the file that a part's field is in."""
    return F.floor(k / PER_FILE).alias("nr")


#: CDDL of a field, what it parses to (type, required, cardinality, reference, item, pattern, least length).
_CDDL = (
    ('"f<k>": tstr', "string", True, "1", "", "", "", None), ('? "f<k>": uint', "integer", False, "0..1", "", "", "", None), ('"f<k>": [* other-map]', "array", True, "0..*", "", "OtherMap", "", None),
    ('"f<k>": [1* tstr]', "array", True, "1..*", "", "string", "", None), ('? "f<k>": [1* int]', "array", False, "0..*", "", "integer", "", None), ('"f<k>": other-map', "reference", True, "1", "OtherMap", "", "", None),
    ('? "f<k>": bool / $last-map', "union", False, "0..1", "LastMap", "", "", None), ('"f<k>": tstr .size (3..20)', "string", True, "1", "", "", "", 3), ('"f<k>": tstr .regexp "^a+b"', "string", True, "1", "", "", "^a+b", None),
    ('"f<k>": bstr', "bytes", True, "1", "", "", "", None),
)


def _cddl_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of maps, one a brand, with a field for each part, small and large ones in other files; every fourth field is deprecated."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    about = F.when(F.col("k") % 4 == 0, F.concat(F.lit("(deprecated) "), "p_type")).otherwise(F.col("p_type"))
    line = F.concat(F.lit("  "), _by_kind(F.col("k"), tuple(c[0] for c in _CDDL)), F.lit(", ; "), about)
    part = _file(F.col("k")) * 2 + F.when(F.col("p_size") <= 25, 1).otherwise(2)
    maps = p.groupBy(part.alias("part"), "p_brand").agg(F.sort_array(F.collect_list(F.struct("k", line.alias("l"))))["l"].alias("ls"))
    one = F.concat(F.lit("; All of "), "p_brand", F.lit("\n"), F.translate("p_brand", "#", "-"), F.lit("-map = {\n  common-map,\n"), F.array_join("ls", "\n"), F.lit("\n  * tstr => any\n}\n"))
    files = maps.groupBy("part").agg(F.array_join(F.sort_array(F.collect_list(one)), "\n").alias("text"))
    return files.select(_version(), "part", F.concat(F.lit("file"), F.col("part").cast("string")).alias("file"), "text")


def _cddl_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return cddl.tables(_cddl_files(spark, sf_dir), compat=False)


def cddl_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps of all files, by name."""
    return _cddl_tables(spark, sf_dir)["entity"].select("name", "description", F.array_join("aliases", ",").alias("aliases"), "deprecated")


def cddl_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their fields."""
    return _cddl_tables(spark, sf_dir)["property"].select("entity", "name", "type", "description", "required", "cardinality", "reference_target", "array_item_type", "pattern", "min_length", "deprecated")


def cddl_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What they refer to and include."""
    return _cddl_tables(spark, sf_dir)["relationship"].select("source", "name", "target", "type", "cardinality")


_SCHEMAS = (
    ('{"type": "string", "description": "<p_type>", "pattern": "^<k>$"}', "string", "", "", False), ('{"type": "integer"}', "integer", "", "", False), ('{"$ref": "#/definitions/Other"}', "reference", "Other", "", False),
    ('{"oneOf": [{"type": "null"}, {"$ref": "#/definitions/Last"}]}', "union", "Last", "", False), ('{"enum": ["a", "b"]}', "enum", "", "", False), ('{"type": "array", "items": {"$ref": "#/definitions/Item"}}', "array", "", "Item", True),
    ('{"type": "string", "format": "date-time"}', "datetime", "", "", False), ('{"type": ["string", "null"]}', "any", "", "", False), ('{"type": "array", "items": {"type": "number"}}', "array", "", "float", True), ('{"type": "object"}', "map", "", "", False),
)


def _json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with a root, a definition of alternatives alone and one that is no object; and files of definitions, each of some parts' brands with a property for every part."""
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    made = p.select("p_brand", "k", _file(F.col("k")), F.concat(F.lit('"f'), F.col("k").cast("string"), F.lit('": '), _by_kind(F.col("k"), tuple(s[0] for s in _SCHEMAS))).alias("s"))
    name = F.concat(F.lit('"f'), F.col("k").cast("string"), F.lit('"'))
    defs = made.groupBy("nr", "p_brand").agg(F.sort_array(F.collect_list(F.struct("k", "s")))["s"].alias("s"), F.collect_list(F.when(F.col("k") % 3 == 0, name)).alias("r"))
    one = F.concat(F.lit('"'), F.translate("p_brand", "#", ""), F.lit('": {"type": "object", "properties": {'), F.array_join("s", ", "), F.lit('}, "required": ['), F.array_join("r", ", "), F.lit("]}"))
    files = defs.groupBy("nr").agg(F.array_join(F.sort_array(F.collect_list(one)), ", ").alias("d")).select(
        _version(), F.concat(F.lit("s"), F.col("nr").cast("string"), F.lit(".json")).alias("file"), F.concat(F.lit('{"definitions": {'), "d", F.lit("}}")).alias("text"))
    doc = spark.range(1).select(
        _version(), F.lit("s.json").alias("file"),
        F.lit('{"title": "The Doc", "type": "object", "properties": {"top": {"$ref": "#/definitions/Either"}}, "definitions": {"Either": {"anyOf": [{"$ref": "#/definitions/Brand11"}, {"$ref": "#/x/Other"}]}, "Plain": {"type": "string"}}}').alias("text"))
    return doc.unionByName(files)


def _json_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return json_schema.tables(_json_files(spark, sf_dir))


def json_schema_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of its definitions."""
    return _json_tables(spark, sf_dir)["property"].select("entity", "name", "type", "description", "required", "cardinality", F.array_join("enum_values", ",").alias("enum_values"), "reference_target", "array_item_type", "pattern")


def json_schema_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What they refer to."""
    return _json_tables(spark, sf_dir)["relationship"].select("source", "name", "target", "type", "cardinality")


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Nations as entities with their suppliers as properties, rules, enumerations and codes."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    k, empty = F.col("n_nationkey"), F.array().cast("array<string>")
    entity = n.select(_version(), k.cast("bigint").alias("ord"), F.col("n_name").alias("name"), F.when(k % 2 == 0, F.concat(F.lit('The "'), "n_name", F.lit('"'))).otherwise("").alias("description"), F.array(F.lower("n_name")).alias("aliases"), (k % 5 == 0).alias("deprecated"),
                      F.lit("").alias("parent"), F.lit("").alias("source"), F.lit("").alias("spec_section"))
    own = s.join(n, F.col("s_nationkey") == k)
    key = F.col("s_suppkey")
    prop = own.select(
        _version(), F.col("n_name").alias("entity"), key.alias("ord"), F.concat(F.lit("p-"), key.cast("string")).alias("name"), F.when(key % 3 == 0, "reference").when(key % 3 == 1, "array").otherwise("string").alias("type"), F.lit("").alias("description"),
        (key % 2 == 0).alias("required"), F.lit("1").alias("cardinality"), F.when(key % 4 == 0, F.array(F.lit("x"), F.lit("y"))).otherwise(empty).alias("enum_values"), F.when(key % 3 == 0, "T").otherwise("").alias("reference_target"), F.lit("").alias("array_item_type"),
        F.lit("").alias("pattern"), F.lit(None).cast("int").alias("min_length"), F.lit(None).cast("int").alias("max_length"), F.lit(False).alias("deprecated"), F.lit("").alias("source"))
    rule = own.select(
        _version(), key.alias("ord"), F.concat(F.lit("R"), key.cast("string")).alias("rule_id"), F.col("s_name").alias("description"), F.when(key % 2 == 0, "must").otherwise("may").alias("severity"), F.when(key % 3 == 0, "trust").otherwise("content").alias("phase"),
        F.lit("").alias("condition"), F.lit("").alias("action"), F.array("n_name").alias("referenced_entities"), F.lit("s").alias("spec_section"), F.lit("").alias("source_text"))
    enum = table(spark, sf_dir, "region").select(_version(), F.col("r_regionkey").cast("bigint").alias("ord"), F.col("r_name").alias("name"), F.array(F.lower("r_name"), F.lit("z")).alias("values"), (F.col("r_regionkey") % 2 == 0).alias("extensible"), F.lit("").alias("description"), F.lit("").alias("source"))
    code = n.select(_version(), k.cast("bigint").alias("ord"), F.concat(F.lit("c."), k.cast("string")).alias("code"), F.lit("m").alias("meaning"), F.lit("u").alias("url_usage"), F.when(k % 2 == 0, "success").otherwise("failure").alias("category"))
    version = spark.createDataFrame([("1.0", "2026-01-01", "", "t", 0)], "version string, date string, commit_hash string, tag string, ord int")
    return replace(Graph.empty(spark), entity=entity, property=prop, rule=rule, enum_type=enum, status_code=code, spec_version=version)


def _leaves(value, path: tuple[str, ...] = ()):
    """Paths and values of a document's leaves."""
    items = value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else None
    if items is None:
        yield "/".join(path), json.dumps(value).strip('"')
        return
    for k, v in items:
        yield from _leaves(v, (*path, str(k)))


def _rows(spark: SparkSession, document: dict) -> DataFrame:
    return spark.createDataFrame(list(_leaves(document)), "path string, value string")


def metadata_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of a graph, read again as tables: properties, empty fields left out in between."""
    text = json.dumps(documents.metadata(_graph(spark, sf_dir)))
    d = spark.createDataFrame([(text,)], "value string").select(F.from_json("value", metadata.SCHEMA).alias("d"))
    p = metadata.graph_of(d.select("d.*")).property
    return p.select("version", "entity", "name", "type", "required", "cardinality", F.array_join("enum_values", ",").alias("enum_values"), "reference_target", "deprecated")


def metadata_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1, A1: counts in the document of a graph."""
    return _rows(spark, documents.metadata(_graph(spark, sf_dir))["stats"])


def turtle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: statements of entities."""
    return documents.turtle_lines(rdf.entity_triples(_graph(spark, sf_dir).entity))


def context_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: leaves of the JSON-LD context."""
    return _rows(spark, documents.context(_graph(spark, sf_dir)))


def rules_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: leaves of the rules document."""
    return _rows(spark, documents.rules_document(_graph(spark, sf_dir)))


def _unlike(k: Column) -> Column:
    """A name that shares no character with others, whatever the key: digits would make those of long keys alike."""
    return F.concat(F.lit("zq"), F.translate(k.cast("string"), "0123456789", "bcdfghjklt"))


def rename_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers under a new name, known by an alias or by members and likeness of names."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    k = F.col("k")
    item = lambda *xs: F.array(*[F.concat(F.lit(x), k.cast("string")) for x in xs])
    name = F.concat(F.lit("S"), k.cast("string"), F.lit("Map"))
    old = s.select(name.alias("name"), F.array(F.concat(F.lit("supplier-"), k.cast("string"))).alias("aliases"), item("a", "b", "c", "d", "e").alias("items"))
    new = s.select(
        F.when(k % 3 == 0, F.concat(F.lit("Renamed"), k.cast("string"))).when(k % 15 == 1, _unlike(k)).when(k % 3 == 1, F.concat(name, F.lit("V2"))).otherwise(name).alias("name"),
        F.array(F.when(k % 3 == 0, F.concat(F.lit("Supplier_"), k.cast("string"))).otherwise(F.concat(F.lit("x-"), k.cast("string")))).alias("aliases"), item("a", "b", "c", "d").alias("items"))
    return diff.rename_entities(old, new)


def rename_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as properties of their brands; one of the same signature and a like name is the same one."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    row = lambda name, kind: p.select(
        F.col("p_brand").alias("entity"), name.alias("name"), kind.alias("type"), (k % 2 == 0).alias("required"), F.lit("1").alias("cardinality"), F.concat(F.lit("t"), k.cast("string")).alias("reference_target"), F.lit("").alias("array_item_type"), F.lit(False).alias("deprecated"))
    name = F.concat(F.lit("prop"), k.cast("string"))
    new = row(F.when(k % 10 == 4, _unlike(k)).when(k % 2 == 0, F.concat(name, F.lit("_x"))).otherwise(name), F.when(k % 6 == 0, "integer").otherwise("string"))
    return diff.rename_properties(diff.outer(row(name, F.lit("string")), new, ["entity", "name"]))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[Graph, Graph]:
    """Suppliers before and after: renamed, like, gone, new, changed and deprecated ones; rules and enumerations too."""
    s, n, r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("k")
    text = lambda x: F.concat(F.lit(x), k.cast("string"))
    name = F.concat(text("S"), F.lit("Map"))
    later = F.when(k % 6 == 0, text("R")).when(k % 6 == 1, F.concat(name, F.lit("V2"))).otherwise(name)

    def version(new: bool) -> Graph:
        own = s.where(k % 6 != (2 if new else 3))
        called = later if new else name
        entity = own.select(called.alias("name"), F.array(text("alias-") if not new else F.when(k % 6 == 0, text("ALIAS_")).otherwise(text("other-"))).alias("aliases"), ((k % 6 == 5) & F.lit(new)).alias("deprecated"))
        fields = F.array(*[
            F.struct(text("i").alias("name"), F.lit("string").alias("type"), F.lit("").alias("ref")), F.struct(text("u").alias("name"), F.lit("reference").alias("type"), text("T").alias("ref")),
            F.struct(text("w").alias("name"), F.when(F.lit(new) & (k % 12 == 0), "integer").otherwise("string").alias("type"), F.lit("").alias("ref")),
            F.struct((F.when(k % 6 == 4, F.concat(text("val"), F.lit("_x"))).otherwise(text("val")) if new else text("val")).alias("name"), F.lit("reference").alias("type"), text("V").alias("ref"))])
        prop = own.select(called.alias("entity"), "k", F.explode(fields).alias("f")).where(~((k % 12 == 10) & F.lit(new) & F.startswith("f.name", F.lit("w")))).select(
            "entity", "f.name", "f.type", F.lit(True).alias("required"), F.lit("1").alias("cardinality"), F.col("f.ref").alias("reference_target"), F.lit("").alias("array_item_type"), F.lit(False).alias("deprecated"))
        nk, rk = F.col("n_nationkey"), F.col("r_regionkey")
        rule = n.where(nk % 5 != (1 if new else 0)).select(F.concat(F.lit("R"), nk.cast("string")).alias("rule_id"), F.when((nk % 3 == 0) & F.lit(new), "should").otherwise("must").alias("severity"), F.lit("trust").alias("phase"), F.col("n_name").alias("description"))
        enum = r.select(F.col("r_name").alias("name"), (F.when(rk % 2 == 0, F.array(F.lit("a"), F.lit("b_c"))).otherwise(F.array(F.lit("a"), F.lit("b-c"), F.lit("new"))) if new else F.array(F.lit("a"), F.lit("b-c"))).alias("values"))
        return replace(Graph.empty(spark), entity=entity, property=prop, rule=rule, enum_type=enum)

    return version(False), version(True)


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All changes between two versions."""
    return api.changelog(*_versions(spark, sf_dir)).select("kind", "entity", "change", "details", "old_value", "new_value")


def changelog_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: counts of the changelog document."""
    doc = documents.changelog_document(api.changelog(*_versions(spark, sf_dir)), "1", "2")
    return _rows(spark, {"summary": doc["summary"], "by_type": {c: len(r) for c, r in doc["entity_changes_by_type"].items()}})


QUERIES = {f.__name__: f for f in (
    cddl_entities, cddl_properties, cddl_edges, json_schema_properties, json_schema_edges, metadata_document, metadata_stats, turtle_lines, context_document, rules_document, rename_entities, rename_properties, changelog, changelog_document)}


def _values(rows) -> str:
    shown = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, (bool, int)) else f"'{x}'"
    return ", ".join("(" + ", ".join(map(shown, r)) + ")" for r in rows)


_C = f"""WITH kind(i, type, required, cardinality, reference_target, array_item_type, pattern, min_length) AS (VALUES {_values((i, *c[1:]) for i, c in enumerate(_CDDL))}),
  f AS (SELECT replace(p_brand, '#', '') || 'Map' AS entity, p_partkey AS k, p_type, kind.* FROM part JOIN kind ON i = p_partkey % {len(_CDDL)})"""
_J = f"""WITH kind(i, type, reference_target, array_item_type, many) AS (VALUES {_values((i, *s[1:]) for i, s in enumerate(_SCHEMAS))}),
  f AS (SELECT replace(p_brand, '#', '') AS entity, 'f' || p_partkey AS name, p_partkey AS k, p_partkey % 3 = 0 AS required, p_type, kind.* FROM part JOIN kind ON i = p_partkey % {len(_SCHEMAS)}),
  p AS (SELECT entity, name, type, CASE WHEN i = 0 THEN p_type ELSE '' END AS description, required, CASE WHEN many THEN CASE WHEN required THEN '1..*' ELSE '0..*' END WHEN required THEN '1' ELSE '0..1' END AS cardinality,
    CASE WHEN type = 'enum' THEN 'a,b' ELSE '' END AS enum_values, reference_target, array_item_type, CASE WHEN i = 0 THEN '^' || k || '$' ELSE '' END AS pattern FROM f
    UNION ALL SELECT 'TheDoc', 'top', 'reference', '', FALSE, '0..1', '', 'Either', '', '' UNION ALL SELECT 'Either', '_union', 'union', 'One of: Brand11, Other', TRUE, '1', '', 'Brand11', '', '')"""
_S = "WITH s AS (SELECT s_suppkey AS k, 'p-' || s_suppkey AS name, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_BASE = rdf.BASE
_CHANGES = """WITH s AS (SELECT s_suppkey AS k, 'S' || s_suppkey || 'Map' AS o FROM supplier), n AS (SELECT n_nationkey AS k, n_name FROM nation), r AS (SELECT r_regionkey AS k, r_name FROM region),
  c AS (SELECT 'entity' AS kind, 'R' || k AS entity, 'renamed' AS change, o || ' -> R' || k || CASE WHEN k % 12 = 0 THEN ' | modified properties: w' || k || ': type: ''string'' -> ''integer''' ELSE '' END AS details, o AS old_value, 'R' || k AS new_value FROM s WHERE k % 6 = 0
    UNION ALL SELECT 'entity', o || 'V2', 'renamed', o || ' -> ' || o || 'V2', o, o || 'V2' FROM s WHERE k % 6 = 1
    UNION ALL SELECT 'entity', o, 'removed', 'Entity removed', o, NULL FROM s WHERE k % 6 = 2 UNION ALL SELECT 'entity', o, 'added', 'Added entity with 4 properties', NULL, o FROM s WHERE k % 6 = 3
    UNION ALL SELECT 'entity', o, 'modified', 'renamed properties: val' || k || ' -> val' || k || '_x' || CASE WHEN k % 12 = 10 THEN ' | removed properties: w' || k ELSE '' END, NULL, NULL FROM s WHERE k % 6 = 4
    UNION ALL SELECT 'entity', o, 'deprecated', 'Entity marked deprecated', NULL, NULL FROM s WHERE k % 6 = 5
    UNION ALL SELECT 'rule', 'R' || k, 'added', 'Rule added: ' || n_name, NULL, CASE WHEN k % 3 = 0 THEN 'should' ELSE 'must' END FROM n WHERE k % 5 = 0
    UNION ALL SELECT 'rule', 'R' || k, 'removed', 'Rule removed: ' || n_name, 'must', NULL FROM n WHERE k % 5 = 1
    UNION ALL SELECT 'rule', 'R' || k, 'modified', 'severity: must -> should', 'must', 'should' FROM n WHERE k % 5 > 1 AND k % 3 = 0
    UNION ALL SELECT 'enum', r_name, 'modified', CASE WHEN k % 2 = 0 THEN 'renamed values: b-c -> b_c' ELSE 'added values: new' END, '2', CASE WHEN k % 2 = 0 THEN '2' ELSE '3' END FROM r)"""
ORACLES = {
    "cddl_entities": "SELECT DISTINCT replace(p_brand, '#', '') || 'Map' AS name, 'All of ' || p_brand AS description, replace(p_brand, '#', '-') || '-map' AS aliases, FALSE AS deprecated FROM part",
    "cddl_properties": _C + " SELECT entity, 'f' || k AS name, type, p_type AS description, required, cardinality, reference_target, array_item_type, pattern, min_length, k % 4 = 0 AS deprecated FROM f",
    "cddl_edges": _C + """ SELECT entity AS source, 'f' || k AS name, reference_target AS target, 'references' AS type, cardinality FROM f WHERE reference_target <> ''
      UNION ALL SELECT DISTINCT entity, 'includes', 'CommonMap', 'extends', '1' FROM f""",
    "json_schema_properties": _J + " SELECT * FROM p",
    "json_schema_edges": _J + """ SELECT entity AS source, name, CASE WHEN type = 'array' THEN array_item_type ELSE reference_target END AS target, CASE WHEN type = 'array' THEN 'has_many' ELSE 'references' END AS type, cardinality
      FROM p WHERE reference_target <> '' OR array_item_type = 'Item'""",
    "metadata_document": _S + """ SELECT '1.0' AS version, n_name AS entity, name, CASE k % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'array' ELSE 'string' END AS type, k % 2 = 0 AS required, '1' AS cardinality,
      CASE WHEN k % 4 = 0 THEN 'x,y' ELSE '' END AS enum_values, CASE WHEN k % 3 = 0 THEN 'T' ELSE '' END AS reference_target, FALSE AS deprecated FROM s""",
    "metadata_stats": """SELECT 'entity_count' AS path, (SELECT count(*) FROM nation)::VARCHAR AS value UNION ALL SELECT 'relationship_count', '0' UNION ALL SELECT 'rule_count', (SELECT count(*) FROM supplier)::VARCHAR
      UNION ALL SELECT 'enum_count', (SELECT count(*) FROM region)::VARCHAR UNION ALL SELECT 'type_alias_count', '0' UNION ALL SELECT 'status_code_count', (SELECT count(*) FROM nation)::VARCHAR""",
    "turtle_lines": r"""SELECT 'spec:' || n_name AS subject, 'spec:' || n_name || ' a owl:Class' || CASE WHEN n_nationkey % 5 = 0 THEN E' ;\n    owl:deprecated "true"^^xsd:boolean' ELSE '' END || E' ;\n    owl:sameAs spec:' || lower(n_name)
      || CASE WHEN n_nationkey % 2 = 0 THEN E' ;\n    rdfs:comment "The \\"' || n_name || E'\\""@en' ELSE '' END || E' ;\n    rdfs:label "' || n_name || '"@en .' AS line FROM nation""",
    "context_document": _S + f""", x AS (SELECT s.*, row_number() OVER (PARTITION BY n_name ORDER BY k) AS i FROM s),
      t AS (SELECT unnest([('@context/' || n_name || '.' || name, '@id', '{_BASE}' || n_name || '.' || replace(name, '-', '_')), ('@context/' || n_name || '.' || name, '@type', CASE k % 3 WHEN 0 THEN '@id' WHEN 2 THEN 'xsd:string' END),
          ('@context/' || n_name || '.' || name, '@container', CASE WHEN k % 3 = 1 THEN '@list' END), ('@context/' || name, '@id', '{_BASE}' || n_name || '.' || replace(name, '-', '_'))]) AS r FROM x),
      e AS (SELECT unnest([('@context/' || name, '@id', '{_BASE}' || translate(name, ' :/', '___')), ('@context/' || name, '@type', '@id')]) AS r FROM (SELECT n_name AS name FROM nation UNION SELECT r_name FROM region))
      SELECT r[1] || '/' || r[2] AS path, r[3] AS value FROM (SELECT * FROM t UNION ALL SELECT * FROM e) WHERE r[3] IS NOT NULL UNION ALL SELECT '@context/' || p, v FROM (VALUES {_values([*rdf.PREFIXES.items(), ("@vocab", _BASE)])}) AS q(p, v)""",
    "rules_document": _S + """, x AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'trust' ELSE 'content' END AS phase, CASE WHEN k % 2 = 0 THEN 'must' ELSE 'may' END AS severity FROM s),
      y AS (SELECT *, row_number() OVER (PARTITION BY phase ORDER BY CASE severity WHEN 'must' THEN 0 ELSE 1 END, k) - 1 AS i FROM x),
      c AS (SELECT 'c.' || n_nationkey AS code, CASE WHEN n_nationkey % 2 = 0 THEN 'success' ELSE 'failure' END AS cat FROM nation), d AS (SELECT *, row_number() OVER (PARTITION BY cat ORDER BY code) - 1 AS i FROM c)
      SELECT 'version' AS path, '1.0' AS value UNION ALL SELECT unnest(['rule_count', 'summary/total']), count(*)::VARCHAR FROM x UNION ALL SELECT 'summary/by_phase/' || phase, count(*)::VARCHAR FROM x GROUP BY phase UNION ALL SELECT 'summary/by_severity/' || severity, count(*)::VARCHAR FROM x GROUP BY severity
      UNION ALL SELECT 'phases/' || phase || '/' || i || '/' || f[1], f[2] FROM (SELECT phase, i, unnest([['rule_id', 'R' || k], ['description', s_name], ['severity', severity], ['phase', phase], ['spec_section', 's'], ['referenced_entities/0', n_name]]) AS f FROM y)
      UNION ALL SELECT 'status_codes/' || cat || '/' || i || '/' || f[1], f[2] FROM (SELECT cat, i, unnest([['code', code], ['meaning', 'm'], ['url_usage', 'u']]) AS f FROM d)""",
    "rename_entities": "SELECT 'S' || s_suppkey || 'Map' AS old, CASE WHEN s_suppkey % 3 = 0 THEN 'Renamed' || s_suppkey ELSE 'S' || s_suppkey || 'MapV2' END AS new FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 15 <> 1)",
    "rename_properties": "SELECT p_brand AS entity, 'prop' || p_partkey AS old, 'prop' || p_partkey || '_x' AS new FROM part WHERE p_partkey % 2 = 0 AND p_partkey % 10 <> 4 AND p_partkey % 6 <> 0",
    "changelog": _CHANGES + " SELECT * FROM c",
    "changelog_document": _CHANGES + " SELECT 'summary/' || kind || '_changes' AS path, count(*)::VARCHAR AS value FROM c GROUP BY kind UNION ALL SELECT 'summary/total_changes', count(*)::VARCHAR FROM c UNION ALL SELECT 'by_type/' || change, count(*)::VARCHAR FROM c WHERE kind = 'entity' GROUP BY change",
}
