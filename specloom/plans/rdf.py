"""Queries that project tables as triples, terms and grouped rules, and check predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.operators import predicates, rdf
from specloom.session import table


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("bigint").alias("ord"), F.concat("n_name", F.lit(" x")).alias("name"), F.when(k % 2 == 0, F.concat(F.lit("nation "), k.cast("string"))).otherwise("").alias("description"), F.when(k % 3 == 0, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).otherwise("").alias("parent"),
        F.when(k % 4 == 0, "Sec 1").otherwise("").alias("spec_section"), F.array(F.concat("n_name", F.lit(" x")), F.lower("n_name")).alias("aliases"), (k % 5 == 0).alias("deprecated"))


def _properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    kinds = ("string", "integer", "float", "boolean", "uri", "enum", "array", "map", "reference", "union")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (k % 10 + 1).cast("int"))
    return p.select(
        F.col("p_brand").alias("entity"), k.alias("ord"), F.concat("p_name", F.lit("-"), k.cast("string")).alias("name"), kind.alias("type"), F.when(k % 3 == 0, F.col("p_type")).otherwise("").alias("description"), (k % 2 == 0).alias("required"),
        F.element_at(F.array(F.lit("1"), F.lit("0..1"), F.lit("0..*"), F.lit("1..*")), (F.col("p_size") % 4 + 1).cast("int")).alias("cardinality"), F.when(k % 4 == 0, F.array("p_type", F.lit("z"))).otherwise(F.array().cast("array<string>")).alias("enum_values"),
        F.when(k % 20 < 10, F.col("p_type")).otherwise("").alias("reference_target"), F.when(k % 20 < 10, F.col("p_type")).otherwise("string").alias("array_item_type"), F.when(k % 7 == 0, "^a$").otherwise("").alias("pattern"), (k % 11 == 0).alias("deprecated"))


def triples_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header and classes."""
    header = rdf.ontology_triples(spark.createDataFrame([("9.9", "2026-01-01")], "version string, date string"))
    return rdf.entity_triples(_entities(spark, sf_dir)).unionByName(header).distinct()


def triples_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties."""
    return rdf.distinct_property_triples(_properties(spark, sf_dir))


def triples_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cardinality restrictions."""
    return rdf.distinct_restriction_triples(_properties(spark, sf_dir))


def triples_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from nations to regions."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = n.select(F.lit("inferred").alias("scope"), F.col("n_nationkey").alias("ord"), F.lit("in-region").alias("name"), F.col("n_name").alias("source"), F.col("r_name").alias("target"),
                 F.when(F.col("n_nationkey") % 2 == 0, "extends").otherwise("has_one").alias("type"), F.when(F.col("n_nationkey") % 3 == 0, "about").otherwise("").alias("description"))
    return rdf.relationship_triples(e.unionByName(e.withColumn("ord", F.lit(99)))).distinct()


def triples_enum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumerations, closed ones as lists."""
    e = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_set("p_type")).alias("values"))
    return rdf.enum_triples(e.select(F.col("p_brand").alias("name"), F.lit("").alias("description"), "values", F.col("p_brand").endswith("1").alias("extensible"))).distinct()


def context_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a context."""
    p = _properties(spark, sf_dir).withColumn("name", F.substring_index("name", " ", 1))
    e = p.groupBy(F.col("entity").alias("name")).agg(F.min("ord").alias("ord"))
    first = p.withColumn("r", F.row_number().over(Window.partitionBy("entity", "name").orderBy("ord"))).where("r = 1").drop("r")
    enums = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("bigint").alias("ord"), F.col("r_name").alias("name")).unionByName(e.where("name like '%3'"))
    return rdf.context_terms(e, first, enums).select("term", "id", "type", "container", F.col("ord.section").alias("section"))


def status_codes_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order states as codes by category."""
    o = table(spark, sf_dir, "orders")
    c = o.select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("code"), F.lit("m").alias("meaning"), F.when(F.col("o_orderkey") % 2 == 0, "(multiple)").otherwise("u").alias("url_usage"),
                 F.element_at(F.create_map(*[F.lit(x) for kv in {"O": "success", "F": "failure", "P": "odd"}.items() for x in kv]), F.col("o_orderstatus")).alias("category"))
    return rdf.ordered_codes(c).select("category", "code", "ord", "url_usage")


#: A piece of a document has the predicates of so many event ids at most, so that no row grows with the table.
PER_PIECE = 10_000


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicate documents made of events, each in pieces by event id: some ids, severities and conditions are broken."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    doc = (F.col("user_id") % 10).cast("int")
    expected = F.concat(F.lit('{"expected_status": "'), F.when(k % 5 == 0, "plain").when(k % 5 == 1, "label.x").otherwise(F.concat(F.lit("code."), (k % 70).cast("string"))), F.lit('"}'))
    pair = lambda a, b, x, y: F.map_from_arrays(F.array(F.lit(a), F.lit(b)), F.array(x, y))
    vectors = F.when(k % 6 > 0, F.when(k % 4 == 0, pair("passing_a", "should_fail", F.lit("1"), F.lit("2"))).when(k % 4 == 1, pair("v", "w", F.lit('{"expected_result": null}'), expected))
                     .when(k % 4 == 2, pair("invalid_a", "fail_b", F.lit('{"expected": "token"}'), F.lit("2"))).otherwise(pair("passing_x", "non_conforming", F.lit('{"result": 1}'), F.lit("{}"))))
    pred = F.struct(
        F.concat(F.lit("PRED-"), F.when(k % 50 == 0, F.col("event_type")).otherwise(F.upper("event_type")), F.lit("-"), F.lpad((k % 700).cast("string"), 3, "0")).alias("predicate_id"),
        F.when(k % 40 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("VAL-CONT-"), F.format_string("%04d", k % 90)))).alias("source_rules"),
        F.when(k % 30 == 0, "will").otherwise("shall").alias("severity"), F.when(k % 35 > 0, "t").alias("title"), F.lit("d").alias("description"),
        F.when(k % 45 == 0, F.lit("{}")).when(k % 8 == 0, F.concat(F.lit('{"op":"delegate","to_predicates":["PRED-CLICK-'), F.lpad((k % 999).cast("string"), 3, "0"), F.lit('", "PRED-NONE-001"]}')))
        .when(k % 8 == 1, '{"op":"exists","target":"PRED-NONE-002","note":"delegate"}').otherwise('{"op":"exists"}').alias("condition"), vectors.alias("test_vectors"))
    rule = F.when(k % 40 != 0, k % 90)
    # what a document says of the whole of it
    total = F.broadcast(e.groupBy(doc.alias("of")).agg(F.count("*").alias("n"), F.count_distinct(rule).alias("rules")))
    pieces = e.groupBy(doc.alias("doc"), F.floor(k / PER_PIECE).alias("piece")).agg(F.collect_list(pred).alias("ps"))
    made = pieces.join(total, F.col("doc").eqNullSafe(F.col("of")))
    ps = F.col("ps")
    shape = f"struct<{predicates.SCHEMA}>"
    d = F.struct(
        F.lit("9").alias("spec_version"), F.when(F.col("doc") != 3, "1").alias("predicate_schema_version"),
        F.create_map(F.lit("image"), F.struct(F.lit("d").alias("description"), F.when(F.col("doc") == 4, F.array().cast("array<string>")).otherwise(F.array(F.lit("image/x"))).alias("mime_types"), F.lit("b").alias("binding_mechanism"), ps.alias("predicates"))).alias("format_families"),
        F.struct(F.lit("d").alias("description"), F.array().cast("array<" + predicates._PRED + ">").alias("predicates")).alias("cross_cutting"),
        F.struct(F.when(F.col("doc") == 5, F.lit(1)).otherwise(F.col("n")).cast("bigint").alias("total_predicates"), F.col("rules").alias("rules_formalized"),
                 F.lit(90).cast("bigint").alias("total_v24_rules"), F.lit(1.0).alias("coverage_percent"), F.lit("{}").alias("format_coverage")).alias("coverage_summary"))
    return made.select("doc", d.cast(shape).alias("d"))


_PRED_SQL = """
WITH p AS (SELECT user_id % 10 AS doc, event_id AS k, 'PRED-' || CASE WHEN event_id % 50 = 0 THEN event_type ELSE upper(event_type) END || '-' || lpad((event_id % 700)::VARCHAR, 3, '0') AS id, event_type FROM events)
"""


def predicates_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations by document and kind."""
    return predicates.violations(_documents(spark, sf_dir)).groupBy("doc", "violation").agg(F.count("*").alias("n"))


def predicates_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source rules and delegation targets that aren't there."""
    d = _documents(spark, sf_dir)
    rules = table(spark, sf_dir, "nation").select(F.concat(F.lit("VAL-CONT-"), F.format_string("%04d", "n_nationkey")).alias("rule_id"))
    a = predicates.dangling_rules(d, rules).groupBy(F.lit("rule").alias("what"), "doc").agg(F.count("*").alias("n"))
    codes = table(spark, sf_dir, "nation").select(F.concat(F.lit("code."), F.col("n_nationkey").cast("string")).alias("code"))
    b = predicates.dangling_codes(d, codes, "label.").groupBy(F.lit("code").alias("what"), "doc").agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(predicates.dangling_delegations(d).groupBy(F.lit("delegate").alias("what"), "doc").agg(F.count("*").alias("n")))


def predicates_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of every document."""
    c = predicates.coverage(_documents(spark, sf_dir))
    return c.withColumn("vector_share", F.round("vector_share", 9))


CONDITIONS = {
    "PRED-LINE-001": {"op": "and", "conditions": [{"op": "equals", "field": "l_returnflag", "value": "R"}, {"op": "exists", "field": "l_shipdate"}]},
    "PRED-LINE-002": {"op": "or", "conditions": [{"op": "delegate", "to_predicates": ["PRED-LINE-001"]}, {"op": "equals", "field": "l_linestatus", "value": "O"}]},
    "PRED-LINE-003": {"op": "not", "condition": {"op": "equals", "field": "l_linenumber", "value": 1}},
    "PRED-LINE-004": {"op": "implies", "if": {"op": "in", "field": "l_returnflag", "values": ["A", "R"]}, "then": {"op": "greater_than", "field": "l_quantity", "value": 25}},
    "PRED-LINE-005": {"op": "delegate", "to_predicates": ["PRED-LINE-002", "PRED-LINE-004"]},
}


def predicate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that meet each predicate."""
    rows = predicates.evaluate(table(spark, sf_dir, "lineitem"), CONDITIONS, ["l_shipdate"])
    return rows.groupBy("predicate_id", "ok").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (
    triples_entity, triples_property, triples_restriction, triples_relationship, triples_enum, context_terms, status_codes_grouped, predicates_contract, predicates_references, predicates_coverage, predicate_eval)}

_I = "'iri' AS o_kind, '' AS o_datatype, '' AS o_lang"


def _lit(dt: str = "", lang: str = "") -> str:
    return f"'literal' AS o_kind, '{dt}' AS o_datatype, '{lang}' AS o_lang"


_SAFE = "translate(replace(replace({}, '<', ''), '>', ''), ' :/', '___')"
_KINDS = "['string','integer','float','boolean','uri','enum','array','map','reference','union']"
_PROP = f"""WITH p AS (SELECT p_brand AS e, p_partkey AS k, p_name || '-' || p_partkey AS name, ({_KINDS})[p_partkey % 10 + 1] AS t, CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '' END AS d, p_partkey % 2 = 0 AS req,
  (['1','0..1','0..*','1..*'])[p_size % 4 + 1] AS card, CASE WHEN p_partkey % 4 = 0 THEN p_type || ', z' END AS ev, CASE WHEN p_partkey % 20 < 10 THEN p_type ELSE '' END AS ref, CASE WHEN p_partkey % 20 < 10 THEN p_type ELSE 'string' END AS item,
  p_partkey % 7 = 0 AS pat, p_partkey % 11 = 0 AS dep FROM part),
q AS (SELECT *, 'spec:' || p.e || '.' || translate(name, ' -', '__') AS s, t IN ('reference', 'map') OR (t = 'array' AND item <> 'string') AS obj FROM p)
"""
ORACLES = {
    "triples_entity": f"""WITH e AS (SELECT n_nationkey AS k, n_regionkey AS r, n_name, n_name || ' x' AS name, 'spec:' || n_name || '_x' AS s FROM nation)
      SELECT s, 'rdf:type' AS p, 'owl:Class' AS o, {_I} FROM e UNION SELECT s, 'rdfs:label', name, {_lit(lang="en")} FROM e UNION SELECT s, 'rdfs:comment', 'nation ' || k, {_lit(lang="en")} FROM e WHERE k % 2 = 0
      UNION SELECT s, 'owl:deprecated', 'true', {_lit("xsd:boolean")} FROM e WHERE k % 5 = 0 UNION SELECT s, 'rdfs:isDefinedBy', 'Sec 1', {_lit()} FROM e WHERE k % 4 = 0
      UNION SELECT s, 'rdfs:subClassOf', 'spec:R' || r, {_I} FROM e WHERE k % 3 = 0 UNION SELECT s, 'owl:sameAs', 'spec:' || lower(n_name), {_I} FROM e
      UNION SELECT 'spec:', 'rdf:type', 'owl:Ontology', {_I} UNION SELECT 'spec:', 'rdfs:label', 'Specification ontology', {_lit(lang="en")} UNION SELECT 'spec:', 'rdfs:comment', 'Generated from specification sources', {_lit(lang="en")}
      UNION SELECT 'spec:', 'owl:versionIRI', 'spec:v9.9/', {_I} UNION SELECT 'spec:', 'owl:versionInfo', '9.9', {_lit()} UNION SELECT 'spec:', 'dc:date', '2026-01-01', {_lit("xsd:date")}""",
    "triples_property": _PROP + f"""SELECT s, 'rdf:type' AS p, CASE WHEN obj THEN 'owl:ObjectProperty' ELSE 'owl:DatatypeProperty' END AS o, {_I} FROM q
      UNION SELECT s, 'rdfs:range', 'spec:' || CASE WHEN t = 'array' THEN item ELSE ref END, {_I} FROM q WHERE obj AND CASE WHEN t = 'array' THEN item ELSE ref END <> ''
      UNION SELECT s, 'rdfs:range', CASE t WHEN 'union' THEN 'rdfs:Literal' WHEN 'float' THEN 'xsd:decimal' WHEN 'uri' THEN 'xsd:anyURI' WHEN 'integer' THEN 'xsd:integer' WHEN 'boolean' THEN 'xsd:boolean' ELSE 'xsd:string' END, {_I} FROM q WHERE NOT obj
      UNION SELECT s, 'rdfs:domain', 'spec:' || e, {_I} FROM q UNION SELECT s, 'rdfs:label', name, {_lit(lang="en")} FROM q UNION SELECT s, 'rdfs:comment', d, {_lit(lang="en")} FROM q WHERE d <> ''
      UNION SELECT s, 'owl:deprecated', 'true', {_lit("xsd:boolean")} FROM q WHERE dep UNION SELECT s, 'spec:pattern', '^a$', {_lit()} FROM q WHERE pat UNION SELECT s, 'spec:enumValues', ev, {_lit()} FROM q WHERE ev IS NOT NULL""",
    "triples_restriction": _PROP + f""", b AS (SELECT *, 'minCardinality' AS bound FROM q WHERE (card = '1' AND req) OR card = '1..*' UNION ALL SELECT *, 'maxCardinality' FROM q WHERE (card = '1' AND req) OR card = '0..1'),
      n AS (SELECT *, '_:' || left(sha256(s || chr(10) || bound), 16) AS node FROM b)
      SELECT node AS s, 'rdf:type' AS p, 'owl:Restriction' AS o, {_I} FROM n UNION SELECT node, 'owl:onProperty', s, {_I} FROM n UNION SELECT node, 'owl:' || bound, '1', {_lit("xsd:nonNegativeInteger")} FROM n UNION SELECT 'spec:' || e, 'rdfs:subClassOf', node, {_I} FROM n""",
    "triples_relationship": f"""WITH e AS (SELECT n_nationkey AS k, 'spec:' || n_name AS a, 'spec:' || {_SAFE.format("r_name")} AS b, 'spec:' || n_name || '.in_region' AS s FROM nation JOIN region ON n_regionkey = r_regionkey)
      SELECT s, 'rdf:type' AS p, 'owl:ObjectProperty' AS o, {_I} FROM e UNION SELECT s, 'rdfs:label', 'in-region', {_lit(lang="en")} FROM e UNION SELECT s, 'rdfs:domain', a, {_I} FROM e UNION SELECT s, 'rdfs:range', b, {_I} FROM e
      UNION SELECT s, 'rdfs:comment', 'about', {_lit(lang="en")} FROM e WHERE k % 3 = 0 UNION SELECT s, 'spec:relationshipType', CASE WHEN k % 2 = 0 THEN 'extends' ELSE 'has_one' END, {_lit()} FROM e UNION SELECT a, 'rdfs:subClassOf', b, {_I} FROM e WHERE k % 2 = 0""",
    "triples_enum": f"""WITH v AS (SELECT DISTINCT p_brand AS e, p_type AS t FROM part), i AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY e) AS n, 'spec:' || e AS s, e LIKE '%1' AS ext,
        'spec:' || e || '.' || {_SAFE.format("t")} AS one FROM v), x AS (SELECT *, '_:' || left(sha256(s || chr(10) || i), 16) AS node, '_:' || left(sha256(s || chr(10) || (i + 1)), 16) AS rest, '_:' || left(sha256(s || chr(10) || 'oneOf'), 16) AS own FROM i)
      SELECT s, 'rdf:type' AS p, 'owl:Class' AS o, {_I} FROM x UNION SELECT s, 'rdfs:label', e, {_lit(lang="en")} FROM x UNION SELECT s, 'spec:extensible', 'true', {_lit("xsd:boolean")} FROM x WHERE ext
      UNION SELECT one, 'rdf:type', 'owl:NamedIndividual', {_I} FROM x UNION SELECT one, 'rdf:type', s, {_I} FROM x UNION SELECT one, 'rdfs:label', t, {_lit(lang="en")} FROM x
      UNION SELECT node, 'rdf:first', one, {_I} FROM x WHERE NOT ext UNION SELECT node, 'rdf:rest', CASE WHEN i + 1 < n THEN rest ELSE 'rdf:nil' END, {_I} FROM x WHERE NOT ext
      UNION SELECT own, 'owl:oneOf', node, {_I} FROM x WHERE NOT ext AND i = 0 UNION SELECT s, 'owl:equivalentClass', own, {_I} FROM x WHERE NOT ext AND i = 0""",
    "context_terms": f"""WITH p AS (SELECT p_brand AS e, p_partkey AS k, split_part(p_name || '-' || p_partkey, ' ', 1) AS name, ({_KINDS})[p_partkey % 10 + 1] AS t FROM part),
      en AS (SELECT e, min(k) AS k FROM p GROUP BY e), f AS (SELECT p.*, en.k * 10000000000 + p.k AS o, '{rdf.BASE}' || replace(p.e, ' ', '_') || '.' || translate(name, ' :.-', '____') AS id FROM p JOIN en USING (e)
        QUALIFY row_number() OVER (PARTITION BY p.e, name ORDER BY p.k) = 1),
      a AS (SELECT e AS term, '{rdf.BASE}' || e AS id, '@id' AS type, NULL::VARCHAR AS container, 1 AS section, 1 AS prio FROM en
        UNION ALL SELECT e || '.' || name, id, CASE t WHEN 'string' THEN 'xsd:string' WHEN 'integer' THEN 'xsd:integer' WHEN 'float' THEN 'xsd:decimal' WHEN 'boolean' THEN 'xsd:boolean' WHEN 'uri' THEN '@id' WHEN 'map' THEN '@id' WHEN 'reference' THEN '@id' END,
          CASE WHEN t = 'array' THEN '@list' END, 2, 0 FROM f
        UNION ALL SELECT name, arg_min(id, o), NULL, NULL, 3, 3 FROM f GROUP BY name
        UNION ALL SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}', NULL, NULL, 0, 2)" for k, v in [*rdf.PREFIXES.items(), ("@vocab", rdf.BASE)])})
        UNION ALL SELECT r_name, '{rdf.BASE}' || translate(r_name, ' :/', '___'), '@id', NULL, 4, 4 FROM region UNION ALL SELECT e, '{rdf.BASE}' || e, '@id', NULL, 4, 4 FROM en WHERE e LIKE '%3')
      SELECT term, id, type, container, section::INT AS section FROM a QUALIFY row_number() OVER (PARTITION BY term ORDER BY prio) = 1""",
    "status_codes_grouped": """SELECT CASE o_orderstatus WHEN 'O' THEN 'success' WHEN 'F' THEN 'failure' ELSE 'unknown' END AS category, o_orderpriority AS code, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 1 THEN 'u' END AS url_usage FROM orders""",
    "predicates_contract": _PRED_SQL + """SELECT doc::INT AS doc, violation, count(*) AS n FROM (
      SELECT doc, 'bad id' AS violation FROM p WHERE k % 50 = 0 UNION ALL SELECT doc, 'no source rule' FROM p WHERE k % 40 = 0 UNION ALL SELECT doc, 'bad severity' FROM p WHERE k % 30 = 0 UNION ALL SELECT doc, 'missing title' FROM p WHERE k % 35 = 0
      UNION ALL SELECT doc, 'condition without op' FROM p WHERE k % 45 = 0 UNION ALL SELECT doc, 'no failing vector' FROM p WHERE k % 4 = 3 AND k % 6 > 0 UNION ALL SELECT doc, 'no passing vector' FROM p WHERE k % 4 = 2 AND k % 6 > 0
      UNION ALL SELECT doc, 'duplicate id' FROM p GROUP BY doc, id HAVING count(*) > 1 UNION ALL SELECT 3, 'missing predicate_schema_version' UNION ALL SELECT 4, 'no mime type') GROUP BY ALL""",
    "predicates_references": _PRED_SQL + """SELECT 'rule' AS what, doc::INT AS doc, count(*) AS n FROM p WHERE k % 40 > 0 AND k % 90 NOT IN (SELECT n_nationkey FROM nation) GROUP BY doc
      UNION ALL SELECT 'delegate', doc::INT, count(*) FILTER (NOT EXISTS (SELECT 1 FROM p q WHERE q.doc = p.doc AND q.id = 'PRED-CLICK-' || lpad((p.k % 999)::VARCHAR, 3, '0'))) + count(*) FROM p WHERE k % 8 = 0 AND k % 45 > 0 GROUP BY doc
      UNION ALL SELECT 'code', doc::INT, count(DISTINCT k % 70) FROM p WHERE k % 6 > 0 AND k % 4 = 1 AND k % 5 > 1 AND k % 70 NOT IN (SELECT n_nationkey FROM nation) GROUP BY doc""",
    "predicates_coverage": _PRED_SQL + """SELECT doc::INT AS doc, count(*) AS total_predicates, count(DISTINCT CASE WHEN k % 40 > 0 THEN k % 90 END) AS rules_formalized, round(avg((k % 6 > 0)::INT), 9) AS vector_share, avg((k % 6 > 0)::INT) >= 0.8 AS enough_vectors,
      doc <> 5 AS reconciled FROM p GROUP BY doc""",
    "predicate_eval": """SELECT id AS predicate_id, ok, count(*) AS n FROM (SELECT unnest([{'id': 'PRED-LINE-001', 'ok': l_returnflag = 'R' AND l_shipdate IS NOT NULL}, {'id': 'PRED-LINE-002', 'ok': (l_returnflag = 'R' AND l_shipdate IS NOT NULL) OR l_linestatus = 'O'},
      {'id': 'PRED-LINE-003', 'ok': l_linenumber <> 1}, {'id': 'PRED-LINE-004', 'ok': l_returnflag NOT IN ('A', 'R') OR l_quantity > 25},
      {'id': 'PRED-LINE-005', 'ok': ((l_returnflag = 'R' AND l_shipdate IS NOT NULL) OR l_linestatus = 'O') AND (l_returnflag NOT IN ('A', 'R') OR l_quantity > 25)}], recursive := true) FROM lineitem) GROUP BY ALL""",
}
