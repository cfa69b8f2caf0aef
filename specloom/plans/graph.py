"""Queries that integrate sources: merging, references, edges, aliases, registries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom import api
from specloom.functions import names
from specloom.operators import integrate
from specloom.session import table
from specloom.sources import registry

def _v() -> Column:
    return F.lit("1").alias("version")


def name_camel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts in every form."""
    p = table(spark, sf_dir, "part")
    kebab = F.translate("p_name", " ", "-")
    odd = F.concat(F.lit("$~"), "p_name", F.lit("/x:"), "p_brand", F.lit(".<y>"))
    return p.select(
        "p_partkey", names.camel(kebab).alias("camel"), names.without_socket(odd).alias("bare"), names.last_segment(odd).alias("last"), names.normalise(kebab).alias("loose"), names.iri_part(odd).alias("iri"),
        names.member_part(F.col("p_brand"), odd).alias("member"), names.term_part(odd).alias("term"), names.term_member_part(F.col("p_brand"), odd).alias("term_member"), names.rule_id(F.lit("content"), F.col("p_partkey")).alias("rule_id"))


_ODD = "'$~' || p_name || '/x:' || p_brand || '.<y>'"
_BARE = f"replace(replace({_ODD}, '<', ''), '>', '')"


def gap_fill_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank segments of customers from suppliers of the same name in any case."""
    c = table(spark, sf_dir, "customer").select(_v(), F.col("c_custkey").alias("ord"), F.regexp_replace("c_name", "^[A-Za-z]+", "N").alias("name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("").alias("description"))
    s = table(spark, sf_dir, "supplier").select(_v(), F.col("s_suppkey").alias("ord"), F.regexp_replace("s_name", "^[A-Za-z]+", "n").alias("name"), F.concat(F.lit("supplier "), "s_suppkey").alias("description"))
    matched = integrate.match_names(c, s, ["version"], "js")
    return integrate.fill_blanks(matched, s, [("version", "version"), ("js", "name")]).select(F.col("ord").alias("custkey"), "name", "description", "js")


def anti_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents, and documents without any that have text."""
    labelled = table(spark, sf_dir, "labels").select("doc_id", F.lit("label").alias("origin"))
    docs = table(spark, sf_dir, "documents").where("n_chars > 0").select("doc_id", F.lit("document").alias("origin"))
    return integrate.append_missing(labelled, docs, ["doc_id"])


def priority_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every part the first of several brands that a size-one part has."""
    p = table(spark, sf_dir, "part")
    targets = p.where("p_size = 1").select(F.col("p_brand").alias("name")).distinct()
    tried = F.array(F.concat(F.lit("Brand#"), F.col("p_size").cast("string")), F.concat(F.lit("Brand#"), (F.col("p_partkey") % 60).cast("string")), F.col("p_brand"))
    return integrate.priority_match(p.select("p_partkey", "p_size", "p_brand"), tried, targets, "name", ["p_partkey"]).select("p_partkey", F.col("matched").alias("brand"))


def ref_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to nations in odd case as the names they mean."""
    n = table(spark, sf_dir, "nation").select(_v(), F.col("n_name").alias("name"), F.col("n_nationkey").cast("bigint").alias("ord"), F.lit(0).alias("kind"))
    r = table(spark, sf_dir, "region").select(_v(), F.lower("r_name").alias("name"), F.col("r_regionkey").cast("bigint").alias("ord"), F.lit(1).alias("kind"))
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey") % 4
    ref = F.when(k == 0, F.lower("n_name")).when(k == 1, F.col("n_name")).when(k == 2, F.col("r_name")).otherwise(F.concat("n_name", F.lit("?")))
    return integrate.resolve(c.select(_v(), "c_custkey", ref.alias("ref")), "ref", n.unionByName(r)).select("c_custkey", "ref")


def infer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between tables by their columns' names and kinds, counted over order lines."""
    lines = table(spark, sf_dir, "lineitem")
    entities = spark.createDataFrame([("1", i, n) for i, n in enumerate(("Order", "Part", "SupplierMap", "lineItem"))], "version string, ord bigint, name string")
    made = (("order", "reference", "Order", "", "1"), ("parent_part", "reference", "part", "", "0..*"), ("supplier", "array", "", "supplier-map", "1..*"), ("nothing", "reference", "Absent", "", "1"), ("many", "reference", "OrderMap", "", "1..*"))
    kinds = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(k, ("name", "type", "ref", "item", "card"))]) for k in made])
    p = lines.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n")).select(
        _v(), F.lit("lineItem").alias("entity"), F.posexplode(kinds).alias("o", "k"), "l_returnflag", "l_linestatus", "n")
    props = p.select(
        "version", "entity", (F.col("o") * 100 + F.ascii("l_returnflag") + F.ascii("l_linestatus")).cast("bigint").alias("ord"), F.concat_ws("_", "k.name", "l_returnflag", "l_linestatus").alias("name"), "k.type",
        F.concat(F.lit("in "), F.col("n").cast("string")).alias("description"), F.col("k.card").alias("cardinality"), F.col("k.ref").alias("reference_target"), F.col("k.item").alias("array_item_type"),
        (F.col("l_linestatus") == "F").alias("deprecated"))
    return integrate.infer_edges(props, entities).select("name", "source", "target", "type", "description", "cardinality")


def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents' sources and languages that no label's document has, with a base type by name."""
    d = table(spark, sf_dir, "documents")
    known = d.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").where("doc_id % 40 = 0").select(_v(), F.upper("source").alias("name")).distinct()
    refs = d.select(_v(), F.explode(F.array("source", F.concat("lang", F.lit("-uri")), F.concat(F.lit("map"), F.col("lang")), F.lit("string"))).alias("name"))
    return integrate.dangling(refs, known).select("name", names.alias_base(F.col("name")).alias("base_type"), F.coalesce(names.literal_map({"en-uri": "external"}, F.col("name")), F.lit("")).alias("note"))


def dedup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of every user and kind."""
    e = table(spark, sf_dir, "events")
    return integrate.first_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event's value at the first one's place, by user."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ord"), "event_type")
    return integrate.last_wins(e, ["user_id"])


def merge_first_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: parts of a brand's first size, and those of other sizes whose type is new."""
    p = table(spark, sf_dir, "part").select(_v(), F.col("p_brand").alias("entity"), F.col("p_type").alias("name"), F.col("p_size").alias("part"), "p_partkey")
    return integrate.merge_properties(p).select("entity", "name", "part", "p_partkey")


def union_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: types of every brand over files, one a size, in order, each once."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.sort_array(F.collect_set("p_type")).alias("values"))
    e = p.select(_v(), F.col("p_size").cast("bigint").alias("ord"), F.col("p_brand").alias("name"), "values", (F.col("p_size") == 7).alias("extensible"), F.lit("").alias("description"), F.lit("").alias("source"))
    return integrate.merge_enums(e).select("name", F.array_join("values", "|").alias("values"), "extensible")


def enum_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: enumerations of plug lines; values that aren't literals make them extensible."""
    e = table(spark, sf_dir, "events").select("event_type", "user_id").distinct()
    line = F.concat(F.lit("$"), "event_type", F.lit("-kind /= "), F.when(F.col("user_id") % 9 == 0, "tstr").otherwise(F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"'))), F.lit(" ; note"))
    text = e.groupBy("event_type").agg(F.array_join(F.sort_array(F.collect_list(F.struct("user_id", line.alias("l"))))["l"], "\n").alias("text"))
    plugs = text.select(F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(r"(?m)^\$([\w-]+)\s*/=[ \t]*(.+?)(?:\s*;.*|)$"), 1).alias("n"), F.regexp_extract_all("text", F.lit(r"(?m)^\$([\w-]+)\s*/=[ \t]*(.+?)(?:\s*;.*|)$"), 2).alias("v"))).alias("p"))
    literal = F.regexp_extract("p.v", '^"([^"]+)"$', 1)
    return plugs.groupBy(names.camel(F.col("p.n")).alias("name")).agg(F.sort_array(F.collect_list(F.nullif(literal, F.lit("")))).alias("v"), F.bool_or(literal == "").alias("extensible")).select("name", F.array_join("v", ",").alias("values"), "extensible")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts and documents with a word, in any case, as plain text."""
    p = table(spark, sf_dir, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"))
    d = table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("name"), F.col("text").alias("description"))
    return api.search(p.unionByName(d), "TION. ").select("kind", "id").unionByName(api.search(p, "EC").select("kind", "id"))


def lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nation, edges at either end of it, and rules that name it."""
    n = table(spark, sf_dir, "nation")
    edges = n.join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source"), F.col("r_name").alias("target"))
    first = n.where("n_nationkey = 3").select(F.lit("entity").alias("what"), "n_name")
    ends = edges.join(first.select(F.col("n_name").alias("x")), (F.col("source") == F.col("x")) | (F.col("target") == F.col("x"))).select(F.lit("edge").alias("what"), F.col("target").alias("n_name"))
    rules = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("refs")).where(F.array_contains("refs", "NATION_3") | F.exists("refs", lambda x: x.endswith("3"))).select(F.lit("rule").alias("what"), F.array_join("refs", ",").alias("n_name"))
    return first.unionByName(ends).unionByName(rules)


def list_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry, newest first."""
    return registry.version_table(spark).where("commit_hash = ''").select("version", "date", "tag", "ord")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: rows of tables."""
    out = None
    for t in ("nation", "customer", "part", "orders", "lineitem"):
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (
    name_camel, gap_fill_merge, anti_append, priority_match, ref_normalise, infer_edges, dangling_refs, dedup_first_wins, last_wins, merge_first_files, union_values, enum_groups, search, lookup, list_versions, counts)}
_EDGES = [("order", "Order", "has_one", "1"), ("parent_part", "Part", "belongs_to", "0..*"), ("supplier", "SupplierMap", "has_many", "0..*"), ("many", "Order", "has_many", "1..*")]
ORACLES = {
    "name_camel": rf"""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1:1]) || lower(x[2:])), '') AS camel, {_ODD}[3:] AS bare, list_extract(string_split({_ODD}, '/'), -1) AS last,
      lower(replace(p_name, ' ', '')) AS loose, translate({_BARE}, ' :/', '___') AS iri, translate(p_brand, ' ', '_') || '.' || translate({_BARE}, ' :/.-', '_____') AS member, translate({_ODD}, ' :/', '___') AS term,
      p_brand || '.' || translate({_ODD}, ' :.-', '____') AS term_member, 'VAL-CONT-' || printf('%04d', p_partkey) AS rule_id FROM part""".replace(f"{_ODD}[3:]", f"({_ODD})[3:]"),
    "gap_fill_merge": r"""WITH c AS (SELECT c_custkey AS custkey, regexp_replace(c_name, '^[A-Za-z]+', 'N') AS name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment ELSE '' END AS d FROM customer),
      s AS (SELECT s_suppkey AS k, regexp_replace(s_name, '^[A-Za-z]+', 'n') AS name FROM supplier),
      m AS (SELECT c.*, (SELECT arg_min(s.name, s.k) FROM s WHERE lower(s.name) = lower(c.name)) AS js FROM c)
      SELECT custkey, m.name, coalesce(nullif(d, ''), 'supplier ' || k, '') AS description, js FROM m LEFT JOIN s ON s.name = m.js""",
    "anti_append": "SELECT doc_id, 'label' AS origin FROM labels UNION ALL SELECT doc_id, 'document' FROM documents WHERE n_chars > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "priority_match": """WITH t AS (SELECT DISTINCT p_brand AS b FROM part WHERE p_size = 1)
      SELECT p_partkey, coalesce(x.b, y.b, z.b) AS brand FROM part LEFT JOIN t x ON x.b = 'Brand#' || p_size LEFT JOIN t y ON y.b = 'Brand#' || (p_partkey % 60) LEFT JOIN t z ON z.b = p_brand WHERE coalesce(x.b, y.b, z.b) IS NOT NULL""",
    "ref_normalise": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN coalesce((SELECT lower(r_name) FROM region WHERE lower(r_name) = lower(n.n_name)), n_name) WHEN 1 THEN n_name
      WHEN 2 THEN coalesce((SELECT n2.n_name FROM nation n2 WHERE n2.n_name = r.r_name), lower(r_name)) ELSE n_name || '?' END AS ref
      FROM customer JOIN nation n ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey""",
    "infer_edges": " UNION ALL ".join(
        f"SELECT '{n}_' || l_returnflag || '_' || l_linestatus AS name, 'lineItem' AS source, '{t}' AS target, '{k}' AS type, 'in ' || count(*) AS description, '{c}' AS cardinality FROM lineitem WHERE l_linestatus <> 'F' GROUP BY l_returnflag, l_linestatus"
        for n, t, k, c in _EDGES),
    "dangling_refs": """WITH k AS (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 0 AND doc_id IN (SELECT doc_id FROM labels)),
      r AS (SELECT source AS name FROM documents UNION SELECT lang || '-uri' FROM documents UNION SELECT 'map' || lang FROM documents)
      SELECT name, CASE WHEN name LIKE '%uri%' OR name LIKE '%url%' THEN 'string' WHEN name LIKE '%map%' THEN 'map' ELSE 'string' END AS base_type, CASE WHEN name = 'en-uri' THEN 'external' ELSE '' END AS note FROM r WHERE name NOT IN (SELECT source FROM k)""",
    "dedup_first_wins": "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL",
    "last_wins": "SELECT user_id, min(event_id) AS ord, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "merge_first_files": """SELECT p_brand AS entity, p_type AS name, p_size AS part, p_partkey FROM (SELECT *, min(p_size) OVER (PARTITION BY p_brand) AS f, min(p_size) OVER (PARTITION BY p_brand, p_type) AS g FROM part) WHERE p_size = f OR p_size = g""",
    "union_values": "SELECT name, string_agg(t, '|' ORDER BY s, t) AS values, bool_or(x) AS extensible FROM (SELECT p_brand AS name, p_type AS t, min(p_size) AS s, bool_or(p_size = 7) AS x FROM part GROUP BY ALL) GROUP BY name",
    "enum_groups": r"""SELECT array_to_string(list_transform(regexp_split_to_array(event_type || '-kind', '[-_]'), lambda x: upper(x[1:1]) || lower(x[2:])), '') AS name,
      coalesce(string_agg(CASE WHEN user_id % 9 <> 0 THEN 'u' || user_id END, ',' ORDER BY 'u' || user_id), '') AS values, bool_or(user_id % 9 = 0) AS extensible FROM (SELECT DISTINCT event_type, user_id FROM events) GROUP BY event_type""",
    "search": """SELECT 'part' AS kind, p_partkey AS id FROM part WHERE contains(lower(p_name), 'tion. ') OR contains(lower(p_type), 'tion. ') UNION ALL SELECT 'document', doc_id FROM documents WHERE contains(lower(source), 'tion. ') OR contains(lower(text), 'tion. ')
      UNION ALL SELECT 'part', p_partkey FROM part WHERE contains(lower(p_name), 'ec') OR contains(lower(p_type), 'ec')""",
    "lookup": """SELECT 'entity' AS what, n_name FROM nation WHERE n_nationkey = 3 UNION ALL SELECT 'edge', r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3
      UNION ALL SELECT 'rule', string_agg(n_name, ',' ORDER BY n_name) FROM nation GROUP BY n_regionkey HAVING bool_or(n_name LIKE '%3')""",
    "list_versions": "SELECT * FROM (VALUES " + ", ".join(f"('{v.version}', '{v.date}', '{v.tag}', {i}::INT)" for i, v in enumerate(registry.VERSIONS) if not v.commit_hash) + ") AS t(version, date, tag, ord)",
    "counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("nation", "customer", "part", "orders", "lineitem")),
}
