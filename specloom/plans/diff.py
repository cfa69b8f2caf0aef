"""Queries that compare snapshots and find renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.operators import diff
from specloom.session import table


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as rules, before and after: some go, some come, some change."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rule = lambda severity, phase, text: o.select(k.alias("rule_id"), severity.alias("severity"), phase.alias("phase"), text.alias("description"))
    status, priority, about = F.col("o_orderstatus"), F.col("o_orderpriority"), F.concat(F.lit("order of "), F.col("o_custkey").cast("string"))
    old = rule(status, priority, about).where(k % 11 != 0)
    new = rule(F.when(k % 13 == 0, "X").otherwise(status), F.when(k % 17 == 0, "Y").otherwise(priority), F.when(k % 19 == 0, "changed").otherwise(about)).where(k % 7 != 0)
    return old, new


def diff_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two snapshots of orders."""
    c = diff.diff_rules(*_snapshots(spark, sf_dir))
    return c.select("entity", "change", "details", "old_value", "new_value")


def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those changes by type."""
    c = diff.diff_rules(*_snapshots(spark, sf_dir)).withColumn("entity", F.col("entity").cast("bigint"))
    totals = c.groupBy("change").agg(F.sum("entity").alias("total"), F.max("entity").alias("last"))
    return diff.summary(c).join(totals, "change").select("kind", "change", "n", F.array_join("entities", ",").alias("first"), "total", "last")


def _rules_sql(tail: str) -> str:
    return f"""
WITH old AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, 'order of ' || o_custkey AS d FROM orders WHERE o_orderkey % 11 <> 0),
new AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'X' ELSE o_orderstatus END AS s, CASE WHEN o_orderkey % 17 = 0 THEN 'Y' ELSE o_orderpriority END AS p,
  CASE WHEN o_orderkey % 19 = 0 THEN 'changed' ELSE 'order of ' || o_custkey END AS d FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT coalesce(o.k, n.k) AS entity, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'modified' END AS change, o.s AS old_value, n.s AS new_value,
  CASE WHEN o.k IS NULL THEN 'Rule added: ' || n.d WHEN n.k IS NULL THEN 'Rule removed: ' || o.d ELSE concat_ws(' | ', CASE WHEN o.s <> n.s THEN 'severity: ' || o.s || ' -> ' || n.s END,
    CASE WHEN o.p <> n.p THEN 'phase: ' || o.p || ' -> ' || n.p END, CASE WHEN o.d <> n.d THEN 'description changed' END) END AS details
  FROM old o FULL JOIN new n ON o.k = n.k)
{tail}"""


def _props(df: DataFrame, key: Column) -> DataFrame:
    """Properties of suppliers: name, home, and balance class, as a snapshot has them."""
    kinds = F.array(*[
        F.struct(F.lit(n).alias("name"), kind.alias("type"), F.lit(r).alias("required"))
        for n, kind, r in (("name", F.lit("string"), True), ("nation", F.concat(F.lit("n"), F.col("s_nationkey").cast("string")), False), ("balance", F.when(F.col("s_acctbal") > 5000, "integer").otherwise("float"), False))])
    rows = df.select(key.alias("entity"), F.explode(kinds).alias("k")).select("entity", "k.*")
    return rows.select("entity", "name", "type", "required", F.lit("1").alias("cardinality"), F.lit("").alias("reference_target"), F.lit("").alias("array_item_type"), F.lit(False).alias("deprecated"))


def diff_entities_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of suppliers before and after: moved, rebalanced, dropped and new ones."""
    s = table(spark, sf_dir, "supplier")
    key = F.col("entity")
    later = s.withColumns({"s_nationkey": F.when(F.col("s_suppkey") % 3 == 0, F.lit(99)).otherwise(F.col("s_nationkey")), "s_acctbal": F.when(F.col("s_suppkey") % 4 == 0, F.lit(9000.0)).otherwise(F.col("s_acctbal"))})
    new = _props(later, F.col("s_suppkey")).where(~((F.col("name") == "nation") & (key % 7 == 0)) & ~((key % 5 == 0) & (F.col("name") == "balance")))
    old = _props(s, F.col("s_suppkey")).where(~((key % 5 == 0) & (F.col("name") == "nation")))
    return diff.diff_properties(old, new)


_PROPS_SQL = """
WITH o AS (SELECT s_suppkey AS e, s_nationkey AS n, CASE WHEN s_acctbal > 5000 THEN 'integer' ELSE 'float' END AS b FROM supplier),
n AS (SELECT s_suppkey AS e, CASE WHEN s_suppkey % 3 = 0 THEN 99 ELSE s_nationkey END AS n, CASE WHEN CASE WHEN s_suppkey % 4 = 0 THEN 9000.0 ELSE s_acctbal END > 5000 THEN 'integer' ELSE 'float' END AS b FROM supplier),
a AS (SELECT e, 'nation' AS name, 'n' || n AS t FROM o WHERE e % 5 <> 0 UNION ALL SELECT e, 'balance', b FROM o),
z AS (SELECT e, 'nation' AS name, 'n' || n AS t FROM n WHERE e % 7 <> 0 UNION ALL SELECT e, 'balance', b FROM n WHERE e % 5 <> 0),
j AS (SELECT coalesce(a.e, z.e) AS e, coalesce(a.name, z.name) AS name, a.t AS ot, z.t AS nt FROM a FULL JOIN z ON a.e = z.e AND a.name = z.name)
SELECT e AS entity, concat_ws(' | ',
  CASE WHEN count(*) FILTER (ot IS NULL) > 0 THEN 'added properties: ' || string_agg(name, ', ' ORDER BY name) FILTER (ot IS NULL) END,
  CASE WHEN count(*) FILTER (nt IS NULL) > 0 THEN 'removed properties: ' || string_agg(name, ', ' ORDER BY name) FILTER (nt IS NULL) END,
  CASE WHEN count(*) FILTER (ot <> nt) > 0 THEN 'modified properties: ' || string_agg(name || ': type: ''' || ot || ''' -> ''' || nt || '''', '; ' ORDER BY name) FILTER (ot <> nt) END) AS details
FROM j WHERE ot IS DISTINCT FROM nt GROUP BY e
"""


def diff_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of every brand's small and large parts, some spelt otherwise."""
    p = table(spark, sf_dir, "part")
    old = p.where("p_size <= 10").groupBy(F.col("p_brand").alias("name")).agg(F.sort_array(F.collect_set("p_type")).alias("values"))
    spelt = F.when(F.length("p_type") % 2 == 0, F.lower(F.concat(F.substring("p_type", 1, 2), F.lit("-"), F.substring("p_type", 3, 100)))).otherwise(F.col("p_type"))
    new = p.where("p_size > 40").groupBy(F.col("p_brand").alias("name")).agg(F.sort_array(F.collect_set(spelt)).alias("values"))
    return diff.diff_enums(old, new).select("entity", "change", "details", "old_value", "new_value")


_ENUMS_SQL = """
WITH o AS (SELECT p_brand AS name, list_sort(list_distinct(list(p_type))) AS v FROM part WHERE p_size <= 10 GROUP BY 1),
n AS (SELECT p_brand AS name, list_sort(list_distinct(list(CASE WHEN length(p_type) % 2 = 0 THEN lower(p_type[1:2] || '-' || p_type[3:]) ELSE p_type END))) AS v FROM part WHERE p_size > 40 GROUP BY 1),
j AS (SELECT coalesce(o.name, n.name) AS entity, o.v AS ov, n.v AS nv, list_filter(coalesce(n.v, []), lambda x: NOT list_contains(coalesce(o.v, []), x)) AS added, list_filter(coalesce(o.v, []), lambda x: NOT list_contains(coalesce(n.v, []), x)) AS removed FROM o FULL JOIN n ON o.name = n.name),
r AS (SELECT *, list_filter(list_transform(removed, lambda x: {'o': x, 'n': list_filter(added, lambda y: translate(lower(y), '-_.', '') = translate(lower(x), '-_.', ''))}), lambda p: len(p.n) > 0) AS pairs FROM j WHERE len(added) + len(removed) > 0),
t AS (SELECT *, list_transform(pairs, lambda p: p.o) AS po, list_transform(pairs, lambda p: p.n[1]) AS pn FROM r)
SELECT entity, CASE WHEN ov IS NULL THEN 'added' WHEN nv IS NULL THEN 'removed' ELSE 'modified' END AS change,
  CASE WHEN ov IS NULL THEN 'Enum added with ' || len(nv) || ' values: ' || array_to_string(nv[1:5], ', ') WHEN nv IS NULL THEN 'Enum type removed' ELSE concat_ws(' | ',
    CASE WHEN len(pairs) > 0 THEN 'renamed values: ' || array_to_string(list_transform(pairs, lambda p: p.o || ' -> ' || p.n[1]), ', ') END,
    CASE WHEN len(added) > len(pn) THEN 'added values: ' || array_to_string(list_filter(added, lambda x: NOT list_contains(pn, x)), ', ') END,
    CASE WHEN len(removed) > len(po) THEN 'removed values: ' || array_to_string(list_filter(removed, lambda x: NOT list_contains(po, x)), ', ') END) END AS details,
  CASE WHEN ov IS NOT NULL AND nv IS NOT NULL THEN len(ov)::VARCHAR END AS old_value, CASE WHEN ov IS NOT NULL AND nv IS NOT NULL THEN len(nv)::VARCHAR END AS new_value
FROM t
"""


def diff_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose rows differ at all."""
    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 9 <> 1").withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 0, 0.0).otherwise(F.col("c_acctbal")))
    return diff.diff_shallow(c.where("c_custkey % 8 <> 3"), new, "c_custkey")


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of customers and suppliers: difference, intersection, union."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("k"))
    named = lambda d, n: d.select(F.lit(n).alias("op"), "k")
    return named(c.subtract(s), "except").unionByName(named(c.intersect(s), "intersect")).unionByName(named(c.unionByName(s).distinct(), "union"))


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of small and of large parts that share at least a tenth of their names."""
    p = table(spark, sf_dir, "part").where("p_brand is not null and p_name is not null")
    brands = lambda where, side: p.where(where).select(F.col("p_brand").alias(side), F.col("p_name").alias("i")).distinct()
    return diff.item_overlaps(brands("p_size < 20", "old"), brands("p_size >= 20", "new"), 0.1)


def rename_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands of small and of large parts that share at least a tenth of their names."""
    return _overlaps(spark, sf_dir).select("old", "new", F.round("jaccard", 9).alias("jaccard"))


_JACCARD_SQL = """
WITH a AS (SELECT p_brand AS b, list_distinct(list(p_name)) AS i FROM part WHERE p_size < 20 GROUP BY 1), z AS (SELECT p_brand AS b, list_distinct(list(p_name)) AS i FROM part WHERE p_size >= 20 GROUP BY 1)
SELECT a.b AS old, z.b AS new, round(len(list_intersect(a.i, z.i)) / (len(a.i) + len(z.i) - len(list_intersect(a.i, z.i))), 9) AS jaccard FROM a, z
WHERE len(list_intersect(a.i, z.i)) / (len(a.i) + len(z.i) - len(list_intersect(a.i, z.i))) >= 0.1 AND len(list_intersect(a.i, z.i)) > 0
"""


def rename_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same brands matched one to one in their order, the best free one first."""
    return diff.greedy(_overlaps(spark, sf_dir).withColumn("score", F.round("jaccard", 9)), [])


_GREEDY_SQL = f"""
WITH RECURSIVE cand AS ({_JACCARD_SQL}), old AS (SELECT old, row_number() OVER (ORDER BY old) AS k FROM (SELECT DISTINCT old FROM cand)),
step(k, old, new, used) AS (
  SELECT 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[]
  UNION ALL
  SELECT k, old, new, CASE WHEN new IS NULL THEN used ELSE list_append(used, new) END FROM (
    SELECT o.k, o.old, s.used, (SELECT arg_min(c.new, (-c.jaccard, c.new)) FROM cand c WHERE c.old = o.old AND NOT list_contains(s.used, c.new)) AS new FROM step s JOIN old o ON o.k = s.k + 1))
SELECT old, new FROM step WHERE new IS NOT NULL
"""


def rename_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers of the same nation and balance, to a thousand, by likeness of their names."""
    level = lambda c: F.floor(F.col(c) / 1000).alias("level")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), level("c_acctbal"), F.col("c_name").alias("old"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), level("s_acctbal"), F.col("s_name").alias("new"))
    return diff.greedy_alike(c, s, ["nation", "level"], 0.6)


QUERIES = {f.__name__: f for f in (diff_full, change_summary, diff_entities_props, diff_enums, diff_shallow, set_ops, rename_jaccard, rename_greedy, rename_fuzzy)}
ORACLES = {
    "diff_full": _rules_sql("SELECT * FROM j WHERE change <> 'modified' OR details <> ''"),
    "change_summary": _rules_sql("SELECT 'rule' AS kind, change, count(*) AS n, array_to_string(list_sort(list(entity))[1:20], ',') AS first, sum(entity)::BIGINT AS total, max(entity) AS last FROM j WHERE change <> 'modified' OR details <> '' GROUP BY change"),
    "diff_entities_props": _PROPS_SQL, "diff_enums": _ENUMS_SQL,
    "diff_shallow": """WITH o AS (SELECT * FROM customer WHERE c_custkey % 8 <> 3), n AS (SELECT * REPLACE (CASE WHEN c_custkey % 6 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal) FROM customer WHERE c_custkey % 9 <> 1)
      SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN o.c_custkey IS NULL THEN 'added' WHEN n.c_custkey IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN n ON o.c_custkey = n.c_custkey
      WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal <> n.c_acctbal""",
    "set_ops": """WITH c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000)
      SELECT 'except' AS op, k FROM (SELECT * FROM c EXCEPT SELECT * FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT * FROM c INTERSECT SELECT * FROM s) UNION ALL SELECT 'union', k FROM (SELECT * FROM c UNION SELECT * FROM s)""",
    "rename_jaccard": _JACCARD_SQL, "rename_greedy": _GREEDY_SQL,
}
