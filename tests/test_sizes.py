"""Queries over tables of another size than the given ones: nothing in them grows with the table, and results stay those of the SQL."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from specloom.functions import names
from specloom.operators import diff, prose
from specloom.operators import rdf as rdf_triples
from specloom.plans import artifacts, catalogue, rdf

BASE = "/root/testdata/sf0.001"


def shown(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The smallest tables, ``part`` and others repeated with shifted keys."""
    made = {}

    def make(**times):
        key = tuple(times.items())
        if key not in made:
            d = made[key] = tmp_path_factory.mktemp("grown")
            c = duckdb.connect()
            for t, k in {"nation": "n_nationkey", "region": "r_regionkey", "part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "events": "event_id"}.items():
                n = c.execute(f"SELECT max({k}) + 1 FROM '{BASE}/{t}.parquet'").fetchone()[0]
                c.execute(f"COPY (SELECT b.* REPLACE (b.{k} + i * {n} AS {k}) FROM '{BASE}/{t}.parquet' b, range({times.get(t, 1)}) r(i)) TO '{d}/{t}.parquet' (FORMAT parquet)")
        return str(made[key])

    return make


def agrees(spark, d, name):
    c = duckdb.connect()
    for t in "nation region part supplier customer events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, d)
    want = c.execute(catalogue.ORACLES[name]).fetchall()
    at = [[x[0] for x in c.description].index(k) for k in df.columns]
    assert sorted(tuple(map(shown, r)) for r in df.collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want)


def longest(files):
    return files.selectExpr("max(length(text)) AS n").first().n


@pytest.mark.parametrize("name", ["json_schema_properties", "json_schema_edges"])
def test_json_files_stay_small(spark, grown, name):
    d = grown(part=30)
    assert longest(artifacts._json_files(spark, d)) < 1.2 * longest(artifacts._json_files(spark, grown(part=10))) < 200_000
    agrees(spark, d, name)


@pytest.mark.parametrize("name", ["predicates_contract", "predicates_references", "predicates_coverage"])
def test_predicate_documents_come_in_pieces(spark, grown, name):
    d = grown(events=30)
    assert rdf._documents(spark, d).selectExpr("max(size(d.format_families['image'].predicates)) AS n").first().n <= rdf.PER_PIECE / 5
    agrees(spark, d, name)


def test_status_tables_hold_no_copies_of_the_document(spark):
    """A table's row has some text before it, not all; what that says is the same."""
    mark = "|==="
    table = "|`c.{}` |m |u\n"
    one = "success" + "".join(f"\n{mark}\n{table.format(i)}" for i in range(400))  # 200 tables, each other part between two
    words = "".join(f"x {w} " + "y" * n + f"\n{mark}\n{table.format(w + str(n))}{mark}\n" for w in ("failure", "success") for n in (0, 150, 285, 300))
    bare = "failure\n" + f"{mark}\n" * (2 * 74) + f"{mark}\n{table.format('z')}{mark}\n"
    docs = spark.createDataFrame([(0, one), (1, words), (2, bare), (3, None), (4, ""), (5, mark)], "k int, text string")

    def plain(t):
        pieces, marks = re.split(r"(?m)^\|={3,}", t), re.findall(r"(?m)^\|={3,}", t)
        for i in range(1, len(pieces) - 1, 2):
            ctx = "".join(p + m for p, m in zip(pieces[:i], [*marks[: i - 1], ""]))[-300:].lower()
            for c in re.findall(r"`(\S+)`", pieces[i]):
                yield c, next((w for w in ("failure", "informational", "success") if re.search(rf"\b{w}\b", ctx)), "unknown")

    got = prose.status_codes(docs, ["k"])
    assert sorted((r.k, r.code, r.category) for r in got.collect()) == sorted((k, *x) for k, t in ((0, one), (1, words), (2, bare)) for x in plain(t))


def test_status_tables_of_a_long_document(spark):
    """10 000 tables in a document: copies of it would be 3 GB."""
    long = "".join(f"of success {i:0200}\n|===\n|`c.{i}` |m |u\n|===\n" for i in range(10_000))
    docs = spark.createDataFrame([(0, long)], "k int, text string")
    assert [tuple(r) for r in prose.status_codes(docs, ["k"]).groupBy("category").count().collect()] == [("success", 10_000)]


def test_fuzzy_pairs_are_the_greedy_ones(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abAB1") for _ in range(r.choice((0, 3, 6, 8))))
    rows = [(r.randint(0, 3), word(), word()) for _ in range(160)] + [(1, "x" * 70, "x" * 65 + "y" * 9), (1, "x" * 63 + "é", None), (2, None, "a"), (7, "a", None)]
    df = spark.createDataFrame(rows, "k int, old string, new string")
    scored = df.select("k", "old").distinct().join(df.select("k", "new").distinct(), "k").withColumn("score", names.name_similarity(F.col("old"), F.col("new"), 0.6)).where("score >= 0.6")
    want = {tuple(x) for x in diff.greedy(scored, ["k"]).select("k", "old", "new").collect()}
    got = [tuple(x) for x in diff.greedy_alike(df.select("k", "old"), df.select("k", "new"), ["k"], 0.6).select("k", "old", "new").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50


def test_fuzzy_makes_no_pairs(spark, grown):
    """The pairs of a group were rows, most of them for nothing."""
    plan = catalogue.QUERIES["rename_fuzzy"](spark, grown())._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "MapInArrow" in plan


def test_greedy_settles_few_candidates_in_one_pass(spark, monkeypatch):
    """All want the same ones: rounds of offers settle one pair each."""
    cand = [(f"o{i:02}", f"n{j:02}", 1.0) for i in range(25) for j in range(25)]
    df = spark.createDataFrame(cand, "old string, new string, score double")
    cuts = []
    cut = diff.cut
    monkeypatch.setattr(diff, "cut", lambda d: cuts.append(1) or cut(d))
    for fold in (diff.FOLD, 10):  # the rest of a large one after some rounds
        cuts.clear()
        monkeypatch.setattr(diff, "FOLD", fold)
        assert {tuple(r) for r in diff.greedy(df, []).select("old", "new").collect()} == {(f"o{i:02}", f"n{i:02}") for i in range(25)}
        assert len(cuts) <= 1 + 2 * diff.ROUNDS


def test_overlaps_join_no_sets(spark, grown):
    plan = diff.item_overlaps(*[spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y")], f"{c} string, i string") for c in ("old", "new")], 0.6)
    assert sorted((r.old, r.new, r.jaccard) for r in plan.collect()) == [("a", "a", 1.0), ("b", "b", 1.0)]
    assert "collect_set" not in catalogue.QUERIES["rename_jaccard"](spark, grown())._jdf.queryExecution().optimizedPlan().toString()


def test_renamed_entities_of_long_keys(spark, grown):
    """Suppliers from 1006 on had an unlike name that was alike by its digits."""
    agrees(spark, grown(supplier=150), "rename_entities")


def test_renamed_properties_of_long_keys(spark, grown):
    """Parts from 10004 on had an unlike name that was alike by its digits."""
    agrees(spark, grown(part=60), "rename_properties")


@pytest.mark.parametrize("name", ["cddl_entities", "cddl_properties", "cddl_edges"])
def test_cddl_files_stay_small(spark, grown, name):
    d = grown(part=30)
    assert longest(artifacts._cddl_files(spark, d)) < 1.2 * longest(artifacts._cddl_files(spark, grown(part=10))) < 100_000
    agrees(spark, d, name)


def test_triples_are_distinct_without_comparing_them(spark, grown):
    schema = "entity string, name string, type string, description string, required boolean, cardinality string, enum_values array<string>, reference_target string, array_item_type string, pattern string, deprecated boolean"
    rows = [("a b", "n.x", "array", "d", True, "1", ["v", None], "", "Item", "", False), ("a b", "n_x", "array", "e", False, "1..*", None, "", "Item", "", True), ("a b", "n_x", "array", "e", False, "1..*", None, "", "Item", "", True),
            ("a_b", "n-x", "odd", None, None, None, [], None, None, None, None), ("c", None, "union", "d", True, "1", [], "", "", "p", False), ("a.b", "c", "map", "", True, "0..1", [], "T", "", "", False)]
    p = spark.createDataFrame(rows, schema)
    for plain, distinct in ((rdf_triples.property_triples, rdf_triples.distinct_property_triples), (rdf_triples.restriction_triples, rdf_triples.distinct_restriction_triples)):
        every = [tuple(r) for r in plain(p).collect()]
        assert len(set(every)) < len(every)
        assert sorted(map(str, distinct(p).collect())) == sorted(map(str, plain(p).distinct().collect()))
    for name in ("triples_property", "triples_restriction"):  # triples are made last of all
        plan = catalogue.QUERIES[name](spark, grown())._jdf.queryExecution().optimizedPlan().toString()
        assert plan.index("Generate") < plan.index("Aggregate")
