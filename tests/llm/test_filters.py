"""Operators 1, 5, 8, 9 and 6 on small and odd tables."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from specloom.llm import crf, lines, mixing, quality, sharding
from specloom.llm import decontamination as dc
from specloom.llm import kernel
from tests_llm_util import edited, prose

ODD = [(None, "some text of a row without an id."), (1, None), (2, ""), (3, "x " * 40_000), (4, "tie one two three four."), (4, "tie one two three four."), (5, "...")]


@pytest.fixture
def odd(make):
    return make(ODD).withColumns({"score": F.lit(1), "item_id": F.lit(9), "matched": F.lit("m"), "shard": F.lit("s"), "mix_pass": F.lit(0), "n": F.lit(0), "h": F.lit("h"), "good_score": F.lit("g"), "content_share": F.lit(2)})


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


# 1
def brute_leaks(docs, bench, threshold):
    grams = lambda t: kernel.shingles(kernel.words(pa.array([t])), dc.N, short=False)[0].tolist()
    out = {}
    for i, t in enumerate(docs):
        d = grams(t)
        for j, b in bench:
            g = grams(b)
            if g:
                best = max(((len(set(d[p : p + len(g)]) & set(g)), -p) for p in range(len(d)) if d[p] in g), default=(0, 0))
                if best[0] >= dc.need_of(len(set(g)), threshold):
                    out[i, j] = best[0]
    return out


@pytest.mark.parametrize("slice_size", [dc.SLICE, 50])
def test_leaks_against_brute_force(spark, make, monkeypatch, slice_size):
    monkeypatch.setattr(dc, "SLICE", slice_size)
    r = random.Random(4)
    bench = [(j, prose(r, r.choice([4, 15, 30, 60]))) for j in range(12)] + [(50, "of"), (51, ""), (52, None), (None, "a b c d e f")]
    docs = []
    for _ in range(40):
        parts = [prose(r, 60)]
        for j, b in bench[:12]:
            if r.random() < 0.15:
                parts.append(edited(r, b, r.choice([0, 0.05, 0.15, 0.4])))
        r.shuffle(parts)
        docs.append(" ".join(parts))
    docs.append(bench[3][1] + " " + bench[3][1])
    want = brute_leaks(docs, [b for b in bench if b[0] is not None and b[1]], dc.THRESHOLD)
    got = {(x.doc_id, x.item_id): x.matched for x in dc.contaminated(make(docs), items(spark, bench)).collect()}
    assert got == want and len(want) > 10


def test_leaks_in_odd_tables(spark, odd, make):
    bench = items(spark, [(1, "tie one two three four")])
    assert [x.doc_id for x in dc.contaminated(odd, bench).collect()] == [4, 4]
    kept = dc.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 5
    assert dc.drop_contaminated(odd, items(spark, [(None, "tie one two three four"), (None, "some text of a row without")])).count() == 4
    assert dc.contaminated(make([]), bench).count() == 0 and dc.drop_contaminated(odd, items(spark, [])).count() == 7


# 5
def junk(r):
    return " ".join(w + r.choice(["$$$", "###", "&&&"]) for w in prose(r, 80).split())


def test_quality_of_held_out_texts():
    r = random.Random(1)
    good, bad = [prose(r, 80).encode() for _ in range(300)], [junk(r).encode() for _ in range(300)]
    m = quality.train(good[:200], bad[:200])
    p, q = quality.predict(good[200:], m), quality.predict(bad[200:], m)
    assert ((p >= 0.5).mean() + (q < 0.5).mean()) / 2 > 0.95
    assert quality.train(good, []) is None
    assert quality.train(good[:1], bad[:1]) is not None


def test_quality_in_odd_tables(spark, odd, make):
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 0), (4, 1, 0), (None, 1, 0), (9, None, 0)], "doc_id bigint, quality int, toxic int")
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.where("doc_id = 3").count() == 1
    assert quality.keep_good(odd, labels.where("quality = 1")).count() == 7  # one class alone decides nothing
    assert quality.classify(odd, labels).where("good_score between 0 and 1").count() == 7
    assert quality.keep_good(make([]), labels).count() == 0


# 8
def test_lines_of_held_out_documents():
    r = random.Random(2)
    good = ["\n".join(prose(r, 20) for _ in range(5)) for _ in range(150)]
    bad = [prose(r, 6) + "\n" + "\n".join(junk(r) for _ in range(3)) for _ in range(150)]
    w = lines.train(good[:100] + bad[:100], [True] * 100 + [False] * 100)
    share = np.concatenate(list(lines.content_shares(pa.array(good[100:] + bad[100:]), w)))
    assert (share[:50] >= 0.5).all() and (share[50:] < 0.5).all()
    mixed = np.concatenate(list(lines.content_shares(pa.array([good[120] + "\n" + junk(r)[:40], "", " \n\n ", "x"]), w)))
    assert 0.5 < mixed[0] <= 1 and mixed[1] == mixed[2] == 0


def test_lines_in_odd_tables(spark, odd, make):
    labels = spark.createDataFrame([(3, 1), (4, 0)], "doc_id bigint, quality int")
    out = lines.keep_content(odd, labels)
    assert out.columns == ["doc_id", "content_share"] and out.where("doc_id in (1, 2)").count() == 0
    assert lines.keep_content(odd, labels.where("quality = 0")).where("content_share is null").count() == 7
    assert lines.keep_content(make([]), labels).count() == 0


def brute_viterbi(e, w):
    best = None
    for path in np.ndindex(*[e.shape[1]] * len(e)):
        s = w.first[path[0]] + w.last[path[-1]] + sum(e[i, y] for i, y in enumerate(path)) + sum(w.step[a, b] for a, b in zip(path, path[1:]))
        if best is None or s > best[0] + 1e-12:
            best = (s, path)
    return list(best[1])


def test_viterbi_and_gradient():
    rng = np.random.default_rng(0)
    w = crf.Weights(rng.normal(size=(6, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), rng.normal(size=3))
    bounds = np.array([0, 3, 3, 4, 9])
    active = rng.integers(0, 6, (9, 2))
    e = crf.emissions(active, w)
    got = crf.viterbi(e, bounds, w)
    for a, b in zip(bounds, bounds[1:]):
        if b > a:
            assert got[a:b].tolist() == brute_viterbi(e[a:b], w)
    y = rng.integers(0, 3, 9)
    value, g = crf.gradient(active, y, bounds, w)
    for part in range(4):
        for at in list(np.ndindex(w[part].shape))[:6]:
            moved = [x.copy() for x in w]
            moved[part][at] += 1e-6
            assert abs((crf.gradient(active, y, bounds, crf.Weights(*moved))[0] - value) / 1e-6 - g[part][at]) < 1e-3


# 6
def test_exponent_meets_its_target():
    tokens = [1000, 100, 10]
    a = mixing.exponent_for(tokens, target_entropy=0.9)
    w = mixing.tempered([t / sum(tokens) for t in tokens], a)
    assert 0 < a < 1 and abs(mixing.entropy(w) - 0.9 * math.log(3)) < 1e-9
    a = mixing.exponent_for(tokens, repeats=2.0)
    b = mixing.budgets(dict(enumerate(tokens)), repeats=2.0)
    assert 0 < a < 1 and b[0] == 1000 and max(b[i] / t for i, t in enumerate(tokens)) <= 2.05
    assert mixing.exponent_for([5], repeats=2.0) == 1.0 and mixing.exponent_for([0, 0], target_entropy=0.5) == 1.0
    assert mixing.budgets({"a": 0, None: 0}, repeats=2.0) == {"a": 0, None: 0}


def test_the_binding_limit_counts():
    b = mixing.budgets({"a": 10**9, "b": 10**9, "c": 50}, mixing.ENTROPY, mixing.LIMIT)
    assert b["a"] == b["b"] == 10**9 and 150 <= b["c"] <= 50 * mixing.LIMIT  # the entropy alone asks for ten million passes
    mild = {"a": 1000, "b": 900, "c": 500}
    assert mixing.budgets(mild, 0.98, 4.0) == mixing.budgets(mild, 0.98)
    for tokens in ([10**13, 10**13, 1000], [5, 1], [7, 7, 7], [10**6, 3, 2, 1]):
        for entropy, repeats in ((0.5, 3.0), (0.98, 4.0), (1.0, 2.0)):
            b = mixing.budgets(dict(enumerate(tokens)), entropy, repeats)
            assert all(t <= b[i] <= t * repeats + 1 for i, t in enumerate(tokens))


def test_tiny_sources_and_sources_that_are_no_strings(spark):
    rows = [(i, "w " * 50, 1) for i in range(200)] + [(1000, "one two", 2), (1001, "w " * 3000, 3)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source int")
    out = mixing.mix(d)
    assert dict(out.dtypes)["source"] == "int"
    passes = {r.source: r.n for r in out.groupBy("source").agg((F.max("mix_pass") + 1).alias("n")).collect()}
    assert passes[1] == 1 and passes[2] == mixing.LIMIT and passes[3] <= mixing.LIMIT
    plan = {r.source: r for r in mixing.plan(d).collect()}
    assert abs(sum(r.weight for r in plan.values()) - 1) < 1e-9 and plan["2"].repeats <= mixing.LIMIT + 0.5 and plan["1"].entropy < mixing.ENTROPY
    assert mixing.plan(d.where("false")).count() == 0


def test_mix_fills_budgets(spark):
    rows = [(i, "w " * (i % 7 + 1), "big" if i < 900 else "small" if i < 990 else None) for i in range(1000)] + [(2000, "", "big"), (2001, None, "big")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("extra", F.lit(1)).withColumn("mix_block", F.lit("x"))
    out = mixing.mix(d, None, 2.0)
    assert set(out.columns) == {"doc_id", "text", "source", "extra", "mix_pass", "mix_block", "mix_order"}
    got = out.withColumn("n", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.TOKENS))).groupBy("source").agg(F.sum("n").alias("n"), F.count_distinct("doc_id").alias("docs"), F.max("mix_pass").alias("p")).collect()
    got = {r.source: r for r in got}
    size = {s: sum(i % 7 + 1 for i, _, x in rows[:1000] if x == s) for s in ("big", "small", None)}
    budget = mixing.budgets(size, repeats=2.0)
    for s, r in got.items():
        assert budget[s] <= r.n < budget[s] + 8, s
    assert got["big"].docs == 902 and got["small"].docs == 90 and got[None].docs == 10 and got[None].p == 1
    # the same again, and in another order with another seed
    key = lambda df: sorted((r.doc_id, r.mix_pass, r.mix_order) for r in df.collect())
    assert key(out) == key(mixing.mix(d, None, 2.0)) != key(mixing.mix(d, None, 2.0, seed="other"))
    # passes follow each other, each a permutation
    order = [r.doc_id for r in out.where("source = 'small'").orderBy("mix_order").collect()]
    assert len(set(order[:90])) == 90 and order[:90] != sorted(order[:90])


def test_mix_of_odd_tables(odd, make):
    out = mixing.mix_rows(odd)
    assert out.columns == odd.columns and out.where("doc_id in (1, 2, 5)").count() >= 3 and out.where("doc_id is null").count() >= 1 and out.where("doc_id = 4").count() % 2 == 0
    assert mixing.mix_rows(make([])).count() == 0


# 9
def test_shards_by_weight_and_few_moves(spark):
    d = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    place = lambda w: {r.doc_id: r.shard for r in sharding.shard(d, w).collect()}
    a, b = place({0: 1, 1: 1, 2: 2}), place({0: 1, 1: 1, 2: 2, 3: 1})
    counts = np.bincount(list(a.values()))
    assert abs(counts / 20_000 - np.array([0.25, 0.25, 0.5])).max() < 0.02
    moved = [k for k in a if a[k] != b[k]]
    assert all(b[k] == 3 for k in moved) and abs(len(moved) / 20_000 - 0.2) < 0.02
    assert set(place({0: 1, 5: 0}).values()) == {0}
    with pytest.raises(ValueError):
        sharding.shard(d, {0: 0})


def test_shards_of_odd_tables(odd, make):
    out = sharding.shard(odd)
    assert out.columns == odd.columns and out.count() == 7 and out.where("shard is null").count() == 0
    assert out.where("doc_id = 4").select("shard").distinct().count() == 1
    per = out.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.count_distinct("shard").alias("n"))
    assert per.where("n > 1").count() == 0
    assert sharding.shard(make([])).count() == 0
