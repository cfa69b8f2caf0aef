import random
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from specloom.llm import kernel
from specloom.llm import ngram_join as nj
from specloom.llm.common import lacking
from tests_llm_util import edited, prose, word


def brute(texts, threshold):
    sets = []
    for t in texts:
        h, _ = kernel.shingles(kernel.words(pa.array([t])), nj.N)
        sets.append(set(h.tolist()))
    out = {}
    for i in range(len(sets)):
        for j in range(i + 1, len(sets)):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= threshold:
                out[i, j] = (both, len(sets[i] | sets[j]))
    return out, sets


def expand(pairs, sets):
    """Pairs of documents from pairs of classes."""
    members = {}
    for i, s in enumerate(sets):
        members.setdefault(frozenset(s), []).append(i)
    of = {m[0]: m for m in members.values()}
    out = set()
    for a, b in pairs:
        if sets[a] == sets[b]:
            m = members[frozenset(sets[a])]
            out |= {(x, y) for x in m for y in m if x < y}
        else:
            out |= {(min(x, y), max(x, y)) for x in of[a] for y in of[b]}
    return out


def test_against_brute_force(spark, make):
    r = random.Random(3)
    texts = []
    passage = prose(r, 60)
    for _ in range(40):
        base = prose(r, r.choice([8, 30, 80, 200]))
        texts.append(base)
        for _ in range(r.choice([0, 0, 1, 3])):
            texts.append(edited(r, base, r.choice([0.0, 0.02, 0.05, 0.1, 0.15, 0.2])))
        if r.random() < 0.4:  # a passage that many share isn't likeness
            texts.append(prose(r, 150) + " " + passage)
    texts += ["", "one", "one", "two words", "two words", "three"]
    want, sets = brute(texts, nj.THRESHOLD)
    got = {(x.a, x.b): (x.both, x.either) for x in nj.jaccard_pairs(make(texts)).collect()}
    assert all(want[p] == v for p, v in got.items())
    found = expand(got, sets)
    assert found <= set(want)
    assert len(found) >= 0.97 * len(want) and len(want) > 30


def test_exact_and_all_pairs(spark, make):
    r = random.Random(5)
    texts = []
    for _ in range(25):
        base = prose(r, r.choice([8, 30, 80, 200]))
        texts += [edited(r, base, r.choice([0.0, 0.03, 0.08, 0.12, 0.2])) for _ in range(r.choice([1, 2, 4]))]
    texts += ["one", "one", "two words", "two words", texts[0], texts[0]]
    want, sets = brute(texts, nj.THRESHOLD)
    got = {(x.a, x.b): (x.both, x.either) for x in nj.jaccard_pairs(make(texts), all_pairs=True, exact=True).collect()}
    assert got == want and any(sets[a] == sets[b] for a, b in want)
    # enough of the pairs to connect the same documents
    spanning = [(x.a, x.b) for x in nj.jaccard_pairs(make(texts), exact=True, spanning=True).collect()]
    assert set(spanning) <= set(want) and len(spanning) < len(want)
    assert connected(spanning) == connected(want)


def connected(pairs):
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(top(a), top(b))] = min(top(a), top(b))
    return {x: top(x) for x in root}


def test_large_sets_are_grouped_by_size(spark, make, monkeypatch):
    monkeypatch.setattr(nj, "LARGE", 16)
    r = random.Random(15)
    texts = []
    for _ in range(12):
        base = prose(r, r.choice([20, 60, 150, 300]))
        texts += [edited(r, base, 0.02), " ".join(base.split()[: r.choice([20, 200])]), base]
    want, sets = brute(texts, nj.THRESHOLD)
    got = {(x.a, x.b): (x.both, x.either) for x in nj.jaccard_pairs(make(texts), exact=True).collect()}
    assert expand(got, sets) == set(want)


def test_odd_tables(spark, make):
    assert nj.jaccard_pairs(make([])).count() == 0
    t = "a quick brown fox jumps over the lazy dog"
    d = make([(1, t), (1, t), (2, t), (None, t), (3, None), (4, ""), (5, "..."), (6, "x " * 30_000)])
    d = d.withColumn("token", F.lit("clash")).withColumn("a", F.lit(1)).withColumn("g", F.lit("g"))
    assert [(x.a, x.b) for x in nj.jaccard_pairs(d).collect()] == [(1, 2)]
    kept = nj.keep_one(d)
    assert kept.columns == d.columns
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(["1", "1", "None", "3", "4", "5", "6"])


def test_ids_of_several_texts(spark, make):
    r = random.Random(11)
    near = lambda t, n: " ".join([*t.split()[:-n], *(word(r) for _ in range(n))])
    docs, bases = [], [prose(r, 60 + 7 * k) for k in range(12)]
    for k, t in enumerate(bases):  # every id also has a text of its own, before or after the one that another id has nearly
        own = [(100 + k, prose(r, 90 + 11 * k)), (100 + k, near(t, 6))]
        docs += [(k, t), *(own if k % 2 else own[::-1])]
    docs += [(300, bases[0]), (300, prose(r, 300)), (301, near(bases[0], 4))]  # a class's text at an id of another class
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    want = sorted(c.execute(nj._SQL).fetchall())
    for rows in (docs, docs[::-1], docs + docs):
        assert sorted((x.a, x.b, x.both, x.either) for x in nj.jaccard_pairs(make(rows)).collect()) == want
    assert {(k, 100 + k) for k in range(12)} <= {x[:2] for x in want}
    assert {100 + k for k in range(12)}.isdisjoint(x.doc_id for x in nj.keep_one(make(docs)).collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (200, 201)]
    got = {x.doc: x.keeper for x in nj.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100, 201: 200}


def test_large_group_is_split_and_all_pairs_are_found(spark, make, monkeypatch):
    monkeypatch.setattr(nj, "GROUP", 5)
    monkeypatch.setattr(nj, "CELLS", 100)  # the sparse way
    r = random.Random(8)
    base = prose(r, 120)
    texts = [edited(r, base, 0.02) for _ in range(25)]
    want, sets = brute(texts, nj.THRESHOLD)
    got = {(x.a, x.b): (x.both, x.either) for x in nj.jaccard_pairs(make(texts)).collect()}
    assert expand(got, sets) == set(want)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    a, b = x[:2000], x[1000:]
    s = nj.sketch(np.concatenate([a, b]), np.array([0, 2000, 4000]))
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.2


def linked(docs, spark_docs):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in nj.links(spark_docs).collect())
    assert got == sorted(c.execute(nj._LINKS_SQL).fetchall())
    return {x[0]: x[1:] for x in got}


def test_no_link_is_lost_that_sketches_lose(spark, make):
    r = random.Random(1)
    pairs = []
    while len(pairs) < 3:  # at the threshold, with fewer common min-hashes than candidates need
        w = [word(r) + str(i) for i in range(122)]
        a, b = " ".join(w[:92]), " ".join(w[30:])
        h, bounds = kernel.distinct(*kernel.shingles(kernel.words(pa.array([a, b])), nj.N))
        s = nj.sketch(h, bounds)
        assert len(set(h.tolist())) == 120 and len(h) == 180
        if (s[0] == s[1]).sum() < nj.least_overlap():
            pairs.append((a, b))
    texts = [t for p in pairs for t in p] + [prose(r, 80) for _ in range(5)]
    assert linked(list(enumerate(texts)), make(texts)) == {**{i: (i - i % 2, 1) for i in range(6)}, **{i: (i, 0) for i in range(6, 11)}}


def test_links_of_copies_and_of_ids_with_several_texts(spark, make, monkeypatch):
    monkeypatch.setattr(nj, "RANGE", 1 << 10)  # many ranges of hashes
    r = random.Random(21)
    t, u = prose(r, 60), prose(r, 90)
    near = edited(r, t, 0.05)
    docs = [(1, t), (5, t), (1, near), (7, near), (1, t), (8, u), (8, prose(r, 50)), (9, edited(r, u, 0.05)), (9, u), (10, prose(r, 70)), (11, ""), (12, None), (None, t), (13, "one"), (14, "One!")]
    got = linked(docs, make(docs))
    # 1 has 5 and 7 as links of either text, and no links to itself
    assert got[1] == (1, 4) and got[5] == (1, 3) and got[7] == (1, 3) and got[8] == (8, 2) and got[10] == (10, 0) and got[11] == (11, 0) and got[12] == (12, 0) and got[14] == (13, 1)
    pairs = {(x.a, x.b) for x in nj.jaccard_pairs(make(docs), all_pairs=True, exact=True).collect()}
    assert pairs == {(1, 5), (1, 7), (5, 7), (8, 9), (13, 14)}


def test_links_against_the_plain_join(spark, make, monkeypatch):
    monkeypatch.setattr(nj, "RANGE", 1 << 12)
    monkeypatch.setattr(nj, "GROUP", 5)
    r = random.Random(22)
    texts, passage = [], prose(r, 40)
    for _ in range(40):
        base = prose(r, r.choice([1, 3, 5, 12, 40, 120, 300]))
        texts += [base, *(edited(r, base, r.choice([0, 0.01, 0.05, 0.1, 0.13, 0.2])) for _ in range(r.choice([0, 1, 2, 6])))]
        texts += [prose(r, r.choice([20, 60, 150])) + " " + passage] * (r.random() < 0.4)
    got = linked(list(enumerate(texts)), make(texts))
    assert sum(n for _, n in got.values()) > 100


def peak_mb(run):
    """Result, and the most MB that Python and numpy held besides what was there."""
    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, peak


def opened_group(members, queries):
    rows = [(False, c, t) for c, t in members] + [(True, c, t) for c, t in queries]
    sets, n = [np.sort(t).view(np.int64) for *_, t in rows], [len(t) for *_, t in rows]
    cid = pa.array([c for _, c, _ in rows], pa.int64())
    ts = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate(sets)))
    return pa.record_batch({"g": pa.array(np.zeros(len(rows), np.int64)), "is_query": pa.array([q for q, _, _ in rows]), "cid": cid, "doc": cid, "n": pa.array(n, pa.int32()), "least": pa.array([-(-k // 2) for k in n], pa.int32()), "ts": ts})


def test_opened_group_is_compared_in_little_memory():
    rng = np.random.default_rng(4)
    tokens = rng.integers(0, 2**63, 40, dtype=np.uint64)
    group = opened_group([(1000 + i, tokens) for i in range(nj.GROUP)], [(i, tokens) for i in range(900)] + [(900 + i, tokens[:1]) for i in range(50)])
    pairs, peak = peak_mb(lambda: sum(b.num_rows for b in nj._open(nj.THRESHOLD, True)(iter([group]))))
    assert pairs == nj.GROUP * (nj.GROUP - 1) // 2 + 900 * nj.GROUP
    assert peak < 50


def test_opened_group_in_slices(monkeypatch):
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    some = lambda: rng.choice(pool, rng.integers(1, 50), replace=False)
    members, queries = [(100 + i, some()) for i in range(30)], [(i, some()) for i in range(80)]
    want = set()
    for q, x in members + queries:
        for c, y in members:
            both, either = len(set(x) & set(y)), len(set(x) | set(y))
            if q < c and both / either >= nj.THRESHOLD:
                want.add((q, c, both, either))
    for held in (nj.HELD, 50, 1):
        monkeypatch.setattr(nj, "HELD", held)
        got = [tuple(r.values())[1:] for b in nj._open(nj.THRESHOLD, True)(iter([opened_group(members, queries)])) for r in b.to_pylist()]
        assert set(got) == want and len(got) == len(want) > 50


def test_ranges_of_a_batch_take_little_memory(monkeypatch):
    monkeypatch.setattr(nj, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(map(str, rng.integers(0, 10**5, 700).tolist())) for _ in range(2000)])
    batch = pa.record_batch({"doc_id": pa.array(np.arange(2000)), "text": texts})
    parts, peak = peak_mb(lambda: list(nj._ranges(64)(iter([batch]))))
    assert sum(len(x) for x in parts[0]["what"].to_pylist()[:-1]) == 4 * sum(len(h) for _, h, _ in nj.sets(texts))
    assert peak < 60


def test_key_filter_needs_no_python_worker(spark):
    d = spark.createDataFrame([(i, str(i)) for i in range(3000)] + [(None, "none")], "k bigint, v string")
    keys = spark.range(0, 3000, 7).selectExpr("id as k").checkpoint()
    rest = lacking(d, keys, "k")
    assert "Python" not in rest._jdf.queryExecution().executedPlan().toString()
    assert sorted(str(r.k) for r in rest.collect()) == sorted([str(i) for i in range(3000) if i % 7] + ["None"])


def test_sets_go_to_opened_groups_in_small_batches():
    rng = np.random.default_rng(7)
    text = " ".join(map(str, rng.integers(0, 10**6, 20_000).tolist()))
    (_, h, _), = nj.sets(pa.array([text]))
    own = int(h.sum(dtype=np.uint64).view(np.int64))
    targets = [{"set_hash": own, "g": g, "is_query": g % 2 == 0, "cid": 5, "doc": 1, "wanted": [g]} for g in range(200)]
    kind = pa.list_(pa.struct([("set_hash", pa.int64()), ("g", pa.int64()), ("is_query", pa.bool_()), ("cid", pa.int64()), ("doc", pa.int64()), ("wanted", pa.list_(pa.int64()))]))
    batch = pa.record_batch({"text": pa.array([text]), "targets": pa.array([targets], kind)})
    rows, most = [], 0
    for b in nj._blobs(iter([batch])):
        most = max(most, b.nbytes)
        rows += [(r["g"], r["wanted"], len(r["grams"])) for r in b.to_pylist()]
    assert rows == [(g, [g], 8 * len(h)) for g in range(200)]
    assert most < 8e6


def test_verification_takes_little_memory():
    rng = np.random.default_rng(8)
    vocabulary = np.sort(rng.integers(0, 2**63, 16_000, dtype=np.uint64))
    sets = [np.sort(rng.choice(vocabulary, 12_000, replace=False)) for _ in range(500)]
    rows = [(False, 1000 + i, x, []) for i, x in enumerate(sets)] + [(True, i, sets[i], [1000 + j for j in range(500)]) for i in range(3)]
    cid = pa.array([r[1] for r in rows], pa.int64())
    batch = pa.record_batch({"g": pa.array(np.zeros(len(rows), np.int64)), "is_query": pa.array([r[0] for r in rows]), "cid": cid, "doc": cid, "grams": pa.array([r[2].tobytes() for r in rows], pa.binary()), "wanted": pa.array([r[3] for r in rows], pa.list_(pa.int64()))})
    del rows
    out, peak = peak_mb(lambda: [r for b in nj._verify(nj.THRESHOLD, False)(iter([batch])) for r in b.to_pylist()])
    assert len(out) == 3 * 500
    for i in range(3):
        for j in (0, 1, i, 499):
            both = len(np.intersect1d(sets[i], sets[j]))
            assert {"a": i, "b": 1000 + j, "both": both, "either": 24_000 - both, "ca": i, "cb": 1000 + j} in out
    assert peak < 250
