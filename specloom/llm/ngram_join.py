"""Operator 3, n-gram Jaccard join by a token-group matrix.

Every text is its set of word n-grams; the tokens of the matrix are the set's ``TOKENS`` min-hashes, a sketch in
which two sets agree on a token with the probability of their Jaccard similarity, or (``exact``) the n-grams
themselves. Documents are partitioned into groups by a frequent token among their rare ones, which near copies share.
The matrix holds every group's token union. A query's overlap with a union bounds its overlap with each member, so
only groups that reach the least overlap are opened. Members that reach it too are verified on the whole n-gram sets,
exactly.

Candidates come from rare tokens alone: with tokens ordered by frequency, two token sets that agree on ``least``
tokens share one of the ``size - least + 1`` rarest of either. Tokens of passages that many documents share are thus
last in the order and join nothing, unless a text is made of little else.

With the n-grams as tokens a text can only have partners if the share ``threshold`` of its n-grams occurs in other texts
too. That is counted before anything else, in ranges of the hashes, and texts that don't reach it go no further.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import discard, lacking, parted, pick, ready, scratch, trimmed
from specloom.llm.kernel import U, as_string, chunks, distinct, mix, shingles, words
from specloom.session import table

N = 3
THRESHOLD = 0.5
TOKENS = 64
#: Standard deviations below the expected overlap at the threshold that a candidate may have: recall 99.8 % there.
SLACK = 3.0
#: Members of a group at most, on average; a larger one is split by hash. Sets of over ``LARGE`` n-grams are grouped by
#: their size, proportionally fewer in a group, so that a task holds at most about ``GROUP * LARGE`` n-grams of members.
GROUP, LARGE = 512, 1 << 12
#: Tokens of the prefixes that a query shares with a group's members at least, if n-grams are tokens; prefixes are longer by as many less one.
SHARED = 4
#: Bytes of text for each range of hashes in which n-grams are counted: about a million n-grams of eight bytes.
RANGE = 8 << 20
#: Tokens of queries that are compared with an opened group at once.
QUERY_TOKENS = 1 << 14
#: n-grams of the sets that are compared at once in an opened group.
CELLS = 1 << 23
#: Pairs of a query and a member, or of a query's token and a member, that a worker holds at once; more are counted in slices.
HELD = 1 << 18
#: Bytes of n-gram sets in a batch that goes to opened groups.
SENT = 1 << 22

_SEEDS = np.random.default_rng(7).integers(0, 2**63, TOKENS, dtype=U) * U(2) + U(1)


def least_overlap(threshold: float = THRESHOLD) -> int:
    """Tokens on which a candidate must agree."""
    return max(1, math.floor(TOKENS * threshold - SLACK * math.sqrt(TOKENS * threshold * (1 - threshold))))


def sketch(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-hash tokens of every set, a row each; the lowest six bits say which of the ``TOKENS`` it is."""
    at = bounds[:-1]
    out = np.empty((len(at), TOKENS), U)
    for i, seed in enumerate(_SEEDS):
        out[:, i] = np.minimum.reduceat((h ^ (h >> U(29))) * seed, at)
    return (mix(out ^ _SEEDS) & ~U(63)) | np.arange(TOKENS, dtype=U)


def sets(arr: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, hashes and bounds of the n-gram sets of every chunk of texts."""
    for at, part in chunks(as_string(arr)):
        yield at, *distinct(*shingles(words(part), N))


def _postings(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all sets, sorted; the numbers of the sets that have them, hash by hash; and each hash's range of these."""
    flat = np.concatenate(sets).view(U)
    by = np.argsort(flat)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])[by]
    flat = flat[by]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    return flat[first], row, np.append(first, len(flat))


def _ranges(number: int):
    """n-grams of each batch of texts by range of their hashes, 32 bits of each and its text's place; and the batch's ids and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 33
        width = (1 << 64) // number + 1
        parts = (b.slice(at, 1 << 16) for b in batches for at in range(0, b.num_rows, 1 << 16))
        for src, batch in enumerate(parts, task):
            found, size = [], np.zeros(0, np.int64)
            for _, h, bounds in sets(batch["text"]):  # no chunk's whole hashes stay
                many = np.diff(bounds)
                g = h // U(width)
                # of a range's hashes, those of 32 bits; equal hashes stay equal, and few others become so
                low = ((h - g * U(width)) >> U(max(0, (width - 1).bit_length() - 32))).astype(np.uint32)
                at = np.repeat(np.arange(len(size), len(size) + len(many)).astype(np.uint16), many)
                found.append((g.astype(np.uint16 if number <= 1 << 16 else np.int64), low, at))
                size = np.append(size, many)
            g, low, at = (np.concatenate(x) for x in zip(*found))
            del found
            by = np.argsort(g, kind="stable")
            low, at, ends = low[by], at[by], np.searchsorted(g[by], np.arange(number + 1))
            del by, g
            some = np.flatnonzero(np.diff(ends))
            ids = batch["doc_id"].to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                {
                    "g": pa.array(np.append(some, src % number), pa.int64()),
                    "src": pa.array(np.full(len(some) + 1, src), pa.int64()),
                    "is_ids": pa.array(np.append(np.zeros(len(some), bool), True)),
                    "what": pa.array([*(low[ends[i] : ends[i + 1]].tobytes() for i in some), ids.astype(np.int64).tobytes()], pa.binary()),
                    "of": pa.array([*(at[ends[i] : ends[i + 1]].tobytes() for i in some), size.astype(np.int64).tobytes()], pa.binary()),
                }
            )

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range and batch of texts, the texts with n-grams that others have too, and how many; rows of ids pass."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(b["g"].to_pylist(), b["src"].to_pylist(), b["is_ids"].to_pylist(), b["what"], b["of"])

    def record(out: list[tuple]) -> pa.RecordBatch:
        src, is_ids, what, of = zip(*out)
        return pa.record_batch({"src": pa.array(src, pa.int64()), "is_ids": pa.array(is_ids), "what": pa.array(what, pa.binary()), "of": pa.array(of, pa.binary())})

    for _, part in itertools.groupby(rows(), lambda r: r[0]):
        part = list(part)
        out = [(src, True, what.as_py(), of.as_py()) for _, src, is_ids, what, of in part if is_ids]
        part = [(src, np.frombuffer(what.as_buffer(), np.uint32), np.frombuffer(of.as_buffer(), np.uint16)) for _, src, is_ids, what, of in part if not is_ids]
        if part:
            low = np.concatenate([x for _, x, _ in part])
            by = np.argsort(low)
            low = low[by]
            same = low[1:] == low[:-1]
            twice = np.zeros(len(low), bool)
            twice[by[1:][same]] = True
            twice[by[:-1][same]] = True
            end = 0
            for src, x, of in part:
                at, many = np.unique(of[twice[end : end + len(x)]], return_counts=True)
                end += len(x)
                if len(at):
                    out.append((src, False, many.astype(np.uint32).tobytes(), at.tobytes()))
        if out:
            yield record(out)


def _live(threshold: float):
    """Ids of texts that share enough of their n-grams with any others; rows come sorted by batch of texts, ids first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(b["src"].to_pylist(), b["what"], b["of"]))
        for _, part in itertools.groupby(rows, lambda r: r[0]):
            _, ids, size = next(part)
            ids, size = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, size))
            shared = np.zeros(len(ids), np.int64)
            for _, many, at in part:
                shared[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(many.as_buffer(), np.uint32)
            yield pa.record_batch({"doc_id": pa.array(ids[(size > 0) & (shared >= threshold * size - 1e-9)])})

    return run


def with_partners(d: DataFrame, threshold: float) -> DataFrame:
    """``d`` without texts that can't reach ``threshold`` with any other, as too few of their n-grams occur elsewhere; some of these stay."""
    taken = d.select(F.sum(F.octet_length("text").cast("bigint"))).head()[0] or 0
    live = (
        d.mapInArrow(trimmed(_ranges(max(2, taken // RANGE))), "g long, src long, is_ids boolean, what binary, of binary")
        .repartition("g").sortWithinPartitions("g")
        .mapInArrow(trimmed(_repeated), "src long, is_ids boolean, what binary, of binary")
        .repartition("src").sortWithinPartitions("src", F.desc("is_ids"))
        .mapInArrow(trimmed(_live(threshold)), "doc_id long")
    ).checkpoint()
    return parted(d, live, "doc_id")[0]


def _sketches(threshold: float, exact: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, h, bounds in sets(batch["text"]):
                size = np.diff(bounds)
                live = np.flatnonzero(size)
                if not len(live):
                    continue
                size = size[live]
                tight = np.concatenate([[0], np.cumsum(size)])
                folded = np.zeros(len(live), U)
                np.add.at(folded, np.repeat(np.arange(len(live)), size), mix(h ^ U(0x5BD1E995)))
                tokens, ends = (h, tight) if exact else (sketch(h, tight).ravel(), np.arange(len(live) + 1) * TOKENS)
                least = np.ceil(threshold * size - 1e-9) if exact else np.full(len(live), least_overlap(threshold))
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].take(pa.array(live + at)),
                        "n": pa.array(size, pa.int32()),
                        "set_hash": pa.array(np.add.reduceat(h, tight[:-1]).view(np.int64)),
                        "set_hash2": pa.array(folded.view(np.int64)),
                        "least": pa.array(least.astype(np.int32)),
                        "tokens": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens.view(np.int64))),
                    }
                )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple], Iterator[tuple]]]:
    """Group, its members, and its queries one by one; rows come sorted by group, members first."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            lists = [batch[c] if pa.types.is_list(batch[c].type) or pa.types.is_binary(batch[c].type) else batch[c].to_pylist() for c in columns]
            yield from zip(batch["g"].to_pylist(), batch["is_query"].to_pylist(), *lists)

    for g, part in itertools.groupby(rows(), lambda r: r[0]):
        members: list[tuple] = []
        first = None
        for r in part:
            if r[1]:
                first = r
                break
            members.append(r[2:])
        yield g, members, (r[2:] for r in itertools.chain([first] if first else [], part))


def _open(threshold: float, exact: bool):
    """Candidate pairs of every group: members, and queries whose overlap with the group's union reaches their least.

    If ``exact``, tokens are n-grams, so that overlaps are those of the sets, and only pairs that reach ``threshold`` stay.
    """

    def compare(g: int, union: np.ndarray, posting: np.ndarray, at: np.ndarray, m: list[np.ndarray], q: list[tuple]) -> pa.RecordBatch | None:
        tokens = [np.asarray(x[4].values) for x in q]
        cid, _, n, least = (np.array([x[i] for x in q]) for i in range(4))
        flat = np.concatenate(tokens).view(U)
        row = np.repeat(np.arange(len(q)), [len(t) for t in tokens])
        slot = np.minimum(np.searchsorted(union, flat), len(union) - 1)
        hit = union[slot] == flat
        opened = np.bincount(row[hit], minlength=len(q)) >= least
        hit &= opened[row]
        slot, row = slot[hit], row[hit]
        many = at[slot + 1] - at[slot]
        total, both, begin = np.cumsum(many), np.zeros((len(q), len(m[0])), np.int64), 0
        while begin < len(slot):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] - many[begin] + HELD, "right")))
            s, k, top, last = slot[begin:end], many[begin:end], row[begin], row[end - 1] + 1
            member = posting[np.repeat(at[s] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())]
            both[top:last] += np.bincount(np.repeat(row[begin:end] - top, k) * len(m[0]) + member, minlength=(last - top) * len(m[0])).reshape(last - top, -1)
            begin = end
        ok = (both >= np.maximum(least[:, None], m[3])) & (cid[:, None] < m[0]) & (np.minimum(n[:, None], m[2]) >= threshold * np.maximum(n[:, None], m[2]) - 1e-9)
        either = n[:, None] + m[2] - both
        if exact:
            ok &= both / either >= threshold
        qi, mi = np.nonzero(ok)
        columns = {"g": np.full(len(qi), g), "q": cid[qi], "c": m[0][mi], "both": both[qi, mi], "either": either[qi, mi]}
        return pa.record_batch({k: pa.array(x, pa.int64()) for k, x in columns.items()}) if len(qi) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, members, queries in _grouped(batches, ("cid", "doc", "n", "least", "ts")):
            if not members:
                continue
            union, posting, at = _postings([np.asarray(x[4].values) for x in members])
            m = [np.array([x[i] for x in members]) for i in range(4)]
            held, some = 0, []
            for x in itertools.chain(members, queries):  # members are queries of their own group
                some.append(x)
                held += len(x[4].values)
                if held >= QUERY_TOKENS or len(some) * len(members) >= HELD:
                    out = compare(g, union, posting, at, m, some)
                    held, some = 0, []
                    if out is not None:
                        yield out
            out = compare(g, union, posting, at, m, some) if some else None
            if out is not None:
                yield out

    return run


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each group that a text goes to, with its n-gram set."""

    def record(out: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch(
            {
                **{c: pa.array([t[c] for t, _ in out], kind) for c, kind in (("g", pa.int64()), ("is_query", pa.bool_()), ("cid", pa.int64()), ("doc", pa.int64()), ("wanted", pa.list_(pa.int64())))},
                "grams": pa.array([x for _, x in out], pa.binary()),
            }
        )

    for batch in batches:
        for at, h, bounds in sets(batch["text"]):
            raw = h.tobytes()
            total = np.concatenate([[U(0)], np.cumsum(h)])
            own = (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64).tolist()
            out, held = [], 0
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                grams = raw[a * 8 : b * 8]  # one for all groups that the text goes to
                for t in batch["targets"][at + i].as_py():
                    if t["set_hash"] == own[i]:
                        out.append((t, grams))
                        held += len(grams)
                        if held >= SENT:
                            yield record(out)
                            out, held = [], 0
            if out:
                yield record(out)


def _verify(threshold: float, spanning: bool):
    """Exact Jaccard similarity of the candidate pairs of every opened group; if ``spanning``, only pairs that connect what others of the group don't."""

    def one(members: list[tuple], queries: list[tuple], root: dict[int, int]) -> Iterator[tuple]:
        """``members``: class, document, n-grams; ``queries``: those and the classes wanted."""
        held = {c: (doc, g) for c, doc, g in members}
        ids, grams = {c: i for i, c in enumerate(held)}, [g for _, g in held.values()]
        docs = [doc for doc, _ in held.values()]
        vocabulary, posting, first = _postings(grams)
        size = np.array([len(g) for g in grams])
        if len(ids) * len(vocabulary) <= CELLS:
            matrix = np.zeros((len(ids), len(vocabulary)), np.uint8)
            matrix[posting, np.repeat(np.arange(len(vocabulary)), np.diff(first))] = 1
        else:
            matrix = None

        def top(c: int) -> int:
            while root.setdefault(c, c) != c:
                root[c] = c = root[root[c]]
            return c

        for q, doc, g, wanted in queries:
            wanted_held = [c for c in wanted if c in ids]
            to = np.array([ids[c] for c in wanted_held], int)
            slot = np.minimum(np.searchsorted(vocabulary, g), len(vocabulary) - 1)
            slot = slot[vocabulary[slot] == g]
            if matrix is not None:
                both = matrix[to][:, slot].sum(1, dtype=np.int64) if len(to) < 8 else matrix[:, slot].sum(1, dtype=np.int64)[to]
            else:
                both = np.bincount(np.concatenate([posting[a:b] for a, b in zip(first[slot], first[slot + 1])] or [np.zeros(0, int)]), minlength=len(ids))[to]
            either = len(g) + size[to] - both
            for i in np.flatnonzero(both / either >= threshold):
                if spanning:
                    x, y = top(q), top(wanted_held[i])
                    if x == y:
                        continue
                    root[x] = y
                yield doc, docs[to[i]], int(both[i]), int(either[i]), q, wanted_held[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush(limit: int = 0) -> Iterator[pa.RecordBatch]:
            if len(out) > limit:
                columns = [pa.array(x, pa.int64()) for x in zip(*out)]
                out.clear()
                yield pa.record_batch(columns, ["a", "b", "both", "either", "ca", "cb"])

        for _, members, queries in _grouped(batches, ("cid", "doc", "grams", "wanted")):
            m = [(cid, doc, np.frombuffer(grams.as_buffer(), U)) for cid, doc, grams, _ in members]
            root: dict[int, int] = {}
            while m and (some := [(cid, doc, np.frombuffer(grams.as_buffer(), U), wanted.as_py()) for cid, doc, grams, wanted in itertools.islice(queries, 256)]):
                out += one(m, some, root)
                yield from flush(1 << 16)
        yield from flush()

    return run


def _found(docs: DataFrame, threshold: float, exact: bool, spanning: bool) -> tuple[DataFrame, DataFrame]:
    """Pairs of classes ``ca``, ``cb`` with the smallest document ``a``, ``b`` of either; and the rows of each class but its first, ``rep``."""
    spark = ready(docs)
    folder = scratch(spark)
    shared = SHARED if exact else 1
    d = pick(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    kept = (with_partners(d, threshold) if exact else d).mapInArrow(trimmed(_sketches(threshold, exact)), "doc_id long, n int, set_hash long, set_hash2 long, least int, tokens array<long>")
    kept.withColumn("cid", F.monotonically_increasing_id()).write.parquet(folder)
    sketches = spark.read.parquet(folder)
    same = ("n", "set_hash", "set_hash2")
    # a class is known by the row of its smallest id
    classes = sketches.groupBy(*same).agg(F.min(F.struct("doc_id", "cid")).alias("rep"), F.count("*").alias("rows"))
    several = classes.where("rows > 1").select(*same, "rep").checkpoint()
    twice = parted(sketches, several.select("set_hash"), "set_hash")[0].select("doc_id", "cid", *same).join(several, [*same])
    others = twice.where("cid <> rep.cid").select("doc_id", "cid", "rep", "n").checkpoint()
    own = lacking(sketches, others.select("cid"), "cid")

    # tokens that at least two classes have, with the number that do
    df = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df > 1").checkpoint()
    held = own.select("cid", F.explode("tokens").alias("token"))
    common = parted(held, df.select("token"), "token")[0].join(df, "token")
    # rarest first, tokens of one class alone before all of them
    listed = common.groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    facts = own.select("cid", F.col("doc_id").alias("doc"), "n", "least", "set_hash")
    ranked = (
        listed.join(facts, "cid").withColumn("prefix", F.expr(f"if(size(t) < least, slice(t, 1, 0), slice(t, 1, size(t) - least + least(least, {shared})))")).where("size(prefix) > 0")
        # of the prefix's tokens that are about as frequent as its most frequent one, near copies agree on the largest hash
        .withColumn("key", F.expr("array_max(transform(prefix, x -> struct(floor(log2(x.df)) as level, xxhash64(x.token) as h, x.token as token, x.df as df)))"))
        .withColumn("level", F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / LARGE))).cast("int"))
        .withColumn("part", F.expr(f"pmod(xxhash64(cid), ceil(key.df / greatest(1, shiftright({GROUP}, least(level, 30)))))"))
        .select("cid", "doc", "n", "least", "set_hash", F.col("t.token").alias("ts"), F.col("prefix.token").alias("prefix"), F.xxhash64("key.token", "level", "part").alias("g"))
    ).checkpoint()
    # the matrix's entries for rare tokens, with the bounds of the members that have them
    inside = ranked.select("g", "cid", "n", "least", F.explode("prefix").alias("token"))
    entry = inside.groupBy("token", "g").agg(F.max("cid").alias("top"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("least").alias("ease"))
    hits = (
        inside.withColumnRenamed("g", "home").join(entry, "token")
        .where(f"g <> home and cid < top and high >= {threshold} * n - 1e-9 and n >= {threshold} * low - 1e-9")
        .groupBy("cid", "g").agg(F.count("*").alias("many"), F.min(F.least("least", "ease", F.lit(shared))).alias("need")).where("many >= need")
        .select("cid", "g")
    )
    member = ranked.select("g", F.lit(False).alias("is_query"), "cid", "doc", "n", "least", "ts")
    query = hits.join(ranked.select("cid", "doc", "n", "least", "ts"), "cid").select("g", F.lit(True).alias("is_query"), "cid", "doc", "n", "least", "ts")
    opened = member.unionByName(query).repartition("g").sortWithinPartitions("g", "is_query", "cid").mapInArrow(trimmed(_open(threshold, exact)), "g long, q long, c long, both long, either long")
    if exact and not spanning:
        ids = sketches.select("cid", "doc_id")
        close = opened.select(F.col("q").alias("ca"), F.col("c").alias("cb"), "both", "either")
        for side, name in (("ca", "a"), ("cb", "b")):
            close = close.join(ids.toDF(side, name), side)
        found = close.checkpoint()
        discard(spark, folder)
        return found, others
    close = opened.groupBy("g", "q").agg(F.collect_list("c").alias("wanted")).checkpoint()
    wanted = close.select("g", F.explode("wanted").alias("cid")).distinct()
    rows = wanted.select("g", F.lit(False).alias("is_query"), "cid", F.array().cast("array<bigint>").alias("wanted")).unionByName(close.select("g", F.lit(True).alias("is_query"), F.col("q").alias("cid"), "wanted"))
    targets = (
        rows.join(ranked.select("cid", "doc", "set_hash"), "cid")
        .groupBy("doc").agg(F.collect_list(F.struct("set_hash", "g", "is_query", "cid", "doc", "wanted")).alias("targets"))
    ).checkpoint()
    discard(spark, folder)
    found = (
        parted(d, targets.select("doc"), "doc_id")[0].join(targets, d["doc_id"] == targets["doc"]).select("text", "targets")
        .mapInArrow(trimmed(_blobs), "g long, is_query boolean, cid long, doc long, wanted array<long>, grams binary")
        .repartition("g").sortWithinPartitions("g", "is_query", "cid")
        .mapInArrow(trimmed(_verify(threshold, spanning)), "a long, b long, both long, either long, ca long, cb long")
    )
    return found, others


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, all_pairs: bool = False, exact: bool = False, spanning: bool = False) -> DataFrame:
    """Pairs ``a < b`` of document ids with Jaccard similarity of at least ``threshold``, as ``both / either`` n-grams.

    Documents of the same n-gram set are a class: its smallest id stands for it in pairs with other classes, and is
    paired with every other id of the class. The pairs of all documents are the pairs of classes times their members;
    ``all_pairs`` gives these, also those of two classes with the same smallest id. ``exact`` takes the n-grams as tokens, so that no candidate is lost, for several times
    the work. ``spanning`` gives only enough pairs to connect all documents that the pairs connect.

    Rows with a NULL id and texts without words (NULL, empty) have no pairs; a text of fewer than n words is one
    n-gram. Repeated rows of an id count as one document, with a set of its own for each different text. Every
    document is a query. An empty table gives no pairs.
    """
    found, others = _found(docs, threshold, exact, spanning)
    if all_pairs:
        found = _members(found, others)
    else:
        copies = others.where("doc_id <> rep.doc_id").select(F.col("rep.doc_id").alias("a"), F.col("doc_id").alias("b"), F.col("n").cast("long").alias("both"), F.col("n").cast("long").alias("either"))
        found = found.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", "either").unionByName(copies)
    return found.groupBy("a", "b").agg(F.max(F.struct(F.col("both") / F.col("either"), "both", "either")).alias("m")).select("a", "b", "m.both", "m.either")


def _members(pairs: DataFrame, others: DataFrame) -> DataFrame:
    """Pairs of all documents from those of classes; ``others`` are the rows of each class but its first, ``rep``."""
    more = others.select(F.col("rep.cid").alias("c"), F.col("rep.doc_id").alias("first"), F.col("doc_id").alias("x"), "n").distinct()
    for side, other in (("a", "b"), ("b", "a")):
        pairs = pairs.unionByName(pairs.join(more.select("c", "x"), F.col("c" + side) == F.col("c")).select(F.col("x").alias(side), other, "both", "either", "ca", "cb"))
    inner = more.select("c", "n", F.col("first").alias("x")).distinct().unionByName(more.select("c", "n", "x"))
    inner = inner.alias("p").join(inner.alias("q"), F.expr("p.c = q.c and p.x < q.x")).selectExpr("p.x as a", "q.x as b", "cast(p.n as bigint) as both", "cast(p.n as bigint) as either")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "both", "either").unionByName(inner)


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``doc`` and ``keeper``, the smallest id that pairs connect it with, for every other document in a pair.

    Labels fall to the smallest of the neighbours' and then jump to their label's label, so a chain's rounds grow
    with the logarithm of its length. Each round is a checkpoint.
    """
    ready(pairs)
    edges = pairs.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = edges.union(edges.select("y", "x")).distinct().checkpoint()
    label = edges.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("to")).checkpoint()
    while True:
        near = edges.join(label.select(F.col("x").alias("y"), F.col("to").alias("via")), "y").groupBy("x").agg(F.min("via").alias("via"))
        low = label.join(near, "x").select("x", F.least("to", "via").alias("to"), F.col("to").alias("was"))
        jump = low.select(F.col("x").alias("j"), F.col("to").alias("jt"))
        new = low.join(jump, low["to"] == jump["j"], "left").select("x", F.least("to", F.coalesce("jt", "to")).alias("to"), "was").checkpoint()
        moved = new.where("to < was").limit(1).count()
        label = new.select("x", "to")
        if not moved:
            return label.where("x > to").select(F.col("x").alias("doc"), F.col("to").alias("keeper"))


def links(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each id: ``class_id``, the smallest id that links connect it with, and ``n_links``, its number of links.

    A link joins texts of different documents with Jaccard similarity of at least ``threshold``, copies too; all are
    found and counted. An id with several texts has the links of each, and repeated rows count once. Without links, as
    texts without words are, a document is a class of its own. Rows with a NULL id are no documents.
    """
    found, others = _found(docs, threshold, exact=True, spanning=False)
    copies = others.select(F.col("rep.cid").alias("c"), F.col("rep.doc_id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    label = components(found.select("a", "b").unionByName(copies.select("a", "b")).where("a <> b"))
    first = found.select(F.col("ca").alias("c"), F.col("a").alias("doc")).union(found.select("cb", "b")).union(copies.select("c", "a"))
    members = first.union(copies.select("c", "b")).distinct().checkpoint()
    size = members.groupBy("c").agg(F.count("*").alias("size"))
    both = found.select(F.col("ca").alias("c"), F.col("cb").alias("other")).union(found.select("cb", "ca"))
    reached = both.join(size.toDF("other", "many"), "other").groupBy("c").agg(F.sum("many").alias("many"))
    total = members.join(size, "c").join(reached, "c", "left").groupBy("doc").agg(F.sum(F.expr("size - 1 + coalesce(many, 0)")).alias("links"))
    # texts of one document that are like each other are no links
    several = members.join(members.groupBy("doc").agg(F.count("*").alias("texts")).where("texts > 1").select("doc"), "doc").checkpoint()
    inner = both.join(several.select("c", "doc"), "c").join(several.select(F.col("c").alias("other"), "doc"), ["other", "doc"]).groupBy("doc").agg(F.count("*").alias("inner"))
    ids = pick(docs, "doc_id").where("doc_id is not null").distinct().withColumnRenamed("doc_id", "doc")
    out = ids.join(total, "doc", "left").join(inner, "doc", "left").join(label, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), F.coalesce("keeper", "doc").alias("class_id"), F.expr("coalesce(links, 0) - coalesce(inner, 0)").alias("n_links"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without all but the smallest id of every group that pairs connect; rows with a NULL id stay.

    Repeated rows of an id are one document: they stay or go together.
    """
    ready(docs)
    gone = components(jaccard_pairs(docs, threshold, spanning=True)).select("doc").checkpoint()
    return docs.where("doc_id is null").unionByName(lacking(docs.where("doc_id is not null"), gone, "doc_id"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class that similar n-gram sets connect it with, and its number of links."""
    return links(table(spark, sf_dir, "documents"))


def op3_all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with similar n-gram sets, every copy with every other, by n-grams as tokens."""
    pairs = jaccard_pairs(table(spark, sf_dir, "documents"), all_pairs=True, exact=True)
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.col("both").alias("n_both"), F.col("either").alias("n_either"))


_SQL = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '(?:[a-z0-9_]|[^\x00-\x7F])+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' ')) END)) AS g FROM w WHERE len(w) > 0),
class AS (SELECT min(doc_id) AS a, list(DISTINCT doc_id) AS ids, g, len(g) AS n FROM g GROUP BY g),
gram AS (SELECT a, n, unnest(g) AS t FROM class),
pair AS (SELECT x.a, y.a AS b, count(*) AS n_both, x.n + y.n - count(*) AS n_either FROM gram x JOIN gram y ON x.t = y.t AND x.a < y.a GROUP BY x.a, y.a, x.n, y.n HAVING count(*) >= {THRESHOLD} * (x.n + y.n - count(*)))
SELECT a AS doc_a, b AS doc_b, n_both, n_either FROM pair
UNION ALL SELECT a, b, n, n FROM (SELECT a, unnest(ids) AS b, n FROM class) WHERE b > a
"""

#: The plain join: every document with every other.
_ALL_SQL = rf"""{_SQL[: _SQL.index("class AS")]}
one AS (SELECT doc_id, g, len(g) AS n, row_number() OVER () AS k FROM (SELECT DISTINCT doc_id, g FROM g)),
gram AS (SELECT k, doc_id, n, unnest(g) AS t FROM one),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both, x.n + y.n - count(*) AS n_either FROM gram x JOIN gram y ON x.t = y.t AND x.doc_id < y.doc_id GROUP BY x.k, y.k, x.doc_id, y.doc_id, x.n, y.n
  HAVING count(*) >= {THRESHOLD} * (x.n + y.n - count(*)))
SELECT a AS doc_a, b AS doc_b, n_both, n_either FROM pair QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY n_both / n_either DESC, n_both DESC) = 1
"""

#: Classes and numbers of links from the plain join.
_LINKS_SQL = rf"""{_ALL_SQL[: _ALL_SQL.index("SELECT a AS doc_a")].replace("WITH w", "WITH RECURSIVE w", 1).rstrip()},
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach(doc, seen) AS (SELECT DISTINCT a, a FROM edge UNION SELECT r.doc, e.b FROM reach r JOIN edge e ON e.a = r.seen)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) d
LEFT JOIN (SELECT doc AS doc_id, min(seen) AS class_id FROM reach GROUP BY doc) c USING (doc_id)
LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM edge GROUP BY a) n USING (doc_id)
"""

QUERIES = {"op3_ngram_join": op3_ngram_join, "op3_all_pairs": op3_all_pairs}
ORACLES = {"op3_ngram_join": _LINKS_SQL, "op3_all_pairs": _ALL_SQL}
