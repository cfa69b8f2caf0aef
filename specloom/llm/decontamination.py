"""Operator 1, benchmark decontamination: a prefix-filtered set join of benchmark items with document windows.

An item is the set of its word n-grams. The n-grams of all items are ordered by rarity, their document frequency in
the whole corpus. Of an item that must be found to a share ``threshold``, some n-gram among its
``size - need + 1`` rarest, the prefix, must be in the document; only documents that have one are candidates. Length
and position bound them further, and the best containment over all windows of the item's size decides, exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm.common import pick, ready
from specloom.llm.kernel import U, Lookup, as_string, chunks, shingles, words
from specloom.session import table

N = 3
THRESHOLD = 0.6
#: n-grams of benchmark items that a Python worker holds at once; a larger benchmark is joined in slices of items.
SLICE = 2_000_000

FOUND = "array<struct<item_id bigint, matched bigint, size bigint, at bigint>>"


def need_of(size: int, threshold: float) -> int:
    """Matching n-grams that an item of ``size`` distinct ones needs."""
    return max(1, math.ceil(threshold * size - 1e-9))


class Index:
    """Items of a slice: the prefix n-grams with their items, and all n-grams for verification."""

    def __init__(self, items: list[tuple[int, np.ndarray]], frequency: dict[int, int], threshold: float) -> None:
        self.ids = np.array([i for i, _ in items], np.int64)
        self.length = np.array([len(h) for _, h in items])
        sets = [np.unique(h) for _, h in items]
        self.size = np.array([len(s) for s in sets])
        self.need = np.array([need_of(n, threshold) for n in self.size])
        self.sets = sets
        prefix_hash, prefix_item = [], []
        for k, s in enumerate(sets):
            rarest = sorted(s.tolist(), key=lambda h: (frequency.get(h, 0), h))[: self.size[k] - self.need[k] + 1]
            prefix_hash += rarest
            prefix_item += [k] * len(rarest)
        h, k = np.array(prefix_hash, U), np.array(prefix_item)
        order = np.argsort(h, kind="stable")
        self.postings = k[order]
        self.lookup = Lookup(h)
        self.first = np.searchsorted(h[order], self.lookup.keys)
        self.last = np.searchsorted(h[order], self.lookup.keys, "right")

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Rows and items that share a prefix n-gram, with its positions in the row, the row being long enough."""
        at, slot = self.lookup(h)
        if not len(at):
            return
        many = self.last[slot] - self.first[slot]
        at = np.repeat(at, many)
        item = self.postings[np.repeat(self.first[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())]
        row = np.searchsorted(bounds, at, "right") - 1
        long_enough = bounds[row + 1] - bounds[row] >= self.need[item]
        at, item, row = at[long_enough], item[long_enough], row[long_enough]
        order = np.lexsort((at, item, row))
        at, item, row = at[order], item[order], row[order]
        cut = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
        for lo, hi in zip(np.r_[0, cut], np.r_[cut, len(at)]):
            if hi > lo:
                yield int(row[lo]), int(item[lo]), at[lo:hi] - bounds[row[lo]]

    def best_window(self, doc: np.ndarray, item: int, prefix_at: np.ndarray) -> tuple[int, int]:
        """Most distinct n-grams of the item in any window of its length, and the first such window's start.

        Only positions nearer than the item's length to a prefix n-gram can be in a window that has enough.
        """
        s, length, need = self.sets[item], int(self.length[item]), int(self.need[item])
        slot = np.minimum(np.searchsorted(s, doc), len(s) - 1)
        pos = np.flatnonzero(s[slot] == doc)
        if len(pos) < need:
            return 0, 0
        near = np.searchsorted(prefix_at, pos - length, "right") < np.searchsorted(prefix_at, pos + length, "left")
        pos = pos[near]
        if len(pos) < need or (np.searchsorted(pos, pos + length) - np.arange(len(pos))).max() < need:
            return 0, 0
        gram, seen, best, start, lo = slot[pos].tolist(), {}, 0, 0, 0
        at = pos.tolist()
        for hi, (p, g) in enumerate(zip(at, gram)):
            seen[g] = seen.get(g, 0) + 1
            while at[lo] <= p - length:
                seen[gram[lo]] -= 1
                if not seen[gram[lo]]:
                    del seen[gram[lo]]
                lo += 1
            if len(seen) > best:
                best, start = len(seen), at[lo]
        return (best, start) if best >= need else (0, 0)

    def search(self, arr: pa.Array) -> list[list[dict]]:
        """For every text, the items that it contains to the threshold."""
        out: list[list[dict]] = [[] for _ in range(len(arr))]
        for first, part in chunks(as_string(arr)):
            h, bounds = shingles(words(part), N, short=False)
            for row, item, at in self.candidates(h, bounds):
                matched, start = self.best_window(h[bounds[row] : bounds[row + 1]], item, at)
                if matched:
                    out[first + row].append({"item_id": int(self.ids[item]), "matched": matched, "size": int(self.size[item]), "at": start})
        return out


def _items(benchmark: DataFrame, named: bool) -> Iterator[list[tuple[int, np.ndarray]]]:
    """The items' n-grams in order, in slices of at most ``SLICE`` n-grams; if not ``named``, items without an id too, as 0."""
    part, held = [], 0
    rows = pick(benchmark, "item_id", "text").where("text is not null")
    rows = rows.where("item_id is not null") if named else rows.fillna(0, ["item_id"])
    rows = rows.distinct().orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        h, _ = shingles(words(pa.array([r.text])), N, short=False)
        if not len(h):
            continue
        if part and held + len(h) > SLICE:
            yield part
            part, held = [], 0
        part.append((r.item_id, h))
        held += len(h)
    if part:
        yield part


def frequencies(docs: DataFrame, keys: np.ndarray) -> dict[int, int]:
    """Documents that have each of the n-grams, over all of ``docs``; n-grams that none has are left out."""
    lookup = Lookup(keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lookup.keys), np.int64)
        for batch in batches:
            for _, part in chunks(as_string(batch["text"])):
                h, bounds = shingles(words(part), N, short=False)
                at, slot = lookup(h)
                if len(at):
                    row = np.searchsorted(bounds, at, "right") - 1
                    np.add.at(total, np.unique(row * len(lookup.keys) + slot) % len(lookup.keys), 1)
        some = np.flatnonzero(total)
        yield pa.record_batch({"h": pa.array(lookup.keys[some].view(np.int64)), "n": pa.array(total[some])})

    rows = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()  # at most SLICE
    return {int(np.int64(r.h).view(U)): r.n for r in rows}


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, named: bool = True) -> F.Column | None:
    """Column of the items contained in ``docs.text``; None if no item has n-grams."""
    ready(docs)
    texts = docs.select(F.col("text").cast("string").alias("text"))
    columns = []
    for items in _items(benchmark, named):
        index = Index(items, frequencies(texts, np.unique(np.concatenate([h for _, h in items]))), threshold)
        columns.append(_udf(index)(F.col("text").cast("string")))
    return F.concat(*columns) if columns else None


def _udf(index: Index):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("matched", pa.int64()), ("size", pa.int64()), ("at", pa.int64())]))

    @arrow_udf(FOUND)
    def search(a: pa.Array) -> pa.Array:
        return pa.array(index.search(a), kind)

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents with the items that they contain: ``matched`` of the item's ``size`` n-grams, in the window from n-gram ``at``.

    Items of fewer than n words, NULL items and NULL, empty or shorter texts match nothing. An item id with several
    texts counts by each. A repeated row is reported each time. Of equally good windows the first is given. Without
    documents or items the result is empty.
    """
    d = pick(docs, "doc_id", "text")
    found = leaks(d, benchmark, threshold)
    found = F.lit(None).cast(FOUND) if found is None else found
    return d.select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.item_id", "f.matched", "f.size", "f.at")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that contain an item; every row is judged by its own text, NULL texts stay.

    Items without an id count too; items of fewer than n words don't, as two words in a row prove nothing.
    """
    found = leaks(docs, benchmark, threshold, named=False)
    return docs if found is None else docs.where(F.size(found) == 0)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_GRAMS = rf"""regexp_extract_all(lower(text), '(?:[a-z0-9_]|[^\x00-\x7F])+')"""
_SQL = rf"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS row, {_GRAMS} AS w FROM documents),
dg AS (SELECT doc_id, row, i - 1 AS p, array_to_string(w[i:i + {N - 1}], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - {N} + 2)) AS i FROM dw WHERE len(w) >= {N})),
iw AS (SELECT DISTINCT item_id, text, {_GRAMS} AS w FROM benchmark WHERE item_id IS NOT NULL),
item AS (SELECT item_id, text, len(w) - {N - 1} AS length, list_distinct(list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N - 1}], ' '))) AS gs FROM iw WHERE len(w) >= {N}),
ig AS (SELECT item_id, text, length, len(gs) AS size, unnest(gs) AS g FROM item),
hit AS (SELECT doc_id, row, item_id, ig.text, length, size, p, dg.g FROM dg JOIN ig ON dg.g = ig.g),
win AS (SELECT a.doc_id, a.row, a.item_id, a.text, a.size, a.p, count(DISTINCT b.g) AS matched
  FROM hit a JOIN hit b ON a.row = b.row AND a.item_id = b.item_id AND a.text = b.text AND b.p BETWEEN a.p AND a.p + a.length - 1 GROUP BY ALL)
SELECT doc_id, item_id, matched, size::BIGINT AS size, p::BIGINT AS at FROM (
  SELECT *, row_number() OVER (PARTITION BY row, item_id, text ORDER BY matched DESC, p) AS r FROM win) WHERE r = 1 AND matched >= ceil({THRESHOLD} * size - 1e-9)
"""

QUERIES = {"op1_decontamination": op1_decontamination}
ORACLES = {"op1_decontamination": _SQL}
