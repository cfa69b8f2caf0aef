"""Operator 7, substring dedup: sliding spans of sentences, hashed and joined over the whole corpus.

A run begins at every sentence and takes in the next ones, ``RUN`` at least, until it has ``MIN_WORDS`` words; it is
hashed by its words. Of all places of a run, the first by document id and position stays; the sentences of every other
place are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm.common import among, discard, pick, ready, scratch
from specloom.llm.kernel import _WORD, U, as_string, buffers, chunks, mix, runs, words
from specloom.session import table

#: Sentences of a run at least.
RUN = 2
#: Words of a run at least: half of a passage of 50, whose first and last sentence are seldom whole.
MIN_WORDS = 25

_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[9, 10, 12, 13, 32]] = True
_STOP[[33, 46, 63]] = True
_ANY_WORD = _WORD.copy()
_ANY_WORD[65:91] = True
_STEP = U(0xC2B2AE3D27D4EB4F)


def segments(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all sentences: after ``[.!?]`` and white space, or after line feeds, and at a row's beginning.

    A sentence runs to the next one's start, so that they add up to the text.
    """
    a, b = runs(_SPACE[data], offsets)
    row_start = np.zeros(len(data) + 1, bool)
    row_start[offsets] = True
    stopped = np.zeros(len(a), bool)
    inner = ~row_start[a] if len(a) else stopped
    stopped[inner] = _STOP[data[a[inner] - 1]]
    la, lb = runs(data == 10, offsets)
    lb = lb[~stopped[np.searchsorted(a, la, "right") - 1]] if len(la) else lb
    starts = np.unique(np.concatenate([b[stopped], lb, offsets[:-1]]))
    return starts[starts < len(data)] if len(data) else starts[:0]


def _lengths(count: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sentences and words of the run that begins at every sentence, from the sentences' words; beyond the last one, no words."""
    n = len(count)
    total = np.concatenate([[0], np.cumsum(count)])
    many = np.maximum(run, np.searchsorted(total, total[:-1] + min_words) - np.arange(n))
    end = np.arange(n) + many
    return many, np.where(end <= n, total[np.minimum(end, n)] - total[:-1], 0)


def _runs_of(run: int, min_words: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, part in chunks(as_string(batch["text"])):
                w = words(part)
                starts = segments(w.data, w.offsets)
                at = np.searchsorted(w.start, starts)  # first word of every sentence
                count = np.diff(np.append(at, len(w.start)))
                at, count, starts = at[count > 0], count[count > 0], starts[count > 0]
                row = np.searchsorted(w.offsets, starts, "right") - 1
                n = len(at)
                # order-sensitive hash of a sentence's words: words weighted by their place in it
                place = np.arange(len(w.hash)) - np.repeat(at, count)
                total = np.concatenate([[U(0)], np.cumsum(mix(w.hash + place.astype(U) * _STEP))])
                sentence = mix(total[at + count] - total[at] + count.astype(U))
                many, size = _lengths(count, run, min_words)
                keep = np.flatnonzero((size >= max(min_words, 1)) & (row == row[np.minimum(np.arange(n) + many, n) - 1]))
                if not len(keep):
                    continue
                acc = sentence[keep]
                for j in range(1, int(many[keep].max())):
                    on = np.flatnonzero(many[keep] > j)
                    acc[on] = acc[on] * _STEP + sentence[keep[on] + j]
                ordinal = np.arange(n) - np.searchsorted(row, row)
                rows = pa.array(first + row[keep])
                yield pa.record_batch({"h": pa.array(mix(acc).view(np.int64)), **{c: batch[c].take(rows) for c in KEY}, "at": pa.array(ordinal[keep].astype(np.int32))})

    return hashes


def _cut(run: int, min_words: int):
    kind = pa.struct([("n_removed", pa.int64()), ("n_left", pa.int64()), ("text", pa.string())])

    @arrow_udf("struct<n_removed bigint, n_left bigint, text string>")
    def cut(text: pa.Array, at: pa.Array) -> pa.Array:
        """Texts without the sentences of the runs that begin at ``at``."""
        data, offsets = buffers(as_string(text))
        out = []
        for i, places in enumerate(at):
            row = data[offsets[i] : offsets[i + 1]]
            own = np.array([0, len(row)])
            starts = segments(row, own)
            begin, _ = runs(_ANY_WORD[row], own)
            ends = np.append(starts[1:], len(row))
            count = np.searchsorted(begin, ends) - np.searchsorted(begin, starts)
            live = np.flatnonzero(count)
            first = places.values.to_numpy()
            many = _lengths(count[live], run, min_words)[0][first]
            edge = np.zeros(len(live) + 1, np.int64)
            np.add.at(edge, first, 1)
            np.add.at(edge, first + many, -1)
            gone = np.cumsum(edge[:-1]) > 0
            keep = np.ones(len(starts), bool)
            keep[live[gone]] = False
            raw = row.tobytes()
            out.append({"n_removed": int(gone.sum()), "n_left": int((~gone).sum()), "text": b"".join(raw[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist())).decode("utf-8", "replace")})
        return pa.array(out, kind)

    return cut


#: What tells texts apart: the id and 128 bits of the text, as an id may be NULL or have several texts.
KEY = ("doc_id", "code", "code2")


def _texts(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").where("text is not null").withColumns({"code": F.xxhash64("text"), "code2": F.xxhash64(F.lit(1), "text")})


def repeated_runs(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Of every text with places of runs other than the first: its key and ``at``, the ordinals of those runs' first sentences.

    Hashes are counted first, with partial sums before the shuffle; only places of repeated ones go further. No group
    of places is sorted or held by one task, however often its run is there.
    """
    spark = ready(docs)
    folder = scratch(spark)
    _texts(docs).mapInArrow(_runs_of(run, min_words), "h long, doc_id long, code long, code2 long, at int").write.parquet(folder)
    places = spark.read.parquet(folder)
    repeated = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("rh")).checkpoint()
    place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "at", "code", "code2")
    held = places.where(among(repeated)("h")).select("h", place.alias("place"))  # and a few that aren't repeated
    first = held.groupBy(F.col("h").alias("fh")).agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first < last").select("fh", "first")
    later = held.join(first, F.col("h") == F.col("fh")).where("place > first").select("place.*")
    found = later.groupBy(*KEY).agg(F.sort_array(F.collect_set("at")).alias("at")).checkpoint()
    discard(spark, folder)
    return found


def cut_repeats(docs: DataFrame, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """Documents that lose sentences: how many go and stay, and the text that is left.

    Sentences without words count for nothing and stay. Texts without a run, NULL and empty texts lose nothing. NULL
    ids come after all others. Equal rows of an id are one place and are cut alike, as often as they are there;
    different texts of an id (or of none) are different places, at the same ordinal in order of their hashes. An empty
    table gives an empty one.
    """
    ready(docs)
    d = _texts(docs)
    later = repeated_runs(docs, run, min_words).select(F.col("doc_id").alias("id"), F.col("code").alias("c"), F.col("code2").alias("c2"), "at")
    d = d.where(among(later.select("c"))("code"))
    met = d.join(later, d["doc_id"].eqNullSafe(F.col("id")) & (d["code"] == F.col("c")) & (d["code2"] == F.col("c2")))
    return met.select("doc_id", _cut(run, min_words)(F.col("text"), F.col("at")).alias("x")).select("doc_id", "x.n_removed", "x.n_left", "x.text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that repeat passages of others or of themselves, with the text that is left."""
    return cut_repeats(table(spark, sf_dir, "documents"))


_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, text FROM documents WHERE text IS NOT NULL),
seg AS (SELECT row, doc_id, text, generate_subscripts(s, 1) AS i, unnest(s) AS s FROM
  (SELECT *, string_split(regexp_replace(text, '([.!?][ \t\n\f\r]+|\n+)', '\1' || chr(1), 'g'), chr(1)) AS s FROM d)),
live AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY i) AS o, regexp_extract_all(lower(s), '(?:[a-z0-9_]|[^\x00-\x7F])+') AS w FROM seg WHERE regexp_matches(lower(s), '[a-z0-9_]|[^\x00-\x7F]')),
grown AS (SELECT a.row, a.doc_id, a.text, a.o, b.o - a.o AS more, sum(len(b.w)) OVER g AS words, string_agg(array_to_string(b.w, ' '), chr(10)) OVER g AS h
  FROM live a JOIN live b ON a.row = b.row AND b.o BETWEEN a.o AND a.o + {max(MIN_WORDS, RUN) - 1} WINDOW g AS (PARTITION BY a.row, a.o ORDER BY b.o)),
run AS (SELECT row, doc_id, text, o, arg_min(h, more) AS h, min(more) AS more FROM grown WHERE more >= {RUN - 1} AND words >= {MIN_WORDS} GROUP BY row, doc_id, text, o),
later AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST, o, text) AS r FROM run) WHERE r > 1),
gone AS (SELECT DISTINCT row, o + k AS o FROM later, range({max(MIN_WORDS, RUN)}) AS v(k) WHERE k <= more)
SELECT doc_id, count(g.o) AS n_removed, count(l.o) - count(g.o) AS n_left, coalesce(string_agg(CASE WHEN g.o IS NULL THEN seg.s END, '' ORDER BY seg.i), '') AS text
FROM seg LEFT JOIN live l USING (row, doc_id, i) LEFT JOIN gone g ON g.row = seg.row AND g.o = l.o
WHERE seg.row IN (SELECT row FROM gone) GROUP BY seg.row, doc_id
"""

QUERIES = {"op7_substring_dedup": op7_substring_dedup}
ORACLES = {"op7_substring_dedup": _SQL}
