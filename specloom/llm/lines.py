"""Operator 8, quality rules by line labelling: a CRF marks lines as content or boilerplate, the share of content decides.

Lines are described by their symbols, case, digits, repetitions and lengths. The field is trained here, on the lines
of labelled documents: those of good ones count as content, those of bad ones as boilerplate. As a label holds for a
whole document, documents are also spliced, runs of lines of bad ones into good ones, so that the field sees both kinds
of lines and the steps between them in one document, with the truth known for each line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm import crf
from specloom.llm.common import pick, ready
from specloom.llm.kernel import as_string, buffers, chunks, runs, words
from specloom.session import table

#: Most labelled documents of a class that the field is trained on.
PER_CLASS = 600
#: Share of a document's characters in content lines from which on it is kept.
MIN_SHARE = 0.5
BOILERPLATE, CONTENT = 0, 1

#: Upper ends of the buckets of every measure.
EDGES = (
    ("symbols", (0.005, 0.02, 0.05, 0.1, 0.2, 0.35)),
    ("upper", (0.02, 0.06, 0.15, 0.3, 0.6)),
    ("digits", (0.001, 0.02, 0.1, 0.3)),
    ("repeats", (0.001, 0.03, 0.1, 0.3, 0.6)),
    ("word length", (2.5, 3.5, 4.5, 6, 8, 12)),
    ("words", (1, 3, 8, 20, 60, 200)),
    ("stops", (0.001, 0.005, 0.015, 0.03, 0.06)),
)
_SIZES = [len(e) + 1 for _, e in EDGES] + [4]
FEATURES = sum(_SIZES)
_BASE = np.concatenate([[0], np.cumsum(_SIZES)[:-1]])

_LETTER, _UPPER, _DIGIT, _SPACE, _STOP = (np.zeros(256, bool) for _ in range(5))
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 256)]] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 12, 13, 32]] = True
_STOP[[33, 44, 46, 58, 59, 63]] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _TAIL | _STOP)
_SYMBOL[[10, 39, 45]] = False


def _sum(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask)])
    return total[b] - total[a]


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of lines that have a character other than white space."""
    a, b = runs(data != 10, offsets)
    some = _sum(~_SPACE[data], a, b) > 0
    return a[some], b[some]


def describe(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Active features and characters of every line, and the lines' range of every text."""
    data, offsets = buffers(part)
    a, b = _lines(data, offsets)
    upper = _UPPER[data]
    if len(data):  # two-byte capitals of Latin-1
        upper[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    chars = _sum(~_TAIL[data], a, b)
    letters = np.maximum(_sum(_LETTER[data], a, b), 1)
    w = words(part)
    la, lb = _lines(w.data, w.offsets)  # the same lines of the lower-cased text
    same = np.zeros(len(w.hash), bool)
    if len(w.hash) > 2:
        same[1:] = w.hash[1:] == w.hash[:-1]
        same[2:] |= w.hash[2:] == w.hash[:-2]
    wa, wb = np.searchsorted(w.start, la), np.searchsorted(w.start, lb)
    count = wb - wa
    measures = (
        _sum(_SYMBOL[data], a, b) / chars, _sum(upper, a, b) / letters, _sum(_DIGIT[data], a, b) / chars,
        _sum(same, wa, wb) / np.maximum(count, 1), letters / np.maximum(count, 1), count, _sum(_STOP[data], a, b) / chars,
    )
    row = np.searchsorted(offsets, a, "right") - 1
    bounds = np.searchsorted(row, np.arange(len(offsets)))
    first, last = np.zeros(len(a), bool), np.zeros(len(a), bool)
    live = np.flatnonzero(np.diff(bounds))
    first[bounds[live]], last[bounds[live + 1] - 1] = True, True
    active = np.column_stack([np.searchsorted(e, m, "left") for (_, e), m in zip(EDGES, measures)] + [first * 2 + last]) + _BASE
    return active.astype(np.int32), chars, bounds


def _some_lines(text: str) -> list[str]:
    return [line for line in text.split("\n") if line.strip(" \t\f\r")]


def splice(good: list[str], bad: list[str]) -> tuple[list[str], list[list[int]]]:
    """Documents made of a good and a bad one each, and the labels of their lines: the bad one's are first, last or in the middle.

    Pairs are taken in the order given, and of the bad document the first half of the lines, one at least.
    """
    texts, labels = [], []
    for k, (g, b) in enumerate(zip(good, bad)):
        content, other = _some_lines(g), _some_lines(b)
        other = other[: (len(other) + 1) // 2]
        at = (0, len(content), len(content) // 2)[k % 3]
        lines = content[:at] + other + content[at:]
        if content and other:
            texts.append("\n".join(lines))
            labels.append([CONTENT] * at + [BOILERPLATE] * len(other) + [CONTENT] * (len(content) - at))
    return texts, labels


def train(texts: list[str], good: list[bool], rounds: int = 80) -> crf.Weights | None:
    """The field of labelled documents and of what is spliced from them; None where a class has no line."""
    _, _, bounds = describe(pa.array(texts, pa.string()))
    y = np.repeat(np.array(good, np.int64), np.diff(bounds))
    if not len(y) or y.min() == y.max():
        return None
    mixed, labels = splice([t for t, q in zip(texts, good) if q], [t for t, q in zip(texts, good) if not q])
    active, _, bounds = describe(pa.array([*texts, *mixed], pa.string()))
    return crf.train(active, np.concatenate([y, *labels]).astype(np.int64), bounds, FEATURES, 2, ridge=1.0, rounds=rounds)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> crf.Weights | None:
    """Train on at most ``per_class`` labelled documents of either class, those of the smallest id hashes.

    A document labelled several times counts as bad if any label says so; NULL ids, labels and texts are left out.
    Ties of the hashes fall to the smaller id.
    """
    ready(docs)
    votes = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    wanted = [votes.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    # at most 2 * per_class rows of an id and a label: always small
    rows = pick(docs, "doc_id", "text").join(F.broadcast(wanted[0].unionByName(wanted[1])), "doc_id").where("text is not null")
    found = sorted((r.doc_id, r.text, r.quality) for r in rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect())
    return train([t for _, t, _ in found], [q == 1 for _, _, q in found])


def content_shares(arr: pa.Array, w: crf.Weights) -> Iterator[np.ndarray]:
    """Share of characters in content lines, chunk by chunk; 0 for a text without lines."""
    for _, part in chunks(as_string(arr)):
        active, chars, bounds = describe(part)
        label = crf.viterbi(crf.emissions(active, w), bounds, w)
        content, total = _sum_of(label * chars, bounds), _sum_of(chars, bounds)
        yield content / np.maximum(total, 1)


def _sum_of(x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])


def content_share(text: F.Column, w: crf.Weights | None) -> F.Column:
    """Share of a text's characters in content lines; NULL without a field."""
    if w is None:
        return F.lit(None).cast("double")

    @arrow_udf("double")
    def share(a: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([np.zeros(0), *content_shares(a, w)]))

    return share(text.cast("string"))


def keep_content(docs: DataFrame, labels: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Documents whose share of content is at least ``min_share``, with it.

    NULL and empty texts have no content and go. Every row is judged alone, rows with NULL ids and repeated rows too.
    Of equally good labellings of the lines the one with boilerplate first is taken.
    If the labelled documents give no field, all stay with a NULL share.
    """
    d = pick(docs, "doc_id", "text").select("doc_id", content_share(F.col("text"), fit(docs, labels)).alias("content_share"))
    return d.where(F.col("content_share").isNull() | (F.col("content_share") >= min_share)).withColumn("content_share", F.round("content_share", 6))


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents kept by their share of content lines."""
    return keep_content(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_line_rules": op8_line_rules}
ORACLES: dict[str, str] = {}
