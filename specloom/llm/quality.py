"""Operator 5, quality classifier: how much better a text compresses with the good or the bad dictionary.

Two zstandard dictionaries are trained, on good and on bad labelled text. A text's normalised size difference
``(good - bad) / (good + bad)``, with its compressibility and length as controls, goes through a logistic
calibration fitted on labelled rows that built no dictionary.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm.common import pick, ready
from specloom.llm.kernel import as_string
from specloom.session import table

#: Most labelled rows of a class that are read to build its dictionary and, as many again, to calibrate.
PER_CLASS = 1000
DICT_BYTES = 112_640
LEVEL = 3
#: A text is kept from this calibrated score on.
THRESHOLD = 0.2


class Model(NamedTuple):
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]


_compressors: dict[bytes, zstandard.ZstdCompressor] = {}


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    if content not in _compressors:
        d = zstandard.ZstdCompressionDict(content)
        d.precompute_compress(level=LEVEL)
        _compressors[content] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return _compressors[content]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; the texts themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:DICT_BYTES]


def sizes(texts: list[bytes], good: bytes, bad: bytes) -> np.ndarray:
    """Compressed size with either dictionary, and the plain size."""
    a, b = _compressor(good).compress, _compressor(bad).compress
    return np.array([[len(a(x)), len(b(x)), len(x)] for x in texts], float).reshape(-1, 3)


def features(m: np.ndarray) -> np.ndarray:
    good, bad, n = m.T + 1
    d, r, size = (good - bad) / (good + bad), np.log((good + bad) / 2 / n), np.log(n)
    return np.column_stack([d, r, size, d * r, d * size, r * size, d * d, r * r, size * size])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; both classes weigh the same."""
    w = np.zeros(x.shape[1])
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (share * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (share * (y - p)) - ridge * w)
        w += step * min(1, 5 / max(np.abs(step).max(), 1e-9))
    return w


def _own_lines(good: list[bytes], bad: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Texts without the lines that several of them have: passages that many documents share say nothing of quality."""
    seen: dict[bytes, int] = {}
    for text in (*good, *bad):
        for line in set(text.split(b"\n")):
            seen[line] = seen.get(line, 0) + 1
    own = [[b"\n".join(line for line in text.split(b"\n") if seen[line] == 1) for text in x] for x in (good, bad)]
    return tuple([t for t in x if t] or y for x, y in zip(own, (good, bad)))


def train(good: list[bytes], bad: list[bytes]) -> Model | None:
    """Dictionaries from the even rows' own lines, calibration on the odd rows. None if a class has no text."""
    if not good or not bad:
        return None
    dg, db = map(_dictionary, _own_lines(good[::2], bad[::2]))
    xs = [features(sizes(x[1::2] or x, dg, db)) for x in (good, bad)]
    x = np.vstack(xs)
    centre, scale = x.mean(0), x.std(0) + 1e-9
    y = np.r_[np.ones(len(xs[0])), np.zeros(len(xs[1]))]
    return Model(dg, db, tuple(logistic(np.column_stack([np.ones(len(x)), (x - centre) / scale]), y)), tuple(centre), tuple(scale))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    """Train on at most ``2 * per_class`` labelled rows of either class, those of the smallest id hashes.

    A document labelled several times counts as bad if any label says so; NULL ids, labels and texts are left out.
    """
    ready(docs)
    wanted = None
    votes = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    for q in (0, 1):
        part = votes.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        wanted = part if wanted is None else wanted.unionByName(part)
    # at most 4 * per_class rows of an id and a label: always small
    rows = pick(docs, "doc_id", "text").join(F.broadcast(wanted), "doc_id").where("text is not null").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    found = sorted((r.doc_id * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r.quality, r.text.encode("utf-8", "replace")) for r in rows.collect())
    return train([t for _, q, t in found if q == 1], [t for _, q, t in found if q == 0])


def predict(texts: list[bytes], model: Model) -> np.ndarray:
    x = (features(sizes(texts, model.good, model.bad)) - model.centre) / np.array(model.scale)
    return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ model.weights, -30, 30)))


def score(text: F.Column, model: Model | None) -> F.Column:
    """Probability that a text is good. NULL counts as the empty text; without a model the score is NULL."""
    if model is None:
        return F.lit(None).cast("double")

    @arrow_udf("double")
    def probability(a: pa.Array) -> pa.Array:
        return pa.array(predict([x.as_buffer().to_pybytes() for x in as_string(a)], model))

    return probability(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """``docs`` with ``good_score`` (all columns kept; a column of that name is replaced)."""
    return docs.withColumn("good_score", score(F.col("text"), fit(docs, labels, per_class)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, per_class: int = PER_CLASS) -> DataFrame:
    """The documents that the classifier keeps, with the columns they came with.

    Every row is judged alone, so repeated rows are judged alike and rows with a NULL id stay or go by their text.
    NULL and empty texts get the score of the empty text. If a class has no labelled text, all is kept.
    """
    model = fit(docs, labels, per_class)
    return docs if model is None else docs.where(score(F.col("text"), model) >= threshold)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of good quality with their score; rejected ones are absent."""
    docs = pick(table(spark, sf_dir, "documents"), "doc_id", "text")
    scored = classify(docs, table(spark, sf_dir, "labels")).select("doc_id", F.round("good_score", 6).alias("score"))
    return scored.where(F.col("score").isNull() | (F.col("score") >= THRESHOLD))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
