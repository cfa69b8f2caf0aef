"""Operator 9, sharding: weighted rendezvous hashing of stable record keys.

Every record scores every shard, ``-weight / ln(u)`` with ``u`` in (0, 1) from the hash of key and shard, and goes
to the highest. A shard that is added takes only its own share; one that is removed gives up only its own records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.llm.common import pick
from specloom.session import table

#: Weight of every shard, by number: two half-size ones among fourteen.
WEIGHTS = {i: 0.5 if i >= 14 else 1.0 for i in range(16)}


def record_key(docs: DataFrame) -> F.Column:
    """The id, or the text's hash where there is none: the same in every run and for repeated rows."""
    no_id = F.concat(F.lit("t"), F.md5(F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")))
    return F.coalesce(F.col("doc_id").cast("string"), no_id) if "doc_id" in docs.columns else no_id


def shard_of(key: F.Column, weights: dict[int, float]) -> F.Column:
    """Number of the shard with the highest score; the smaller number on a tie.

    52 bits of the hash make ``u``, so it is neither 0 nor 1. A shard without weight gets nothing.
    """
    live = sorted((s, w) for s, w in weights.items() if w > 0)
    if not live:
        raise ValueError("no shard has a weight above 0")
    scores = [
        F.struct((F.lit(float(w)) / -F.log((F.conv(F.substring(F.md5(F.concat_ws("#", F.lit(str(s)), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52))).alias("score"), F.lit(-s).alias("minus"))
        for s, w in live
    ]
    return (-F.greatest(*scores)["minus"]).cast("int") if len(scores) > 1 else F.lit(live[0][0])


def shard(docs: DataFrame, weights: dict[int, float] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (a column of that name is replaced), each shard in Spark partitions of its own.

    Rows with a NULL id go by the hash of their text; NULL and empty texts count alike. Repeated rows share a shard.
    One shuffle moves every row to a partition of its shard. A shard has as many as let all shards together have the
    session's shuffle partitions, so that tasks don't grow with the data; its rows are spread over them by key.
    """
    weights = WEIGHTS if weights is None else weights
    shards = max(weights) + 1
    parts = -(-int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards)
    placed = docs.withColumn("shard", shard_of(record_key(docs), weights))
    return placed.repartitionById(shards * parts, (F.col("shard") * parts + F.pmod(F.xxhash64(record_key(docs)), F.lit(parts))).cast("int"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard."""
    return shard(pick(table(spark, sf_dir, "documents"), "doc_id", "text", "lang", "source", "n_chars"))


_VALUES = ", ".join(f"({s}, {w}::DOUBLE)" for s, w in WEIGHTS.items())
_SQL = f"""
SELECT doc_id, text, lang, source, n_chars, s::INT AS shard FROM (
  SELECT d.*, s, row_number() OVER (PARTITION BY d.row ORDER BY
    w / -ln((('0x' || substr(md5(s || '#' || coalesce(d.doc_id::VARCHAR, 't' || md5(coalesce(d.text, '')))), 1, 13))::BIGINT + 0.5) / 4503599627370496) DESC, s) AS r
  FROM (SELECT *, row_number() OVER () AS row FROM documents) d, (VALUES {_VALUES}) AS v(s, w))
WHERE r = 1
"""

QUERIES = {"op9_sharding": op9_sharding}
ORACLES = {"op9_sharding": _SQL}
