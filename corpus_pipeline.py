"""From raw documents to sharded training data: classify, drop near copies, decontaminate, mix, shard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from specloom.llm.common import discard, ready, scratch
from specloom.llm.decontamination import drop_contaminated
from specloom.llm.mixing import mix_rows
from specloom.llm.ngram_join import keep_one
from specloom.llm.quality import keep_good
from specloom.llm.sharding import shard
from specloom.session import table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier keeps."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram similarity connects."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources repeated towards equal weights up to the limit."""
    return mix_rows(docs)


def place(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, a partition for every shard."""
    return shard(docs)


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminate), ("source mixing", mix), ("sharding", place)]

#: SQL has no zstandard dictionaries, so the first stage can't be expressed; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Each but the last is written as Parquet beside the checkpoints and read again.

    A stage's table is deleted when the next one is written; the one that the result reads goes with the checkpoints,
    at the session's end. Rows with NULL ids or texts, repeated rows and further columns, whatever their names, go
    through every stage by the rules that its operator states. Empty documents give an empty result.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    ready(docs)
    for _, stage in STAGES[:-1]:
        folder = scratch(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        if before:
            discard(spark, before)
        docs, before = spark.read.parquet(folder), folder
    return STAGES[-1][1](spark, docs, sf_dir)
