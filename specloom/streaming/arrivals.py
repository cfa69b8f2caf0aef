"""Rule extraction over arriving documents.

Sentences are found row by row, so they stream without state. Numbering needs whole documents, so it runs on every
micro-batch, which holds whole documents; a table of rules grows batch by batch and is safe to replay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specloom.functions import text
from specloom.functions.lexicon import RFC2119, Lexicon
from specloom.operators import prose


def sentences(docs: DataFrame, lexicon: Lexicon = RFC2119) -> DataFrame:
    """Normative sentences of a stream of ``doc, text``, without sections and numbers."""
    paras = docs.select("doc", F.explode(F.split("text", lexicon.paragraph)).alias("para")).where(~text.skipped(F.col("para"), lexicon) & text.found(F.col("para"), lexicon.normative))
    said = paras.select("doc", text.phase(F.lit(""), F.col("para"), lexicon).alias("phase"), F.explode(text.sentences(F.col("para"))).alias("sentence")).where(text.found(F.col("sentence"), lexicon.normative))
    out = said.select("doc", "phase", text.severity(F.col("sentence"), lexicon).alias("severity"), text.clean_markup(F.col("sentence")).alias("description"))
    return out.where(F.length("description") >= lexicon.min_length)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they appear in a folder, a file each."""
    return spark.readStream.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def numbered(docs: DataFrame, out: str, checkpoint: str, lexicon: Lexicon = RFC2119) -> StreamingQuery:
    """Write numbered rules of arriving documents below ``out``, a folder for every batch, until no document is left."""

    def write(batch: DataFrame, batch_id: int) -> None:
        prose.rules(batch, ["doc"], lexicon).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
