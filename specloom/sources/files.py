"""Text files of one or many source trees as rows."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "version string, part bigint, file string, text string"
#: Where a tree keeps its sources.
LAYOUT = {
    "cddl": "docs/modules/specs/partials/schemas/cddl/*.cddl", "json_schema": "docs/modules/crJSON/partials/crJSON.schema.json",
    "validation": "docs/modules/specs/partials/Validation/Validation.adoc", "assertions": "docs/modules/specs/partials/Standard_Assertions/*.adoc",
}


def read(spark: SparkSession, trees: dict[str, str | Path], kind: str) -> DataFrame:
    """Whole texts of a kind of source of all versions' trees, in order of their names; a tree may have none."""
    out = None
    for version, root in trees.items():
        if not any(Path(root).glob(LAYOUT[kind])):
            continue
        one = spark.read.text(str(Path(root, LAYOUT[kind])), wholetext=True).select(F.lit(version).alias("version"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        return spark.createDataFrame([], ROW)
    part = F.row_number().over(Window.partitionBy("version").orderBy("file")).cast("bigint")
    return out.select("version", part.alias("part"), "file", "text")
