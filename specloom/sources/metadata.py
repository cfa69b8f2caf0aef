"""Saved graph documents as tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.graph import Graph
from specloom.schemas import TABLES

_REL = "STRUCT<name STRING, source STRING, target STRING, type STRING, cardinality STRING, description STRING>"
_PROPERTY = (
    "STRUCT<name STRING, type STRING, required BOOLEAN, cardinality STRING, description STRING, enum_values ARRAY<STRING>, reference_target STRING, array_item_type STRING, pattern STRING, "
    "deprecated BOOLEAN>"
)
SCHEMA = (
    "version STRUCT<version STRING, date STRING, commit_hash STRING, tag STRING>, "
    f"entities MAP<STRING, STRUCT<name STRING, properties ARRAY<{_PROPERTY}>, relationships ARRAY<{_REL}>, description STRING, parent STRING, aliases ARRAY<STRING>, deprecated BOOLEAN, spec_section STRING>>, "
    f"relationships ARRAY<{_REL}>, validation_rules ARRAY<STRUCT<rule_id STRING, description STRING, severity STRING, phase STRING, condition STRING, action STRING, referenced_entities ARRAY<STRING>, "
    "spec_section STRING, source_text STRING>>, enum_types MAP<STRING, STRUCT<name STRING, values ARRAY<STRING>, extensible BOOLEAN, description STRING>>, "
    "type_aliases MAP<STRING, STRUCT<name STRING, base_type STRING, cddl_name STRING, description STRING, external BOOLEAN>>, "
    "status_codes ARRAY<STRUCT<code STRING, meaning STRING, url_usage STRING, category STRING>>"
)


def _shape(rows: DataFrame, table: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """The table's columns: absent and NULL strings are empty, flags false, lists empty."""
    out = []
    for name, kind in (c.strip().split(" ") for c in TABLES[table].split(",")):
        c = F.col(name) if name in rows.columns else F.lit(None)
        default = (defaults or {}).get(name, {"string": "", "boolean": False}.get(kind))
        blank = F.array().cast(kind) if kind.startswith("array") else F.lit(default)
        out.append((F.coalesce(c.cast(kind), blank) if default is not None or kind.startswith("array") else c.cast(kind)).alias(name))
    return rows.select(*out)


def graph_of(documents: DataFrame, conventions: DataFrame | None = None) -> Graph:
    """Tables of parsed documents, a row each. Edges of entities are kept, in the parser's scope."""
    spark = documents.sparkSession
    d = documents.withColumn("v", F.coalesce("version.version", F.lit("")))
    listed = lambda c: d.select(F.col("v").alias("version"), F.posexplode(c).alias("ord", "x")).select("version", F.col("ord").cast("bigint"), "x.*")
    keyed = lambda c: d.select(F.col("v").alias("version"), F.posexplode(F.map_entries(c)).alias("ord", "x")).select("version", F.col("ord").cast("bigint").alias("ord"), F.col("x.key").alias("key"), "x.value.*")
    entities = keyed("entities").withColumn("name", F.col("key"))
    props = entities.select("version", F.col("name").alias("entity"), F.posexplode("properties").alias("ord", "p")).select("version", "entity", F.col("ord").cast("bigint").alias("ord"), "p.*")
    own = entities.select("version", F.col("ord").alias("eord"), F.posexplode("relationships").alias("ord", "r")).select("version", (F.col("eord") * 100_000 + F.col("ord")).alias("ord"), "r.*")
    edges = listed("relationships").withColumn("scope", F.lit("inferred")).unionByName(own.withColumn("scope", F.lit("parser")))
    return Graph(
        spec_version=_shape(d.select("version.*"), "spec_version"), entity=_shape(entities, "entity"), property=_shape(props, "property", {"type": "any", "cardinality": "1"}),
        relationship=_shape(edges, "relationship", {"type": "references", "cardinality": "1"}), rule=_shape(listed("validation_rules"), "rule", {"severity": "may", "phase": "structural"}),
        enum_type=_shape(keyed("enum_types").withColumn("name", F.col("key")), "enum_type"), type_alias=_shape(keyed("type_aliases").withColumn("name", F.col("key")), "type_alias"),
        status_code=_shape(listed("status_codes"), "status_code"), convention=conventions if conventions is not None else spark.createDataFrame([], TABLES["convention"]),
    )


def load(spark: SparkSession, folder: str | Path, *versions: str) -> Graph:
    """Saved documents of some versions, each under its own folder; FileNotFoundError where one wasn't built."""
    paths = [Path(folder, v, "metadata.json") for v in versions]
    for v, p in zip(versions, paths):
        if not p.exists():
            raise FileNotFoundError(f"No graph was built for version {v!r}. Run `generate --version {v}` first.")
    # one multi-line document a file
    text = spark.read.text([str(p) for p in paths], wholetext=True)
    parsed = text.select(F.from_json("value", SCHEMA).alias("d"), F.get_json_object("value", "$.spec_conventions").alias("c"))
    return graph_of(parsed.select("d.*"), parsed.select(F.col("d.version.version").alias("version"), F.col("c").alias("document")).where("document is not null"))
