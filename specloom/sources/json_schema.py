"""S3: JSON Schema documents as entity, property and edge tables, with JSON functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specloom.functions import names

_TYPE = {"string": "string", "integer": "integer", "number": "float", "boolean": "boolean", "object": "map", "array": "array", "null": "any"}
_FORMAT = {"uri": "uri", "date-time": "datetime", "date": "datetime"}
#: Keywords of a schema; values that vary in kind stay JSON text.
SCHEMA = (
    "type STRING, title STRING, description STRING, format STRING, pattern STRING, `$ref` STRING, required ARRAY<STRING>, properties MAP<STRING,STRING>, "
    "definitions MAP<STRING,STRING>, items STRING, oneOf ARRAY<STRING>, anyOf ARRAY<STRING>, `enum` ARRAY<STRING>"
)


def _json(text: Column) -> Column:
    return F.from_json(text, SCHEMA)


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _refs(choices: Column) -> Column:
    """Names that the references among alternatives point to."""
    refs = F.transform(choices, lambda c: F.get_json_object(c, "$['$ref']"))
    return F.transform(F.filter(refs, lambda r: r.isNotNull()), names.last_segment)


def choices(s: Column) -> Column:
    return F.coalesce(s["oneOf"], s["anyOf"])


def infer(s: Column) -> Column:
    """``type, reference_target, array_item_type`` of a schema; a list of types counts as any."""
    refs = _refs(choices(s))
    item_ref = names.last_segment(F.get_json_object(s["items"], "$['$ref']"))
    item_type = F.get_json_object(s["items"], "$.type")
    kind = (
        F.when(s["$ref"].isNotNull(), "reference").when(choices(s).isNotNull(), "union").when(s["enum"].isNotNull(), "enum")
        .when(s["format"].isin(*_FORMAT), names.literal_map(_FORMAT, s["format"])).when(s["type"] == "array", "array")
        .otherwise(F.coalesce(names.literal_map(_TYPE, s["type"]), F.lit("any")))
    )
    target = F.when(s["$ref"].isNotNull(), names.last_segment(s["$ref"])).when((kind == "union") & (F.size(refs) > 0), refs[0])
    item = F.when(kind == "array", F.coalesce(item_ref, F.when(item_type.isNotNull(), F.coalesce(names.literal_map(_TYPE, item_type), F.lit("any")))))
    return F.struct(kind.alias("type"), _blank(target).alias("reference_target"), _blank(item).alias("array_item_type"))


def cardinality(s: Column, required: Column) -> Column:
    """P24."""
    return F.when(s["type"] == "array", F.when(required, "1..*").otherwise("0..*")).otherwise(F.when(required, "1").otherwise("0..1"))


def definitions(files: DataFrame) -> DataFrame:
    """Root and definitions of ``version, file, text`` rows in document order; F7: those that describe objects."""
    root = files.select("version", "file", _json(F.col("text")).alias("s"))
    title = F.coalesce(F.nullif(F.regexp_replace(F.coalesce("s.title", F.lit("crJSONDocument")), "[^A-Za-z0-9]", ""), F.lit("")), F.lit("CrJSONDocument"))
    top = root.where("s.type = 'object'").select("version", "file", F.lit(0).cast("bigint").alias("ord"), title.alias("name"), "s", F.lit(True).alias("root"))
    entries = root.select("version", "file", F.posexplode(F.map_entries("s.definitions")).alias("i", "d"))
    defs = entries.select("version", "file", (F.col("i") + 1).cast("bigint").alias("ord"), F.col("d.key").alias("name"), _json(F.col("d.value")).alias("s"), F.lit(False).alias("root"))
    several = choices(F.col("s")).isNotNull()
    is_object = F.coalesce(F.col("s.type"), F.lit("")).isin("object", "") & F.col("s.properties").isNotNull()
    return top.unionByName(defs.where(is_object | several))


def tables(files: DataFrame) -> dict[str, DataFrame]:
    """Entities, properties and edges (of the definitions' and root's references) of JSON Schema files."""
    d = definitions(files)
    empty = F.array().cast("array<string>")
    entity = d.select(
        "version", "ord", "name", _blank(F.col("s.description")).alias("description"), F.lit("").alias("parent"), F.col("file").alias("source"), F.lit("").alias("spec_section"),
        empty.alias("aliases"), F.lit(False).alias("deprecated"))
    p = d.select("version", "file", "name", "ord", "root", F.coalesce("s.required", empty).alias("must"), F.posexplode(F.map_entries("s.properties")).alias("i", "e"))
    p = p.withColumn("s", _json(F.col("e.value"))).withColumn("t", infer(F.col("s"))).withColumn("req", F.array_contains("must", F.col("e.key")))
    own = p.select(
        "version", F.col("name").alias("entity"), (F.col("ord") * 100_000 + F.col("i")).alias("ord"), F.col("e.key").alias("name"), "t.type", _blank(F.col("s.description")).alias("description"),
        F.col("req").alias("required"), cardinality(F.col("s"), F.col("req")).alias("cardinality"), F.when(F.col("t.type") == "enum", F.coalesce("s.enum", empty)).otherwise(empty).alias("enum_values"),
        "t.reference_target", "t.array_item_type", _blank(F.col("s.pattern")).alias("pattern"), F.lit(None).cast("int").alias("min_length"), F.lit(None).cast("int").alias("max_length"),
        F.lit(False).alias("deprecated"), F.col("file").alias("source"), "root")
    # A definition that is nothing but alternatives has them as one property
    refs = _refs(choices(F.col("s")))
    union = d.where(~F.col("root") & F.col("s.properties").isNull() & (F.size(refs) > 0)).select(
        "version", F.col("name").alias("entity"), (F.col("ord") * 100_000).alias("ord"), F.lit("_union").alias("name"), F.lit("union").alias("type"),
        F.concat(F.lit("One of: "), F.array_join(refs, ", ")).alias("description"), F.lit(True).alias("required"), F.lit("1").alias("cardinality"), empty.alias("enum_values"),
        refs[0].alias("reference_target"), F.lit("").alias("array_item_type"), F.lit("").alias("pattern"), F.lit(None).cast("int").alias("min_length"), F.lit(None).cast("int").alias("max_length"),
        F.lit(False).alias("deprecated"), F.col("file").alias("source"), F.lit(False).alias("root"))
    prop = own.unionByName(union)
    referring = F.col("type").isin("reference", "union") & (F.col("reference_target") != "")
    listing = (F.col("type") == "array") & F.col("array_item_type").rlike(r"^\p{Lu}") & ~F.col("root")
    edge = prop.where(referring | listing).select(
        "version", F.lit("parser").alias("scope"), "ord", "name", F.col("entity").alias("source"), F.when(referring, F.col("reference_target")).otherwise(F.col("array_item_type")).alias("target"),
        F.when(referring, "references").otherwise("has_many").alias("type"), "description", "cardinality")
    return {"entity": entity, "property": prop.drop("root"), "relationship": edge}
