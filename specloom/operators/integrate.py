"""Merging sources, resolving references and inferring edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import names
from specloom.schemas import PROPERTY_TYPES


def blank(c: Column | str) -> Column:
    """NULL for the empty string."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key, whole."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def last_wins(rows: DataFrame, keys: list[str], order: str = "ord") -> DataFrame:
    """A keyed insert: the last row's values at the first row's place."""
    w = Window.partitionBy(*keys)
    at = rows.withColumn("__first", F.min(order).over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.col(order).desc())))
    return at.where("__r = 1").withColumn(order, F.col("__first")).drop("__first", "__r")


def merge_entities(entities: DataFrame) -> DataFrame:
    """A2: an entity of several files has the first one's fields and the first description that isn't blank."""
    w = Window.partitionBy("version", "name").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = entities.withColumn("description", F.coalesce(F.first(blank("description"), ignorenulls=True).over(w), F.lit("")))
    return first_wins(filled, ["version", "name"], ["ord"])


def merge_properties(properties: DataFrame, part: str = "part") -> DataFrame:
    """A2: the first file's properties all stay; a later file adds those of new names."""
    w = Window.partitionBy("version", "entity")
    seen = Window.partitionBy("version", "entity", "name")
    own = properties.withColumn("__first", F.min(part).over(w)).withColumn("__name", F.min(part).over(seen))
    return own.where((F.col(part) == F.col("__first")) | (F.col(part) == F.col("__name"))).drop("__first", "__name")


def merge_enums(enums: DataFrame) -> DataFrame:
    """A3: values of all files in order, each once if there are several files; extensible if any is."""
    merged = enums.groupBy("version", "name").agg(
        F.sort_array(F.collect_list(F.struct("ord", "values"))).alias("vs"), F.min("ord").alias("ord"), F.bool_or("extensible").alias("extensible"),
        F.min_by("description", "ord").alias("description"), F.min_by("source", "ord").alias("source"),
    )
    first = F.element_at(F.col("vs.values"), 1)
    later = F.array_except(F.flatten(F.slice(F.col("vs.values"), 2, F.greatest(F.size("vs") - 1, F.lit(0)))), first)
    return merged.select("version", "ord", "name", F.concat(first, F.coalesce(later, F.array().cast("array<string>"))).alias("values"), "extensible", "description", "source")


def match_names(left: DataFrame, right: DataFrame, by: list[str], out: str = "match") -> DataFrame:
    """Name of the row of ``right`` with the same name, else the first one with the same name in any case."""
    e, k = [f"__e_{c}" for c in by], [f"__l_{c}" for c in by]
    exact = right.select(*[F.col(c).alias(x) for c, x in zip(by, e)], F.col("name").alias("__exact")).distinct()
    loose = right.groupBy(*[F.col(c).alias(x) for c, x in zip(by, k)], F.lower("name").alias("__lower")).agg(F.min_by("name", "ord").alias("__loose"))
    joined = left.join(exact, [*[F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, e)], F.col("name") == F.col("__exact")], "left")
    joined = joined.join(loose, [*[F.col(c).eqNullSafe(F.col(x)) for c, x in zip(by, k)], F.lower("name") == F.col("__lower")], "left")
    return joined.withColumn(out, F.coalesce("__exact", "__loose")).drop("__exact", "__lower", "__loose", *e, *k)


def fill_blanks(rows: DataFrame, other: DataFrame, on: list[tuple[str, str]], column: str = "description") -> DataFrame:
    """Blanks of a column from another table, whose keys are unique."""
    o = other.select(*[F.col(b).alias(f"__k{i}") for i, (_, b) in enumerate(on)], F.col(column).alias("__fill"))
    joined = rows.join(o, [F.col(a) == F.col(f"__k{i}") for i, (a, _) in enumerate(on)], "left")
    return joined.withColumn(column, F.coalesce(blank(column), F.col("__fill"), F.lit(""))).drop("__fill", *[f"__k{i}" for i in range(len(on))])


def append_missing(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``other`` whose keys are new, case included."""
    return rows.unionByName(other.join(rows, keys, "left_anti"), allowMissingColumns=True)


def priority_match(rows: DataFrame, candidates: Column, targets: DataFrame, target: str, keys: list[str], on: list[str] | None = None) -> DataFrame:
    """Of an array of candidate names in order, the first that is in ``targets``; rows without one are left out."""
    on = on or []
    tried = rows.select("*", F.posexplode(candidates).alias("__prio", "__name"))
    t = targets.select(*[F.col(k).alias(f"__on_{k}") for k in on], F.col(target).alias("matched"))
    hit = tried.join(t, [*[F.col(k).eqNullSafe(F.col(f"__on_{k}")) for k in on], F.col("__name") == F.col("matched")]).drop(*[f"__on_{k}" for k in on])
    return first_wins(hit, keys, ["__prio"]).drop("__prio", "__name")


def canonical_names(entities: DataFrame, enums: DataFrame) -> DataFrame:
    """Names that references may mean: entities, then enums."""
    return entities.select("version", "name", "ord", F.lit(0).alias("kind")).unionByName(enums.select("version", "name", "ord", F.lit(1).alias("kind")))


def resolve(rows: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """A reference as it is if it is a name; else the last name that is the same in any case; else as it is."""
    exact = known.select(F.col("version").alias("__ev"), F.col("name").alias("__exact")).distinct()
    loose = known.groupBy(F.col("version").alias("__lv"), F.lower("name").alias("__lower")).agg(F.max_by("name", F.struct("kind", "ord")).alias("__loose"))
    joined = rows.join(exact, (F.col("version") == F.col("__ev")) & (F.col(column) == F.col("__exact")), "left")
    joined = joined.join(loose, (F.col("version") == F.col("__lv")) & (F.lower(column) == F.col("__lower")), "left")
    return joined.withColumn(column, F.coalesce("__exact", "__loose", F.col(column))).drop("__exact", "__lower", "__loose", "__ev", "__lv")


def normalise_references(properties: DataFrame, known: DataFrame) -> DataFrame:
    """J6 on both kinds of reference."""
    return resolve(resolve(properties, "reference_target", known), "array_item_type", known)


def edge_candidates(target: Column) -> Column:
    """Names that a reference may resolve to, best first."""
    pascal = F.when(target.rlike(r"^\p{Ll}"), F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 20)))
    bare = F.when(target.endswith("Map"), F.regexp_replace(target, "Map$", ""))
    return F.filter(F.array(target, names.camel(target), pascal, bare), lambda n: n.isNotNull())


def infer_edges(properties: DataFrame, entities: DataFrame) -> DataFrame:
    """G1: edges of references and of arrays of entities, one for each entity, target and property."""
    target = F.when(F.col("type") == "reference", blank("reference_target")).when(F.col("type") == "array", blank("array_item_type"))
    live = properties.where(~F.col("deprecated")).withColumn("__target", target).where("__target is not null")
    order = entities.select("version", F.col("name").alias("entity"), F.col("ord").alias("__eord"))
    hit = priority_match(live.join(order, ["version", "entity"]), edge_candidates(F.col("__target")), entities, "name", ["version", "entity", "name", "ord"], ["version"])
    many = F.col("cardinality").isin("0..*", "1..*")
    loose = F.translate(F.lower("name"), "_-", "")
    kind = F.when(loose.rlike("parent|ingredient"), "belongs_to").when((F.col("type") == "array") | many, "has_many").otherwise("has_one")
    edges = first_wins(hit, ["version", "entity", "matched", "name"], ["ord"])
    return edges.select(
        "version", F.lit("inferred").alias("scope"), (F.col("__eord") * 100_000 + F.col("ord")).alias("ord"), "name", F.col("entity").alias("source"),
        F.col("matched").alias("target"), kind.alias("type"), "description", F.when(F.col("type") == "array", "0..*").otherwise(F.col("cardinality")).alias("cardinality"),
    )


def dangling(references: DataFrame, known: DataFrame, builtin: tuple[str, ...] = PROPERTY_TYPES) -> DataFrame:
    """Distinct references of ``version, name`` that no name meets in any case, nor a built-in type."""
    r = references.where("name is not null and name <> ''").where(~F.col("name").isin(*builtin)).distinct() if builtin else references.where("name is not null and name <> ''").distinct()
    low = known.select(F.col("version").alias("__lv"), F.lower("name").alias("__lower")).distinct()
    return r.join(low, (F.col("version") == F.col("__lv")) & (F.lower("name") == F.col("__lower")), "left_anti")


def type_aliases(properties: DataFrame, known: DataFrame, external: dict[str, str]) -> DataFrame:
    """An alias for every dangling reference, by name; external ones from a small constant table."""
    refs = properties.select("version", F.explode(F.array("reference_target", "array_item_type")).alias("name"))
    note = names.literal_map(external, F.col("name"))
    rows = dangling(refs, known).withColumn("__note", note)
    return rows.select(
        "version", F.row_number().over(Window.partitionBy("version").orderBy("name")).cast("bigint").alias("ord"), "name", F.lit("").alias("cddl_name"),
        F.when(F.col("__note").isNotNull(), "external").otherwise(names.alias_base(F.col("name"))).alias("base_type"),
        F.coalesce("__note", F.lit("Type alias that the sources name without defining it")).alias("description"), F.col("__note").isNotNull().alias("external"),
    )
