"""The specification graph: a set of tables, for one version or many."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specloom.functions import text
from specloom.functions.lexicon import RFC2119, Lexicon
from specloom.operators import integrate, prose
from specloom.schemas import TABLES
from specloom.session import cut

#: Types that other standards define.
EXTERNAL = {name: f"{rule} structure (RFC 9052)" for name, rule in (("CoseSign1", "COSE_Sign1"), ("CoseKey", "COSE_Key"))}
#: What readers of the sources must know; a tree's own document may replace it.
CONVENTIONS = (
    '{"normative_language": {"keywords_of": "RFC 2119", "keywords": ["must", "shall", "should", "may"]}, "schema_notation": {"standard": "RFC 8610", "primary": true}, '
    '"precedence": ["schema definitions", "JSON Schema", "prose"], "naming": {"entities": "CamelCase of the rule name", "aliases": "rule names as written"}, "rule_ids": "VAL-<phase>-<number>"}'
)


@dataclass
class Graph:
    """One DataFrame for every table of :data:`specloom.schemas.TABLES`."""

    spec_version: DataFrame
    entity: DataFrame
    property: DataFrame
    relationship: DataFrame
    rule: DataFrame
    enum_type: DataFrame
    type_alias: DataFrame
    status_code: DataFrame
    convention: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(**{name: spark.createDataFrame([], ddl) for name, ddl in TABLES.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}

    def of(self, version: str) -> Graph:
        """The rows of one version; on stored tables only its partition is read."""
        return Graph(**{n: t.where(F.col("version") == version) for n, t in self.tables().items()})

    def add(self, table: str, rows: DataFrame) -> Graph:
        """With more rows; keyed tables keep the last row of a name, at the place of the first."""
        merged = getattr(self, table).unionByName(rows, allowMissingColumns=True)
        keys = {"entity": ["version", "name"], "enum_type": ["version", "name"], "type_alias": ["version", "name"]}.get(table)
        return replace(self, **{table: integrate.last_wins(merged, keys) if keys else merged})

    def cut(self) -> Graph:
        """The same tables, written and read again, so that what follows doesn't plan the build anew."""
        return Graph(**{n: cut(t) for n, t in self.tables().items()})

    def views(self, prefix: str = "") -> None:
        """Every table as a temporary view, for Spark SQL."""
        for name, t in self.tables().items():
            t.createOrReplaceTempView(prefix + name)

    def save(self, folder: str | Path) -> None:
        """Parquet tables, partitioned by version."""
        for name, t in self.tables().items():
            t.write.mode("overwrite").partitionBy("version").parquet(f"{folder}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, folder: str | Path) -> Graph:
        return cls(**{name: spark.read.schema(ddl).parquet(f"{folder}/{name}").select(*[c.strip().split(" ")[0] for c in ddl.split(",")]) for name, ddl in TABLES.items()})

    def counts(self) -> DataFrame:
        """A1: rows of every table by version."""
        out = None
        for name, t in self.tables().items():
            rows = t.where("scope = 'inferred'") if name == "relationship" else t
            one = rows.groupBy("version").agg(F.count("*").alias("n")).select("version", F.lit(name).alias("table"), "n")
            out = one if out is None else out.unionByName(one)
        return out


def merge_json(entity: DataFrame, prop: DataFrame, edge: DataFrame, js: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blanks filled from JSON Schema entities, and those of new names with any property appended."""
    entity, prop, edge, js = cut(entity), cut(prop), cut(edge), {k: cut(t) for k, t in js.items()}
    matched = cut(integrate.match_names(entity, js["entity"], ["version"], "js"))
    about = js["entity"].select("version", F.col("name").alias("js"), "description")
    filled = integrate.fill_blanks(matched, about, [("version", "version"), ("js", "js")])
    pairs = matched.select(F.col("version").alias("mv"), F.col("name").alias("mn"), "js")
    with_js = prop.join(pairs, (prop["version"] == pairs["mv"]) & (prop["entity"] == pairs["mn"]), "left").drop("mv", "mn")
    notes = js["property"].groupBy("version", F.col("entity").alias("js"), "name").agg(F.max_by("description", "ord").alias("description"))
    prop = integrate.fill_blanks(with_js, notes, [("version", "version"), ("js", "js"), ("name", "name")]).drop("js")
    last = integrate.last_wins(js["entity"], ["version", "name"])
    some = last.join(js["property"].select("version", F.col("entity").alias("name")).distinct(), ["version", "name"], "left_semi")
    offset = 1 << 40  # after all entities of the other source
    new = some.join(entity, ["version", "name"], "left_anti").withColumn("ord", F.col("ord") + offset)
    keys = new.select("version", F.col("name").alias("entity"))
    js_prop = js["property"].join(keys, ["version", "entity"], "left_semi")
    js_edge = js["relationship"].join(keys.withColumnRenamed("entity", "source"), ["version", "source"], "left_semi").withColumn("ord", F.col("ord") + offset)
    return filled.drop("js").unionByName(new, allowMissingColumns=True), prop.unionByName(js_prop), edge.unionByName(js_edge)


def merge_assertions(entity: DataFrame, docs: DataFrame) -> DataFrame:
    """Blank descriptions from assertion documents of ``version, stem, about``: the entity of that name, else the first blank one with a suffix."""
    exact = docs.join(entity.select("version", F.col("name").alias("stem")), ["version", "stem"], "left_semi")
    rest = docs.join(exact.select("version", "stem"), ["version", "stem"], "left_anti")
    blank = entity.where(F.coalesce("description", F.lit("")) == "")
    loose = integrate.priority_match(rest, F.array(F.concat("stem", F.lit("Assertion")), F.concat("stem", F.lit("Map"))), blank, "name", ["version", "stem"], ["version"])
    hits = exact.select("version", F.col("stem").alias("name"), "stem", "about").unionByName(loose.select("version", F.col("matched").alias("name"), "stem", "about"))
    # of several documents for an entity the first by name fills it
    notes = hits.groupBy("version", "name").agg(F.min_by("about", "stem").alias("description"))
    return integrate.fill_blanks(entity, notes, [("version", "version"), ("name", "name")])


def build(versions: DataFrame, cddl: dict[str, DataFrame], js: dict[str, DataFrame], validation: DataFrame, assertions: DataFrame, lexicon: Lexicon = RFC2119, conventions: str = CONVENTIONS) -> Graph:
    """All stages over the parsed sources of any number of versions; a source that a version lacks is skipped.

    The order is that of the sources' precedence: schemas, JSON Schema, assertion documents; then aliases of names
    that nothing defines, references as the names they mean, and edges.
    """
    entity, prop, edge = merge_json(cddl["entity"], cddl["property"], cddl["relationship"], js)
    docs = assertions.select("version", F.regexp_replace("file", r"\.adoc$", "").alias("stem"), text.assertion_description(F.col("text")).alias("about")).where("about is not null")
    entity, prop = cut(merge_assertions(entity, docs)), cut(prop)
    enum = cut(cddl["enum_type"])
    known = integrate.canonical_names(entity, enum)
    alias = integrate.type_aliases(prop, known, EXTERNAL)
    prop = cut(integrate.normalise_references(prop, known))
    edges = edge.unionByName(integrate.infer_edges(prop, entity))
    rules = prose.rules(validation, ["version"], lexicon)
    codes = prose.status_codes(validation, ["version"])
    convention = versions.select("version", F.lit(conventions).alias("document"))
    made = {"spec_version": versions, "entity": entity, "property": prop, "relationship": edges, "rule": rules, "enum_type": enum, "type_alias": alias, "status_code": codes, "convention": convention}
    return Graph(**{n: t.select(*[F.col(c.strip().split(" ")[0]).cast(c.strip().split(" ")[1]) for c in TABLES[n].split(",")]) for n, t in made.items()})


def build_trees(spark: SparkSession, trees: dict[str, str | Path], compat: bool = True) -> Graph:
    """The graph of the source trees of some versions, in one job."""
    from specloom.sources import cddl, files, json_schema, registry

    read = lambda kind: files.read(spark, trees, kind)
    versions = registry.version_table(spark).where(F.col("version").isin(*trees))
    return build(versions, cddl.tables(read("cddl"), compat), json_schema.tables(read("json_schema")), read("validation"), read("assertions"))
