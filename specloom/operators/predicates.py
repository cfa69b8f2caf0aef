"""Conformance predicates: the document's contract, its coverage, and conditions as columns.

A document is a row of ``doc`` and ``d``. One of any size may come in pieces, rows of the same ``doc`` that have some of
its predicates each and say the same of the document and its families otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRED = "STRUCT<predicate_id STRING, source_rules ARRAY<STRING>, severity STRING, title STRING, description STRING, condition STRING, test_vectors MAP<STRING, STRING>>"
SCHEMA = (
    f"spec_version STRING, predicate_schema_version STRING, format_families MAP<STRING, STRUCT<description STRING, mime_types ARRAY<STRING>, binding_mechanism STRING, predicates ARRAY<{_PRED}>>>, "
    f"cross_cutting STRUCT<description STRING, predicates ARRAY<{_PRED}>>, "
    "coverage_summary STRUCT<total_predicates BIGINT, rules_formalized BIGINT, total_v24_rules BIGINT, coverage_percent DOUBLE, format_coverage STRING>"
)
REQUIRED = tuple("spec_version predicate_schema_version format_families cross_cutting coverage_summary".split())
PREDICATE_ID, RULE_ID, STRENGTHS = "^PRED-[A-Z]+-[0-9]{3}$", "^VAL-[A-Z]+-[0-9]{4}$", ("shall", "must", "should", "may")
CROSS = "cross_cutting"


def read(spark: SparkSession, *documents: str) -> DataFrame:
    """Documents (JSON texts) as rows of the contract's shape; ``doc`` numbers them, ``raw`` is the text."""
    rows = spark.createDataFrame(list(enumerate(documents)), "doc int, raw string")
    return rows.select("doc", "raw", F.from_json("raw", SCHEMA).alias("d"))


def predicates(documents: DataFrame) -> DataFrame:
    """Predicates of all families and those of none, a row each."""
    family = documents.select("doc", F.explode("d.format_families").alias("family", "f")).select("doc", "family", F.explode("f.predicates").alias("p"))
    cross = documents.select("doc", F.lit(CROSS).alias("family"), F.explode("d.cross_cutting.predicates").alias("p"))
    return family.unionByName(cross).select("doc", "family", "p.*")


def _broken(df: DataFrame, subject: Column, *checks: tuple[str, Column]) -> DataFrame:
    """A row for every check that fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())
    return df.select("doc", subject.alias("subject"), F.explode(failed).alias("violation"))


def violations(documents: DataFrame) -> DataFrame:
    """What breaks the contract, ``doc, subject, violation``; none if all is well."""
    top = _broken(documents, F.lit("document"), *[(f"missing {c}", F.col(f"d.{c}").isNotNull()) for c in REQUIRED])
    fam = documents.select("doc", F.explode("d.format_families").alias("family", "f"))
    families = _broken(
        fam, F.col("family"), ("missing description", F.col("f.description").isNotNull()), ("missing binding_mechanism", F.col("f.binding_mechanism").isNotNull()),
        ("no mime type", F.size("f.mime_types") > 0), ("missing predicates", F.col("f.predicates").isNotNull()))
    # every piece of a document says them again
    once = top.unionByName(families).distinct()
    p = predicates(documents)
    op = F.get_json_object("condition", "$.op")
    entries = F.coalesce(F.map_entries("test_vectors"), F.array().cast("array<struct<key:string,value:string>>"))

    def some_vector(word: str, field: str) -> Column:
        """Whether a vector's key has ``word`` in it, or its value the field; or there are no vectors at all."""
        has = lambda v: F.coalesce(F.array_contains(F.json_object_keys(v), field), F.contains(v, F.lit(field)), F.lit(False))
        return F.isnull("test_vectors") | F.exists(entries, lambda e: F.contains(e["key"], F.lit(word)) | has(e["value"]))

    own = _broken(
        p, F.coalesce("predicate_id", F.lit("?")), ("bad id", F.col("predicate_id").rlike(PREDICATE_ID)), ("no source rule", F.size("source_rules") > 0),
        ("bad source rule", F.forall("source_rules", lambda r: r.rlike(RULE_ID))), ("bad severity", F.col("severity").isin(*STRENGTHS)), ("missing title", F.col("title").isNotNull()),
        ("missing description", F.col("description").isNotNull()), ("condition without op", op.isNotNull()), ("no passing vector", some_vector("passing", "expected_result")),
        ("no failing vector", some_vector("fail", "expected_status")))
    twice = p.groupBy("doc", F.col("predicate_id").alias("subject")).agg(F.count("*").alias("n")).where("n > 1").select("doc", "subject", F.lit("duplicate id").alias("violation"))
    return once.unionByName(own).unionByName(twice)


def dangling_rules(documents: DataFrame, rules: DataFrame) -> DataFrame:
    """Source rules that no rule has."""
    named = predicates(documents).select("doc", "predicate_id", F.explode("source_rules").alias("rule_id"))
    return named.join(rules.select("rule_id").distinct(), "rule_id", "left_anti").select("doc", "predicate_id", "rule_id")


def status_codes(documents: DataFrame) -> DataFrame:
    """Status codes that documents name, in conditions or as what a vector expects; ``doc, code``, each once.

    All of a document's text is searched where it is at hand (``raw``), else conditions and vectors.
    """
    pattern = F.lit(r'"(?:status|expected_status)":\s*"([^"]+)"')
    if "raw" in documents.columns:
        texts = documents.select("doc", F.col("raw").alias("text"))
    else:
        texts = predicates(documents).select("doc", F.concat_ws(" ", "condition", F.array_join(F.map_values("test_vectors"), " ")).alias("text"))
    return texts.select("doc", F.explode(F.regexp_extract_all("text", pattern, 1)).alias("code")).distinct()


def dangling_codes(documents: DataFrame, codes: DataFrame, label_prefix: str | None = None) -> DataFrame:
    """Named status codes that the graph (``code``) doesn't have; none where it has no codes at all.

    A code without a full stop is no proper one, and one that begins with ``label_prefix`` is an assertion's label.
    """
    named = status_codes(documents).where(F.contains("code", F.lit(".")))
    if label_prefix:
        named = named.where(~F.startswith("code", F.lit(label_prefix)))
    some = codes.select(F.lit(True).alias("__some")).limit(1)
    return named.join(codes.select("code").distinct(), "code", "left_anti").join(some, how="cross").select("doc", "code")


def delegations(documents: DataFrame) -> DataFrame:
    """Whom predicates delegate to: the listed ones of a condition that is a delegation."""
    listed = F.from_json(F.get_json_object("condition", "$.to_predicates"), "array<string>")
    return predicates(documents).where(F.get_json_object("condition", "$.op") == "delegate").select("doc", "predicate_id", F.explode(listed).alias("target"))


def dangling_delegations(documents: DataFrame) -> DataFrame:
    """Delegations to predicates that aren't there."""
    ids = predicates(documents).select("doc", F.col("predicate_id").alias("target")).distinct()
    return delegations(documents).join(ids, ["doc", "target"], "left_anti").select("doc", "predicate_id", "target")


def coverage(documents: DataFrame) -> DataFrame:
    """Predicates, rules and vectors of every document, and whether its summary says the same."""
    p = predicates(documents)
    rules = p.select("doc", F.explode("source_rules").alias("r")).groupBy("doc").agg(F.count_distinct("r").alias("rules_formalized"))
    with_vectors = F.isnotnull("test_vectors").cast("double")
    counted = p.groupBy("doc").agg(F.count("*").alias("total_predicates"), F.avg(with_vectors).alias("vector_share"))
    said = documents.select("doc", F.col("d.coverage_summary.total_predicates").alias("said_predicates"), F.col("d.coverage_summary.rules_formalized").alias("said_rules")).distinct()
    return counted.join(rules, "doc", "left").join(said, "doc").select(
        "doc", "total_predicates", "rules_formalized", "vector_share", (F.col("vector_share") >= 0.8).alias("enough_vectors"),
        (F.col("total_predicates").eqNullSafe(F.col("said_predicates")) & F.col("rules_formalized").eqNullSafe(F.col("said_rules"))).alias("reconciled"))


def _between(size: Column, c: dict[str, Any]) -> Column:
    out = F.lit(True)
    for key, test in (("min", size.__ge__), ("max", size.__le__), ("value", size.__eq__)):
        if key in c:
            out = out & test(c[key])
    return out


_COMPARE: dict[str, Callable[[Column, dict[str, Any]], Column]] = {
    "exists": lambda v, c: v.isNotNull(),
    "equals": lambda v, c: v.eqNullSafe(F.lit(c["value"])),
    "not_equals": lambda v, c: v != F.lit(c["value"]),
    "in": lambda v, c: v.isin(*c["values"]),
    "not_in": lambda v, c: ~v.isin(*c["values"]),
    "greater_than": lambda v, c: v > c["value"],
    "at_least": lambda v, c: v >= c["value"],
    "less_than": lambda v, c: v < c["value"],
    "at_most": lambda v, c: v <= c["value"],
    "matches": lambda v, c: v.rlike(c["pattern"]),
    "contains": lambda v, c: F.array_contains(v, c["value"]) if c.get("of") == "array" else F.contains(v, F.lit(c["value"])),
    "starts_with": lambda v, c: F.startswith(v, F.lit(c["value"])),
    "ends_with": lambda v, c: F.endswith(v, F.lit(c["value"])),
    "count": lambda v, c: v.isNotNull() & _between(F.size(v), c),
}


def compile_condition(condition: dict[str, Any] | str, field: Callable[[str], Column] = F.col, delegate: Callable[[str], Column] | None = None) -> Column:
    """A condition as one Boolean column, for any number of rows without Python at run time.

    ``and``, ``or``, ``not`` and ``implies`` (``if``, ``then``) join conditions; ``delegate`` asks the predicates in
    ``to_predicates``, all of which must hold. Of fields, ``exists``, ``equals``, ``not_equals``, ``in``, ``not_in``,
    ``greater_than``, ``at_least``, ``less_than``, ``at_most``, ``matches`` (a regular expression), ``contains`` (text,
    or an array with ``"of": "array"``), ``starts_with`` and ``ends_with`` compare the value, ``count`` an array's size with ``value``, or
    ``min`` and ``max``, and ``all`` and ``any`` test the elements of an array by ``condition``, whose fields are the
    element's; ``field`` left out there is the element. What compares a value that isn't there doesn't hold.
    ValueError names any other operator.
    """
    c = json.loads(condition) if isinstance(condition, str) else condition
    op = c.get("op")
    inner = lambda key="conditions": [compile_condition(x, field, delegate) for x in c.get(key, c.get("args", []))]
    if op in ("and", "or"):
        out = F.lit(op == "and")
        for x in inner():
            out = (out & x) if op == "and" else (out | x)
        return out
    if op == "not":
        return ~compile_condition(c["condition"], field, delegate)
    if op == "implies":
        return ~compile_condition(c["if"], field, delegate) | compile_condition(c["then"], field, delegate)
    if op == "delegate" and delegate is not None:
        out = F.lit(True)
        for name in c["to_predicates"]:
            out = out & delegate(name)
        return out
    if op in _COMPARE:
        return F.coalesce(_COMPARE[op](field(c.get("field", "")), c), F.lit(False))
    if op in ("all", "any"):
        test = F.forall if op == "all" else F.exists
        return F.coalesce(test(field(c["field"]), lambda x: compile_condition(c["condition"], lambda name: x[name] if name else x, delegate)), F.lit(False))
    raise ValueError(f"unknown condition operator {op!r}")


def evaluate(rows: DataFrame, conditions: dict[str, dict[str, Any]], keys: list[str]) -> DataFrame:
    """Whether rows meet predicates, by id, in one pass; a predicate may delegate to another, not to itself in a circle."""
    made: dict[str, Column] = {}
    open_ids: list[str] = []

    def build(name: str) -> Column:
        if name in open_ids:
            raise ValueError(f"predicates delegate in a circle: {' > '.join([*open_ids, name])}")
        if name not in conditions:
            raise ValueError(f"no predicate {name}")
        if name not in made:
            open_ids.append(name)
            made[name] = compile_condition(conditions[name], F.col, build)
            open_ids.pop()
        return made[name]

    results = F.array(*[F.struct(F.lit(n).alias("predicate_id"), F.coalesce(build(n), F.lit(False)).alias("ok")) for n in sorted(conditions)])
    return rows.select(*keys, F.inline(results))
