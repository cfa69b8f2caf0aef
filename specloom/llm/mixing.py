"""Operator 6, mixing sources to target weights: tempered shares, realised as budgeted block permutations.

A source's share of the tokens is raised to an exponent and normalised. The exponent is bisected until the
weights reach a target entropy, and until no source must be repeated more often than a limit; of the two exponents the
larger one binds, so that a tiny source is never repeated beyond the limit for the entropy's sake. A source's budget
is its weight of all tokens drawn; it is filled by passes over the source's documents, each pass in another
permutation of blocks and of the documents in a block, the last one cut off at the budget. A source of n tokens has
about sqrt(n) blocks, so that neither the order of its blocks nor the order in a block is more than sqrt(n) rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specloom.llm.common import pick, ready, small
from specloom.session import table

SEED = "mix"
#: Entropy that the weights must have, as a share of the entropy of equal weights.
ENTROPY = 0.98
#: Most passes over any source for that entropy: about as many as repeated text is worth nearly as much as new text.
LIMIT = 4.0
#: Most passes over any source where the limit alone counts.
REPEATS = 2.0
STEPS = 50

#: A token here is a run of characters other than space, tab and line ends.
TOKENS = r"[^ \t\r\n]+"


def tempered(shares: list[float], exponent: float) -> list[float]:
    powers = [s**exponent if s > 0 else 0.0 for s in shares]
    total = sum(powers) or 1.0
    return [p / total for p in powers]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def exponent_for(tokens: list[int], target_entropy: float | None = None, repeats: float | None = None, steps: int = STEPS) -> float:
    """The largest exponent in [0, 1] with at least the entropy, or the smallest with at most the repeats if that is larger.

    Entropy falls and repeats fall as the exponent grows. At 1 a source keeps its own share; at 0 all weigh the
    same. Where even 0 misses the entropy, or even 1 the limit, that end is taken. Repeats are counted against the
    largest source, which is passed over exactly once. Without either aim every source keeps its share.
    """
    total = sum(tokens)
    shares = [t / total for t in sorted(tokens) if t > 0] if total else []
    if len(shares) < 2:
        return 1.0

    def mixed(a: float) -> bool:
        return entropy(tempered(shares, a)) >= target_entropy * math.log(len(shares))

    def repeated(a: float) -> bool:
        w = tempered(shares, a)
        return max(x / s for x, s in zip(w, shares)) > repeats * min(x / s for x, s in zip(w, shares))

    def bisect(rise) -> tuple[float, float]:
        low, high = 0.0, 1.0
        for _ in range(steps):
            mid = (low + high) / 2
            low, high = (mid, high) if rise(mid) else (low, mid)
        return low, high

    ends = [bisect(mixed)[0]] if target_entropy is not None else []
    ends += [bisect(repeated)[1]] if repeats is not None else []
    return max(ends, default=1.0)


def budgets(sizes: dict, target_entropy: float | None = None, repeats: float | None = None, total: int | None = None) -> dict:
    """Tokens to draw from every source: by default so many that no source is drawn less than once."""
    return {n: budget for n, (_, budget) in _weighed(sizes, exponent_for(list(sizes.values()), target_entropy, repeats), total).items()}


def _weighed(sizes: dict, exponent: float, total: int | None = None) -> dict:
    """Weight and budget of every source."""
    names = sorted(sizes, key=lambda s: (s is not None, s))
    tokens = [sizes[n] for n in names]
    if not sum(tokens):
        return {n: (0.0, 0) for n in names}
    weights = tempered([t / sum(tokens) for t in tokens], exponent)
    draw = max(t / w for t, w in zip(tokens, weights) if w > 0) if total is None else total
    return {n: (w, max(0, round(w * draw)) if t else 0) for n, w, t in zip(names, weights, tokens)}


def _source(columns: list[str]) -> F.Column:
    return F.col("source").cast("string") if "source" in columns else F.lit(None).cast("string")


def plan(docs: DataFrame, target_entropy: float | None = ENTROPY, repeats: float | None = LIMIT) -> DataFrame:
    """What ``mix`` draws: tokens, weight, budget and repeats of every source, with the exponent and the entropy that it reached (as a share of the most)."""
    spark = ready(docs)
    counted = docs.groupBy(_source(docs.columns).alias("source")).agg(F.sum(_tokens()).alias("n"))
    per = {r[0]: r[1] for r in counted.collect()}  # a row per source
    a = exponent_for(list(per.values()), target_entropy, repeats)
    weighed = _weighed(per, a)
    live = sum(1 for n in per.values() if n)
    reached = entropy(sorted(w for w, _ in weighed.values())) / math.log(live) if live > 1 else 1.0
    rows = [(s, per[s], w, b, b / per[s] if per[s] else 0.0, a, reached) for s, (w, b) in weighed.items()]
    return spark.createDataFrame(rows, "source string, tokens long, weight double, budget long, repeats double, exponent double, entropy double")


def _tokens() -> F.Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(TOKENS)).cast("long")


def mix(docs: DataFrame, target_entropy: float | None = ENTROPY, repeats: float | None = LIMIT, total: int | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` drawn to the budgets, with ``mix_pass``, ``mix_block`` and ``mix_order`` (columns of those names are replaced).

    A document without tokens (NULL or blank text) is drawn once, in pass 0. NULL is a source of its own; sources that
    aren't strings are known by their text. Repeated rows count each. A document that begins before its source's budget is reached is drawn whole, so a source
    exceeds its budget by less than one document. Ties in the permutation fall to the smaller id, then text hash.
    An empty table gives an empty one.
    """
    spark = ready(docs)
    have = [c for c in docs.columns if c not in ("mix_pass", "mix_block", "mix_order")]
    d = docs.select(*[F.col(f"`{c}`") for c in have])
    text = F.coalesce(F.col("text"), F.lit(""))
    # the payload stays out of all shuffles but the last join: keys and counts only
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("t"), F.md5(text)))
    keyed = d.withColumn("__mix_key", key).withColumn("__mix_src", _source(have))
    slim = keyed.select("__mix_key", "__mix_src", _tokens().alias("n")).groupBy("__mix_src", "__mix_key").agg(F.sum("n").alias("n")).checkpoint()
    per = {r[0]: r[1] for r in slim.groupBy("__mix_src").agg(F.sum("n")).collect()}  # a row per source
    budget = budgets(per, target_entropy, repeats, total)
    drawn_from = [(s, n, budget[s], -(-budget[s] // n) if n else 1, max(1, math.isqrt(n))) for s, n in per.items()]
    sources = small(spark.createDataFrame(drawn_from, "s string, size long, budget long, passes long, blocks long"))
    mixed = (
        slim.join(sources, slim["__mix_src"].eqNullSafe(sources["s"]))
        .withColumn("mix_pass", F.explode(F.expr("sequence(0, cast(greatest(passes, 1) - 1 as int))")))
        .where("n > 0 or mix_pass = 0")
        .withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), F.col("mix_pass"), F.col("__mix_key"))))
        .withColumn("mix_block", F.pmod(F.conv(F.substring("h", 1, 12), 16, 10).cast("long"), F.col("blocks")))
    )
    # blocks in permuted order: their sizes are few rows, so that their running sum needs no large window
    block = (
        mixed.groupBy("__mix_src", "mix_pass", "mix_block").agg(F.sum("n").alias("block_n"))
        .withColumn("bh", F.md5(F.concat_ws("|", F.lit(seed), F.lit("b"), F.coalesce("__mix_src", F.lit("")), F.col("mix_pass"), F.col("mix_block"))))
        .withColumn("before", F.sum("block_n").over(Window.partitionBy("__mix_src", "mix_pass").orderBy("bh", "mix_block").rowsBetween(Window.unboundedPreceding, -1)))
        .select(F.col("__mix_src").alias("bs"), F.col("mix_pass").alias("bp"), F.col("mix_block").alias("bb"), F.coalesce("before", F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("__mix_src", "mix_pass", "mix_block").orderBy("h", "__mix_key").rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        mixed.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(block, F.col("__mix_src").eqNullSafe(F.col("bs")) & (F.col("mix_pass") == F.col("bp")) & (F.col("mix_block") == F.col("bb")))
        .withColumn("mix_order", F.col("mix_pass") * F.col("size") + F.col("before") + F.col("inside"))
        .where((F.col("mix_order") < F.col("budget")) | ((F.col("n") == 0) & (F.col("mix_pass") == 0)))
        .select(F.col("__mix_key").alias("__k"), F.col("__mix_src").alias("__s"), "mix_pass", "mix_block", "mix_order")
    )
    return keyed.join(drawn, (keyed["__mix_key"] == drawn["__k"]) & keyed["__mix_src"].eqNullSafe(drawn["__s"])).select(*[F.col(f"`{c}`") for c in have], "mix_pass", "mix_block", "mix_order")


def mix_rows(docs: DataFrame, repeats: float = REPEATS) -> DataFrame:
    """``mix`` to a repetition limit with the columns of ``docs`` alone: every document once, those of small sources up to ``repeats`` times."""
    return mix(docs, None, repeats).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to weights of the target entropy: pass, block and token position in the source's order."""
    return mix(pick(table(spark, sf_dir, "documents"), "doc_id", "source", "text")).select("doc_id", "source", "mix_pass", "mix_block", "mix_order")


def op6_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, budgets and repeats of the sources, with the entropy that they reach."""
    p = plan(table(spark, sf_dir, "documents"))
    return p.select("source", "tokens", F.round("weight", 9).alias("weight"), "budget", *[F.round(c, 9).alias(c) for c in ("repeats", "exponent", "entropy")])


_SQL = f"""
WITH RECURSIVE slim AS (
  SELECT coalesce(doc_id::VARCHAR, 't' || md5(coalesce(text, ''))) AS k, source AS s,
         sum(len(regexp_extract_all(coalesce(text, ''), '{TOKENS}'))) AS n, count(*) AS copies, any_value(doc_id) AS doc_id
  FROM documents GROUP BY ALL),
per AS (SELECT s, sum(n)::BIGINT AS size, sum(n) / (SELECT sum(n) FROM slim)::DOUBLE AS share FROM slim GROUP BY s),
bisect(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high,
          (SELECT -sum((p / z) * ln(p / z)) FROM (SELECT pow(share, (low + high) / 2) AS p, sum(pow(share, (low + high) / 2)) OVER () AS z FROM per))
            >= {ENTROPY} * ln((SELECT count(*) FROM per)::DOUBLE) AS up
        FROM bisect WHERE i < {STEPS})),
again(i, low, high) AS (
  SELECT 0, 0::DOUBLE, 1::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END
  FROM (SELECT i, low, high,
          (SELECT max(p / z / share) > {LIMIT} * min(p / z / share) FROM (SELECT share, pow(share, (low + high) / 2) AS p, sum(pow(share, (low + high) / 2)) OVER () AS z FROM per)) AS up
        FROM again WHERE i < {STEPS})),
weights AS (SELECT s, size, a, pow(share, a) / sum(pow(share, a)) OVER () AS w FROM per, (SELECT greatest((SELECT low FROM bisect WHERE i = {STEPS}), (SELECT high FROM again WHERE i = {STEPS})) AS a)),
plan AS (SELECT s, size, budget, unnest(range(greatest(1, ceil(budget / size)::BIGINT)))::INT AS mix_pass, greatest(1, floor(sqrt(size))::BIGINT) AS blocks
  FROM (SELECT s, size, round(w * (SELECT max(size / w) FROM weights))::BIGINT AS budget FROM weights)),
mixed AS (
  SELECT slim.*, size, budget, mix_pass, md5(concat_ws('|', '{SEED}', mix_pass, k)) AS h,
         ('0x' || substr(md5(concat_ws('|', '{SEED}', mix_pass, k)), 1, 12))::BIGINT % blocks AS mix_block
  FROM slim JOIN plan ON slim.s IS NOT DISTINCT FROM plan.s WHERE n > 0 OR mix_pass = 0),
block AS (SELECT s, mix_pass, mix_block, sum(bn) OVER (PARTITION BY s, mix_pass ORDER BY md5(concat_ws('|', '{SEED}', 'b', coalesce(s, ''), mix_pass, mix_block)), mix_block) - bn AS before
  FROM (SELECT s, mix_pass, mix_block, sum(n) AS bn FROM mixed GROUP BY ALL))
SELECT doc_id, source, mix_pass, mix_block, mix_order FROM (
  SELECT m.doc_id, m.s AS source, m.mix_pass, m.mix_block, n, copies, budget,
         (m.mix_pass * size + before + sum(n) OVER (PARTITION BY m.s, m.mix_pass, m.mix_block ORDER BY h, k) - n)::BIGINT AS mix_order
  FROM mixed m JOIN block b ON m.s IS NOT DISTINCT FROM b.s AND m.mix_pass = b.mix_pass AND m.mix_block = b.mix_block), unnest(range(copies)) AS u(x)
WHERE mix_order < budget OR (n = 0 AND mix_pass = 0)
"""

_PLAN_SQL = f"""{_SQL[: _SQL.index("plan AS")]}
all_weights AS (SELECT *, round(w * max(size / w) OVER ())::BIGINT AS budget, -sum(w * ln(w)) OVER () / ln((count(*) OVER ())::DOUBLE) AS entropy FROM weights)
SELECT s AS source, size AS tokens, round(w, 9) AS weight, budget, round(budget / size, 9) AS repeats, round(a, 9) AS exponent, round(entropy, 9) AS entropy FROM all_weights
"""

QUERIES = {"op6_mixing": op6_mixing, "op6_plan": op6_plan}
ORACLES = {"op6_mixing": _SQL, "op6_plan": _PLAN_SQL}
