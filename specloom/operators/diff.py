"""Snapshot diffs with rename detection.

Both snapshots are tables with the same keys; every diff is a full outer join on them. Renames are candidates found
by equi-joins (shared properties, normalised names), scored, and matched one to one by an ordered greedy fold.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specloom.functions import names
from specloom.session import cut

ENTITY_SCORE, PROPERTY_SCORE = 0.7, 0.6
CHANGE = ("kind", "ord", "entity", "change", "details", "old_value", "new_value")


def outer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Both sides of every key as structs ``o`` and ``n``, one of them NULL where the key is of one side only."""
    a = old.select(*[F.col(k).alias(f"__a{i}") for i, k in enumerate(keys)], F.struct(*old.columns).alias("o"))
    b = new.select(*[F.col(k).alias(f"__b{i}") for i, k in enumerate(keys)], F.struct(*new.columns).alias("n"))
    joined = a.join(b, [a[f"__a{i}"] == b[f"__b{i}"] for i in range(len(keys))], "full_outer")
    return joined.select(*[F.coalesce(f"__a{i}", f"__b{i}").alias(k) for i, k in enumerate(keys)], "o", "n")


def status(differs: Column) -> Column:
    """U1 and U2 of an outer join: added, removed, modified, or NULL."""
    return F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(differs, "modified")


def greedy(candidates: DataFrame, keys: list[str], old: str = "old", new: str = "new", score: str = "score") -> DataFrame:
    """One-to-one pairs: in order of ``old``, each takes its best ``new`` that is still free.

    Of equal scores the smaller name wins. Within ``keys`` a group's candidates fold in one row, and groups are
    independent. Without keys there is but one group, of any size. A large one is matched by rounds of offers: every
    old name offers to its best new one that hasn't turned it down, and each new one holds the first in order that has
    come and turns down all later ones. Once no offer is turned down, the held ones are the same pairs.
    """
    if not keys:
        return _offers(candidates.select(F.col(old).alias("o"), F.col(new).alias("n"), F.col(score).alias("s"))).select(F.col("o").alias(old), F.col("n").alias(new))
    kind = dict(candidates.dtypes)
    ranked = candidates.groupBy(*keys, old).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(new).alias("n")))).alias("c"))
    group = ranked.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(old).alias("o"), F.col("c.n").alias("ns")))).alias("g"))
    fold = F.expr(
        f"aggregate(g, cast(array() as array<struct<o:{kind[old]},n:{kind[new]}>>), (acc, e) -> concat(acc, "
        "transform(slice(filter(e.ns, n -> not exists(acc, m -> m.n = n)), 1, 1), n -> named_struct('o', e.o, 'n', n))))"
    )
    return group.select(*keys, F.inline(fold)).withColumnsRenamed({"o": old, "n": new})


#: So many candidates are matched in one pass of one task, and more after so many rounds of offers.
FOLD, ROUNDS = 1 << 20, 4


def _offers(left: DataFrame) -> DataFrame:
    """Pairs ``o, n`` by rounds of offers; each round is a checkpoint of the candidates that are left.

    Where all want the same ones, each round settles but one pair, so few candidates, and what a few rounds leave, are
    matched in order instead.
    """
    left = cut(left)
    for _ in range(ROUNDS):
        if left.count() <= FOLD:
            break
        offer = left.groupBy("o").agg(F.min(F.struct((-F.col("s")).alias("s"), "n"))["n"].alias("n"))
        held = cut(offer.groupBy("n").agg(F.min("o").alias("first"), F.count("*").alias("offers")))
        # whoever comes after the one that is held can't get it any more
        if not held.where("offers > 1").limit(1).count():
            return held.select(F.col("first").alias("o"), "n")
        left = cut(left.join(held.select("n", "first"), "n", "left").where("first is null or o <= first").select("o", "n", "s"))
    return _in_order(left)


def _in_order(left: DataFrame) -> DataFrame:
    """Pairs ``o, n`` of candidates in one pass over them in order, sorted on disk; only the names that are taken are kept in memory."""
    kind = dict(left.dtypes)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, last = set(), None
        for batch in batches:
            olds, news = [], []
            for o, n in zip(*(c.to_pylist() for c in batch.columns)):
                if o != last and n not in taken:
                    taken.add(n)
                    last = o
                    olds.append(o)
                    news.append(n)
            yield pa.record_batch([pa.array(x, c.type) for x, c in zip((olds, news), batch.columns)], batch.schema.names)

    return left.repartition(1).sortWithinPartitions("o", F.col("s").desc(), "n").select("o", "n").mapInArrow(match, f"o {kind['o']}, n {kind['n']}")


def greedy_alike(old: DataFrame, new: DataFrame, keys: list[str], least: float) -> DataFrame:
    """``greedy`` over all pairs of ``old`` and ``new`` of the same keys whose names are alike by ``least``.

    No pair is made unless a name asks for it: each old name in order looks for its likest new one among the free, until
    none is free. A group is a row of its names, of either side, and groups are independent.
    """
    side = lambda df, c: df.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct(F.col(c).alias("name"), F.lower(c).alias("low")))).alias(c))
    named = side(old.where("old is not null"), "old").join(side(new.where("new is not null"), "new"), keys)
    kind = dict(old.dtypes) | dict(new.dtypes)
    pair = f"array<struct<old:{kind['old']},new:{kind['new']}>>"

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *group, olds, news = batch.columns
            for i in range(batch.num_rows):
                free, others, out = olds[i].as_py(), news[i].as_py(), []
                alike = names.Alike([x["low"] for x in others])
                for x in free:
                    if not len(alike.free):
                        break
                    if (j := alike.take(x["low"], least)) is not None:
                        out.append({"old": x["name"], "new": others[j]["name"]})
                kind = pa.list_(pa.struct([("old", pa.string()), ("new", pa.string())]))
                yield pa.record_batch([*[g.slice(i, 1) for g in group], pa.array([out], kind)], [*keys, "pairs"])

    # groups differ in work more than in bytes, by which partitions would be joined
    spread = named.repartition(int(old.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    made = spread.mapInArrow(match, ", ".join([*[f"{k} {kind[k]}" for k in keys], f"pairs {pair}"]))
    return made.select(*keys, F.inline("pairs"))


def overlap_candidates(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """Pairs of ``name, items`` rows by Jaccard similarity of at least ``least`` (above 0), of ``old, new, jaccard``.

    Sets that are both empty are alike by definition.
    """
    a = old.select(F.col("name").alias("old"), F.array_distinct("items").alias("oi"))
    b = new.select(F.col("name").alias("new"), F.array_distinct("items").alias("ni"))
    empty = a.where("size(oi) = 0").select("old").crossJoin(b.where("size(ni) = 0").select("new")).withColumn("jaccard", F.lit(1.0))
    return item_overlaps(a.select("old", F.explode("oi").alias("i")), b.select("new", F.explode("ni").alias("i")), least).unionByName(empty)


def item_overlaps(old: DataFrame, new: DataFrame, least: float) -> DataFrame:
    """J10 and P32 on distinct ``old, i`` and ``new, i``: a pair that similar shares an item, so it is an equi-join on items; of the sets only their sizes are joined to it."""
    a, b = old.groupBy("old").agg(F.count("*").alias("os")), new.groupBy("new").agg(F.count("*").alias("ns"))
    pairs = old.join(new, "i").groupBy("old", "new").agg(F.count("*").alias("both"))
    scored = pairs.join(a, "old").join(b, "new").select("old", "new", (F.col("both") / (F.col("os") + F.col("ns") - F.col("both"))).alias("jaccard"))
    return scored.where(F.col("jaccard") >= least)


def rename_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs ``old, new`` of entities (``name, aliases, items``) that are in one snapshot only."""
    a, b = old.join(new, "name", "left_anti"), new.join(old, "name", "left_anti")
    index = a.select("name", F.explode("aliases").alias("alias")).groupBy(names.normalise(F.col("alias")).alias("key")).agg(F.min("name").alias("new"))
    tries = b.select(F.col("name").alias("old"), F.posexplode("aliases").alias("p", "alias")).withColumn("key", names.normalise(F.col("alias")))
    # the roles are swapped: in order of the new names, each takes the old one of its first alias
    by_alias = greedy(tries.join(index, "key").groupBy("old", "new").agg(F.min("p").alias("p")).withColumn("score", -F.col("p")), []).select(F.col("new").alias("old"), F.col("old").alias("new"))
    by_alias = cut(by_alias)
    a2 = a.join(by_alias.select(F.col("old").alias("name")), "name", "left_anti")
    b2 = b.join(by_alias.select(F.col("new").alias("name")), "name", "left_anti")
    # a name adds 0.4 at most, so less overlap than this can't reach the score
    near = overlap_candidates(a2, b2, (ENTITY_SCORE - 0.4) / 0.6 - 1e-9)
    scored = near.withColumn("score", F.lit(0.6) * F.col("jaccard") + F.lit(0.4) * names.name_similarity(F.col("old"), F.col("new"))).where(F.col("score") >= ENTITY_SCORE)
    return by_alias.unionByName(greedy(scored, []).select("old", "new"))


def rename_properties(pairs: DataFrame) -> DataFrame:
    """D3: of an outer join by ``entity, name``, the pairs of one-sided properties with equal signatures and like names."""
    sig = [F.struct(*[F.col(f"{s}.{c}").alias(c) for c in names.SIGNATURE]) for s in ("o", "n")]
    gone = pairs.where("n is null").select("entity", F.col("name").alias("old"), sig[0].alias("sig"))
    came = pairs.where("o is null").select("entity", F.col("name").alias("new"), sig[1].alias("sig"))
    same = gone.join(came, ["entity", "sig"]).withColumn("score", names.name_similarity(F.col("old"), F.col("new"), PROPERTY_SCORE)).where(F.col("score") >= PROPERTY_SCORE)
    return greedy(same, ["entity"])


def diff_properties(old: DataFrame, new: DataFrame) -> DataFrame:
    """``entity`` and ``details`` of entities whose properties (by ``entity, name``) differ."""
    pairs = cut(outer(old, new, ["entity", "name"]))
    renamed = cut(rename_properties(pairs))
    sig = [F.struct(*[F.col(f"{s}.{c}").alias(c) for c in names.SIGNATURE]) for s in ("o", "n")]
    changed = pairs.withColumn("what", status(~sig[0].eqNullSafe(sig[1]))).where("what is not null")
    change = F.when(F.col("what") == "modified", F.concat("name", F.lit(": "), names.describe_change(sig[0], sig[1]))).otherwise(F.col("name"))
    used = renamed.select("entity", F.col("old").alias("name"), F.lit("removed").alias("what")).unionByName(renamed.select("entity", F.col("new").alias("name"), F.lit("added").alias("what")))
    lone = changed.select("entity", "name", "what", change.alias("text")).join(used, ["entity", "name", "what"], "left_anti")
    parts = lone.unionByName(renamed.select("entity", F.col("old").alias("name"), F.lit("renamed").alias("what"), F.concat("old", F.lit(" -> "), "new").alias("text")))
    listed = parts.groupBy("entity").agg(
        *[F.transform(F.sort_array(F.collect_list(F.when(F.col("what") == w, F.struct("name", "text")))), lambda x: x["text"]).alias(w) for w in ("renamed", "added", "removed", "modified")]
    )
    shown = [F.when(F.size(w) > 0, F.concat(F.lit(f"{w} properties: "), F.array_join(w, "; " if w == "modified" else ", "))) for w in ("renamed", "added", "removed", "modified")]
    return listed.select("entity", F.concat_ws(" | ", *shown).alias("details"))


def _entities(entities: DataFrame, properties: DataFrame) -> DataFrame:
    items = properties.groupBy(F.col("entity").alias("name")).agg(F.collect_set("name").alias("items"), F.count("*").alias("n_props"))
    return entities.select("name", "aliases", "deprecated").join(items, "name", "left").withColumns({"items": F.coalesce("items", F.array().cast("array<string>")), "n_props": F.coalesce("n_props", F.lit(0))})


def diff_entities(old: DataFrame, new: DataFrame, old_props: DataFrame, new_props: DataFrame) -> DataFrame:
    """Renamed, added, removed, then modified and deprecated entities; a newly deprecated one isn't compared further."""
    a, b = cut(_entities(old, old_props)), cut(_entities(new, new_props))
    renames = cut(rename_entities(a, b))
    # properties of a renamed entity are compared under its new name
    moved = old_props.join(renames, old_props["entity"] == renames["old"], "left")
    moved = moved.withColumn("entity", F.coalesce(F.col("new"), old_props["entity"])).drop("old", "new")
    both = b.select(F.col("name").alias("entity")).join(a.select(F.col("name").alias("entity")).unionByName(renames.select(F.col("new").alias("entity"))), "entity", "left_semi")
    details = cut(diff_properties(moved.join(both, "entity", "left_semi"), new_props.join(both, "entity", "left_semi")))
    null = F.lit(None).cast("string")
    renamed = renames.join(details, renames["new"] == details["entity"], "left").select(
        F.lit(0).alias("ord"), F.col("new").alias("entity"), F.lit("renamed").alias("change"), F.concat_ws(" | ", F.concat("old", F.lit(" -> "), "new"), "details").alias("details"),
        F.col("old").alias("old_value"), F.col("new").alias("new_value"),
    )
    added = b.join(a, "name", "left_anti").join(renames.select(F.col("new").alias("name")), "name", "left_anti").select(
        F.lit(1).alias("ord"), F.col("name").alias("entity"), F.lit("added").alias("change"), F.format_string("Added entity with %d properties", "n_props").alias("details"), null.alias("old_value"), F.col("name").alias("new_value")
    )
    removed = a.join(b, "name", "left_anti").join(renames.select(F.col("old").alias("name")), "name", "left_anti").select(
        F.lit(2).alias("ord"), F.col("name").alias("entity"), F.lit("removed").alias("change"), F.lit("Entity removed").alias("details"), F.col("name").alias("old_value"), null.alias("new_value")
    )
    kept = a.select("name", F.col("deprecated").alias("was")).join(b.select("name", "deprecated"), "name")
    newly = ~F.col("was") & F.col("deprecated")
    changed = kept.join(details, kept["name"] == details["entity"], "left").where(newly | F.col("details").isNotNull()).select(
        F.lit(3).alias("ord"), F.col("name").alias("entity"), F.when(newly, "deprecated").otherwise("modified").alias("change"),
        F.when(newly, "Entity marked deprecated").otherwise(F.col("details")).alias("details"), null.alias("old_value"), null.alias("new_value"),
    )
    return renamed.unionByName(added).unionByName(removed).unionByName(changed).withColumn("kind", F.lit("entity")).select(*CHANGE)


def diff_rules(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rules (``rule_id, severity, phase, description``) by id."""
    pairs = outer(old, new, ["rule_id"])
    differs = [F.when(~F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")), F.concat(F.lit(f"{c}: "), f"o.{c}", F.lit(" -> "), f"n.{c}")) for c in ("severity", "phase")]
    differs.append(F.when(~F.col("o.description").eqNullSafe(F.col("n.description")), "description changed"))
    text = F.concat_ws(" | ", *differs)
    what = status(text != "")
    details = (
        F.when(what == "added", F.concat(F.lit("Rule added: "), F.left("n.description", F.lit(120))))
        .when(what == "removed", F.concat(F.lit("Rule removed: "), F.left("o.description", F.lit(120)))).otherwise(text)
    )
    order = F.when(what == "added", 0).when(what == "removed", 1).otherwise(2)
    return pairs.where(what.isNotNull()).select(
        F.lit("rule").alias("kind"), order.alias("ord"), F.col("rule_id").alias("entity"), what.alias("change"), details.alias("details"), F.col("o.severity").alias("old_value"), F.col("n.severity").alias("new_value")
    )


def rename_values(pairs: DataFrame, key: str = "name") -> DataFrame:
    """Of ``removed`` and ``added`` value arrays, pairs that are the same when normalised, each used once."""
    gone = pairs.select(key, F.explode("removed").alias("old")).withColumn("k", names.normalise(F.col("old")))
    came = pairs.select(key, F.explode("added").alias("new")).withColumn("k", names.normalise(F.col("new"))).groupBy(key, "k").agg(F.max("new").alias("new"))
    return gone.join(came, [key, "k"]).groupBy(key, "new").agg(F.min("old").alias("old")).select(key, "old", "new")


def diff_enums(old: DataFrame, new: DataFrame) -> DataFrame:
    """Enumerations (``name, values``) by name; order and extensibility don't count."""
    pairs = outer(old, new, ["name"])
    empty = F.array().cast("array<string>")
    ov, nv = F.coalesce("o.values", empty), F.coalesce("n.values", empty)
    sets = pairs.withColumns({"added": F.sort_array(F.array_except(nv, ov)), "removed": F.sort_array(F.array_except(ov, nv))})
    what = status((F.size("added") > 0) | (F.size("removed") > 0))
    sets = sets.withColumn("what", what).where("what is not null")
    renamed = rename_values(sets.where("what = 'modified'")).groupBy("name").agg(F.sort_array(F.collect_list(F.struct("old", "new"))).alias("r"))
    full = sets.join(renamed, "name", "left")
    r = F.coalesce("r", F.array().cast("array<struct<old:string,new:string>>"))
    shown = [
        F.when(F.size(r) > 0, F.concat(F.lit("renamed values: "), F.array_join(F.transform(r, lambda x: F.concat(x["old"], F.lit(" -> "), x["new"])), ", "))),
        F.when(F.size(F.array_except("added", F.transform(r, lambda x: x["new"]))) > 0, F.concat(F.lit("added values: "), F.array_join(F.array_except("added", F.transform(r, lambda x: x["new"])), ", "))),
        F.when(F.size(F.array_except("removed", F.transform(r, lambda x: x["old"]))) > 0, F.concat(F.lit("removed values: "), F.array_join(F.array_except("removed", F.transform(r, lambda x: x["old"])), ", "))),
    ]
    details = (
        F.when(F.col("what") == "added", F.concat(F.format_string("Enum added with %d values: ", F.size(nv)), F.array_join(F.slice(nv, 1, 5), ", ")))
        .when(F.col("what") == "removed", "Enum type removed").otherwise(F.concat_ws(" | ", *shown))
    )
    order = F.when(F.col("what") == "added", 0).when(F.col("what") == "removed", 1).otherwise(2)
    modified = F.col("what") == "modified"
    return full.select(
        F.lit("enum").alias("kind"), order.alias("ord"), F.col("name").alias("entity"), F.col("what").alias("change"), details.alias("details"),
        F.when(modified, F.size(ov).cast("string")).alias("old_value"), F.when(modified, F.size(nv).cast("string")).alias("new_value"),
    )


def diff_shallow(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys that are added, removed, or whose rows differ anywhere."""
    pairs = outer(old, new, [key])
    return pairs.select(key, status(~F.col("o").eqNullSafe(F.col("n"))).alias("change")).where("change is not null")


def summary(changes: DataFrame, shown: int = 20) -> DataFrame:
    """Changes by kind and type: their number, and the first entities, ``shown`` of them.

    The first ones are cut off before the shuffle (a limit by group), so no row or task holds all entities of a type.
    """
    counts = changes.groupBy("kind", "change").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("kind", "change").orderBy("entity"))
    first = changes.select("kind", "change", "entity").withColumn("r", place).where(F.col("r") <= shown)
    listed = first.groupBy("kind", "change").agg(F.sort_array(F.collect_list("entity")).alias("entities"))
    return counts.join(listed, ["kind", "change"])
