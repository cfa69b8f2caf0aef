"""Operators on hand-made rows."""

import json
import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from specloom.functions import names
from specloom.operators import diff, predicates
from specloom.sources import registry

PROP = "entity string, name string, type string, required boolean, cardinality string, reference_target string, array_item_type string, deprecated boolean"
ENT = "name string, aliases array<string>, deprecated boolean"


def prop(entity, name, kind="string", required=False, card="1"):
    return (entity, name, kind, required, card, "", "", False)


def entities(spark, *rows):
    return spark.createDataFrame([(n, list(a), d) for n, a, d in rows], ENT)


def changes(spark, old, new, old_props, new_props):
    make = lambda p: spark.createDataFrame(p, PROP)
    return {(r.entity, r.change): r for r in diff.diff_entities(entities(spark, *old), entities(spark, *new), make(old_props), make(new_props)).collect()}


def test_entity_diff(spark):
    alike = [f"n{i}" for i in range(9)]
    old = {
        "OldHashedUri": [prop("OldHashedUri", n) for n in ("url", "hash", "alg")], "Params": [prop("Params", n) for n in ("a", "b", "zebra")], "ClaimMap": [prop("ClaimMap", n) for n in "pqr"],
        "OldName": [prop("OldName", n) for n in [*alike, "changed"]], "AlphaThing": [], "Bar": [], "Same": [], "Foo": [prop("Foo", "count", "string"), prop("Foo", "gone"), prop("Foo", "kept", "integer")],
    }
    new = {
        "NewHashedUri": [prop("NewHashedUri", n) for n in ("url", "hash", "alg")], "ParamsNew": [prop("ParamsNew", n) for n in ("a", "b", "yak")], "RegionMap": [prop("RegionMap", n) for n in "xyw"],
        "NewName": [prop("NewName", n) for n in [*alike, "changes"]], "AlphaThings": [], "Bar": [prop("Bar", "x")], "Same": [], "Foo": [prop("Foo", "counts", "integer"), prop("Foo", "kept", "string", True)],
    }
    aliases = {"OldHashedUri": ["hashed-uri-map"], "NewHashedUri": ["hashed_uri.map"]}
    deprecated = {("old", "Same"), ("new", "Bar")}
    rows = [[(n, aliases.get(n, []), (side, n) in deprecated) for n in names_] for side, names_ in (("old", old), ("new", new))]
    c = changes(spark, *rows, sum(old.values(), []), sum(new.values(), []))
    assert set(c) == {
        ("NewHashedUri", "renamed"), ("Params", "removed"), ("ParamsNew", "added"), ("ClaimMap", "removed"), ("RegionMap", "added"), ("NewName", "renamed"), ("AlphaThings", "renamed"), ("Foo", "modified"), ("Bar", "deprecated")}
    assert c["NewHashedUri", "renamed"].old_value == "OldHashedUri" and c["NewHashedUri", "renamed"].details == "OldHashedUri -> NewHashedUri"
    assert c["NewName", "renamed"].details == "OldName -> NewName | renamed properties: changed -> changes"
    assert c["Foo", "modified"].details == "added properties: counts | removed properties: count, gone | modified properties: kept: type: 'integer' -> 'string'; required: False -> True"
    assert c["RegionMap", "added"].details == "Added entity with 3 properties"


def test_greedy_takes_each_once(spark):
    c = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.9), ("b", "x", 0.95), ("b", "z", 0.8), ("c", "x", 1.0)], "old string, new string, score double")
    assert sorted((r.old, r.new) for r in diff.greedy(c, []).collect()) == [("a", "x"), ("b", "z")]


def test_enum_diff(spark):
    make = lambda *r: spark.createDataFrame(list(r), "name string, values array<string>")
    got = {r.entity: r for r in diff.diff_enums(make(("R", ["s.tradesecret.p", "old", "same"]), ("Gone", ["a"]), ("I", ["a", "b"])), make(("R", ["s.trade-secret.p", "new", "same"]), ("N", list("abcdefg")), ("I", ["b", "a"]))).collect()}
    assert set(got) == {"R", "Gone", "N"}
    assert got["R"].details == "renamed values: s.tradesecret.p -> s.trade-secret.p | added values: new | removed values: old" and got["R"].old_value == "3"
    assert got["N"].details == "Enum added with 7 values: a, b, c, d, e"


def test_similarity_is_the_matchers(spark):
    pairs = [("changed", "changes"), ("OldName", "NewName"), ("", ""), ("Über", "uber"), ("a" * 250, "ab" * 130)]
    got = spark.createDataFrame(pairs, "a string, b string").select(names.name_similarity(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r.r for r in got] == [SequenceMatcher(a=a.lower(), b=b.lower()).ratio() for a, b in pairs]


def test_jaccard(spark):
    df = spark.createDataFrame([([], []), ([], ["a"]), (["a", "b"], ["b", "c"])], "a array<string>, b array<string>")
    assert [r.j for r in df.select(names.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [1.0, 0.0, 1 / 3]


def test_camel_lowers_the_rest(spark):
    df = spark.createDataFrame([("COSE_Sign1",), ("hashed-uri-map",), ("a--b",)], "n string")
    assert [r.c for r in df.select(names.camel(F.col("n")).alias("c")).collect()] == ["CoseSign1", "HashedUriMap", "AB"]


def test_registry():
    assert len(registry.list_versions()) == 12 and registry.list_versions()[0].version == "2.4"
    for bad in ("", "9", "v2.4"):
        with pytest.raises(KeyError):
            registry.get_version(bad)
    with pytest.raises(ValueError):
        registry.checkout(".", "9")


def test_conditions(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "a", "y")], "id int, a string, b string")
    got = predicates.evaluate(df, {"P": {"op": "or", "conditions": [{"op": "exists", "field": "a"}, {"op": "equals", "field": "b", "value": "x"}]}, "Q": {"op": "delegate", "to_predicates": ["R"]}, "R": {"op": "and", "conditions": [{"op": "exists", "field": "a"}]}}, ["id"])
    assert sorted((r.id, r.predicate_id, r.ok) for r in got.collect()) == [(1, "P", True), (1, "Q", False), (1, "R", False), (2, "P", True), (2, "Q", True), (2, "R", True)]
    with pytest.raises(ValueError, match="unknown"):
        predicates.compile_condition({"op": "resembles"})
    with pytest.raises(ValueError, match="circle"):
        predicates.evaluate(df, {"A": {"op": "delegate", "to_predicates": ["A"]}}, ["id"])


def test_condition_operators(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 'abc', 5, array(1, 2), array(named_struct('k', 'x', 'n', 1))), (2, NULL, NULL, NULL, NULL), (3, 'b', 9, array(), array(named_struct('k', 'y', 'n', 7), named_struct('k', 'x', 'n', 8))) AS t(id, s, n, a, o)")
    leaf = lambda op, field, **x: {"op": op, "field": field} | x
    cases = {
        "ne": (leaf("not_equals", "s", value="b"), {1}), "in": (leaf("in", "n", values=[5, 6]), {1}), "not_in": (leaf("not_in", "n", values=[5]), {3}), "gt": (leaf("greater_than", "n", value=5), {3}), "ge": (leaf("at_least", "n", value=5), {1, 3}),
        "lt": (leaf("less_than", "n", value=9), {1}), "le": (leaf("at_most", "n", value=9), {1, 3}), "re": (leaf("matches", "s", pattern="^a.c$"), {1}), "has": (leaf("contains", "s", value="b"), {1, 3}), "holds": (leaf("contains", "a", value=2, of="array"), {1}),
        "starts": (leaf("starts_with", "s", value="a"), {1}), "ends": (leaf("ends_with", "s", value="b"), {3}), "count": (leaf("count", "a", value=0), {3}), "few": (leaf("count", "o", min=1, max=1), {1}),
        "all": (leaf("all", "o", condition=leaf("at_least", "n", value=2)), {3}), "any": (leaf("any", "o", condition=leaf("equals", "k", value="x")), {1, 3}), "each": (leaf("all", "a", condition={"op": "at_least", "value": 1}), {1, 3}),
        "implies": ({"op": "implies", "if": leaf("exists", "s"), "then": leaf("at_least", "n", value=6)}, {2, 3}), "not": ({"op": "not", "condition": leaf("greater_than", "n", value=5)}, {1, 2}),
    }
    got = predicates.evaluate(df, {k: c for k, (c, _) in cases.items()}, ["id"]).where("ok").groupBy("predicate_id").agg(F.collect_set("id").alias("ids")).collect()
    assert {r.predicate_id: set(r.ids) for r in got} == {k: w for k, (_, w) in cases.items()}


def test_contract_of_vectors_delegations_and_codes(spark):
    pred = lambda i, **x: {"predicate_id": f"PRED-A-{i:03}", "source_rules": ["VAL-X-0001"], "severity": "must", "title": "t", "description": "d", "condition": {"op": "exists"}} | x
    preds = [
        pred(1, test_vectors={"invalid_a": {}, "fail_b": {}}), pred(2, test_vectors={"a": {"expected_result": True}, "b": {"expected_status": "x.known"}}), pred(3, test_vectors={}), pred(4, test_vectors={"passing": 1, "non_conforming": 2}),
        pred(5, condition={"op": "delegate", "to_predicates": ["PRED-A-001", "PRED-A-999"]}), pred(6, condition={"op": "exists", "target": "PRED-A-998", "note": "delegate"}), pred(7, condition={"op": "and", "conditions": [{"op": "emit", "status": "x.gone"}, {"status": "label.y"}, {"status": "plain"}]}),
    ]
    doc = {"spec_version": "1", "predicate_schema_version": "1", "format_families": {"f": {"description": "d", "mime_types": ["m"], "binding_mechanism": "b", "predicates": preds}}, "cross_cutting": {"description": "d", "predicates": []}, "coverage_summary": {}}
    d = predicates.read(spark, json.dumps(doc))
    assert {(r.subject, r.violation) for r in predicates.violations(d).collect()} == {("PRED-A-001", "no passing vector"), ("PRED-A-003", "no passing vector"), ("PRED-A-003", "no failing vector"), ("PRED-A-004", "no failing vector")}
    assert [tuple(r) for r in predicates.dangling_delegations(d).collect()] == [(0, "PRED-A-005", "PRED-A-999")]
    codes = spark.createDataFrame([("x.known",)], "code string")
    assert [tuple(r) for r in predicates.dangling_codes(d, codes, "label.").collect()] == [(0, "x.gone")]
    assert predicates.dangling_codes(d, codes.where("false")).count() == 0


def test_offers_are_the_greedy_matching(spark):
    r = random.Random(4)
    for n in (1, 6, 25):
        cand = [(f"o{i:02}", f"n{j:02}", r.randint(1, 4) / 4) for i in range(n) for j in range(n) if r.random() < 0.4]
        df = spark.createDataFrame(cand, "old string, new string, score double")
        used, want = set(), {}
        for o in sorted({c[0] for c in cand}):
            free = sorted((-s, b) for a, b, s in cand if a == o and b not in used)
            if free:
                want[o] = free[0][1]
                used.add(free[0][1])
        assert {x.old: x.new for x in diff.greedy(df, []).collect()} == want
        assert {x.old: x.new for x in diff.greedy(df.withColumn("k", F.lit(1)), ["k"]).collect()} == want


def ratcliff(a, b):
    """Characters in matching blocks, found by the longest common run and what is left and right of it."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            best = max(best, (k, -i, -j))
    k, i, j = best[0], -best[1], -best[2]
    return k + ratcliff(a[:i], b[:j]) + ratcliff(a[i + k :], b[j + k :]) if k else 0


def test_name_similarity_against_plain_blocks(spark):
    r = random.Random(9)
    pairs = [("".join(r.choice("abC1") for _ in range(r.randint(0, 9))), "".join(r.choice("abC1") for _ in range(r.randint(0, 9)))) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", names.name_similarity(F.col("a"), F.col("b")).alias("s"), names.name_similarity(F.col("a"), F.col("b"), 0.6).alias("t")).collect():
        n = len(x.a) + len(x.b)
        want = 2 * ratcliff(x.a.lower(), x.b.lower()) / n if n else 1.0
        assert abs(x.s - want) < 1e-9 and (abs(x.t - want) < 1e-9 if want >= 0.6 else x.t < 0.6)
