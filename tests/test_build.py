"""The whole build over a small source tree."""

import json

import pytest
from pyspark.sql import functions as F

from specloom import api
from specloom.graph import Graph, build_trees
from specloom.sinks import documents
from specloom.sources import cddl, metadata


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_entities_are_merged_in_order(graph):
    found = {r.name: r for r in graph.entity.collect()}
    assert [r.name for r in graph.entity.orderBy("ord").collect()] == ["ClaimMap", "HashedUriMap", "Regionmap", "TheDoc", "hasheduriMap", "Locator", "Kinds"]
    assert found["ClaimMap"].description == "The claim of a maker." and found["ClaimMap"].aliases == ["claim-map"]
    assert found["HashedUriMap"].description == "A hashed link"  # in any case
    assert found["Regionmap"].description == ""  # Region + Map is spelt otherwise


def test_properties(graph):
    p = {(r.entity, r.name): r for r in graph.property.collect()}
    name = p["ClaimMap", "name"]
    assert (name.type, name.required, name.cardinality, name.min_length, name.description) == ("string", True, "1", 1, "display name")
    uris = p["ClaimMap", "uris"]
    assert (uris.type, uris.cardinality, uris.array_item_type, uris.required) == ("array", "0..*", "HashedUriMap", False)
    assert p["ClaimMap", "later"].type == "array" and p["ClaimMap", "later"].cardinality == "0..*"  # from the second file
    assert p["ClaimMap", "region"].reference_target == "Regionmap"
    assert p["ClaimMap", "old"].deprecated and p["ClaimMap", "old"].description == "not used"
    assert p["HashedUriMap", "url"].description == "where"
    assert (p["Locator", "_union"].type, p["Locator", "_union"].reference_target) == ("union", "HashedUriMap") or p["Locator", "_union"].reference_target == "hasheduriMap"
    assert p["Kinds", "e"].enum_values == ["x", "1"] and p["Kinds", "n"].pattern == "^1$" and p["Kinds", "l"].type == "any"
    assert p["TheDoc", "items"].cardinality == "1..*" and p["TheDoc", "when"].type == "datetime"
    assert ("ClaimMap", "tstr") not in p


def test_enums(graph):
    e = {r.name: r for r in graph.enum_type.collect()}
    assert e["ActionChoice"]["values"] == ["spec.created", "spec.edited", "spec.opened"] and e["ActionChoice"].extensible
    assert e["Mode"]["values"] == ["a"] and not e["Mode"].extensible
    assert e["Late"]["values"] == ["z"]  # even of a file that doesn't parse


def test_edges(graph):
    inferred = rows(graph.relationship.where("scope = 'inferred'"), "source", "name", "target", "type")
    assert ("ClaimMap", "uris", "HashedUriMap", "has_many") in inferred
    assert ("ClaimMap", "parentOf", "HashedUriMap", "belongs_to") in inferred
    assert ("ClaimMap", "region", "Regionmap", "has_one") in inferred
    parser = rows(graph.relationship.where("scope = 'parser'"), "source", "name", "target", "type")
    assert ("ClaimMap", "includes", "CommonMap", "extends") in parser


def test_aliases(graph):
    a = {r.name: r for r in graph.type_alias.collect()}
    assert a["CoseSign1"].external and a["CoseSign1"].base_type == "external"
    assert a["ThingRange"].base_type == "integer" and "Plain" not in a and "string" not in a


def test_rules(graph):
    r = [x.asDict() for x in graph.rule.orderBy("ord").collect()]
    assert [(x["rule_id"], x["severity"], x["phase"], x["spec_section"]) for x in r] == [
        ("VAL-TRUS-0001", "must_not", "trust", "Trust list"), ("VAL-TRUS-0002", "should", "trust", "Trust list"), ("VAL-CONT-0001", "may", "content", "Hash binding")]
    assert r[0]["description"] == "A validator must not accept claim.invalid of an unknown signer."
    assert r[0]["referenced_entities"] == ["claim.invalid"] and r[1]["referenced_entities"] == ["ClaimMap", "HashedUriMap"]


def test_status_codes(graph):
    assert rows(graph.status_code, "code", "meaning", "url_usage", "category") == [("bad.two", "Wrong", "(multiple)", "failure"), ("ok.one", "All well", "url", "success")]


def test_lookups(graph):
    assert api.rules_for(graph, "ClaimMap").count() == 1
    assert api.rules_by_phase(graph, "trust").count() == 2 and api.rules_by_phase(graph, "none").count() == 0 and api.rules_by_phase(graph).count() == 3
    assert {r.source for r in api.relationships_for(graph, "HashedUriMap").collect()} >= {"ClaimMap"}
    assert [r.name for r in api.search(graph.entity, "A MAKER").collect()] == ["ClaimMap"]
    assert api.entity(graph, "Nope").count() == 0


def test_parquet_round_trip(spark, graph, tmp_path):
    graph.save(tmp_path)
    again = Graph.read(spark, tmp_path)
    for name, t in graph.tables().items():
        assert sorted(map(str, again.tables()[name].collect())) == sorted(map(str, t.collect())), name


@pytest.fixture(scope="module")
def stored(graph, tmp_path_factory):
    folder = tmp_path_factory.mktemp("out")
    documents.write_all(graph, "2.4", folder)
    changed = json.loads((folder / "2.4/metadata.json").read_text())
    changed["version"]["version"] = "2.3"
    changed["entities"]["ClaimMapOld"] = changed["entities"].pop("ClaimMap") | {"name": "ClaimMapOld"}
    del changed["entities"]["Kinds"]
    changed["validation_rules"] = changed["validation_rules"][:2]
    changed["validation_rules"][0]["severity"] = "may"
    changed["enum_types"]["Mode"]["values"] = ["A-", "b"]
    documents.write_json(changed, folder / "2.3/metadata.json")
    return folder


def test_documents(stored, graph):
    doc = json.loads((stored / "2.4/metadata.json").read_text())
    assert doc["stats"] == {"entity_count": 7, "relationship_count": len(doc["relationships"]), "rule_count": 3, "enum_count": 3, "type_alias_count": len(doc["type_aliases"]), "status_code_count": 2}
    assert "description" not in doc["entities"]["Regionmap"] and [p["name"] for p in doc["entities"]["ClaimMap"]["properties"]][0] == "name"
    rules = json.loads((stored / "2.4/validation-rules.json").read_text())
    assert list(rules["phases"]) == ["trust", "content"] and rules["summary"]["by_severity"]["may"] == 1
    assert "url_usage" not in rules["status_codes"]["failure"][0] and "source_text" not in rules["phases"]["trust"][0]
    terms = json.loads((stored / "2.4/context.jsonld").read_text())["@context"]
    assert list(terms)[:9][-1] == "@vocab" and terms["ClaimMap"]["@type"] == "@id" and terms["ClaimMap.uris"]["@container"] == "@list" and "@type" not in terms["uris"]
    ttl = (stored / "2.4/ontology.ttl").read_text()
    assert ttl.count("a owl:Class") == 7 + 3 and "spec:ClaimMap a owl:Class" in ttl and "owl:oneOf" in ttl
    assert graph.counts().where("table = 'rule'").collect()[0].n == 3


def test_metadata_round_trip(spark, stored, graph):
    again = metadata.load(spark, stored, "2.4")
    first, second = (documents.metadata(g) for g in (graph, again))
    assert first == second
    with pytest.raises(FileNotFoundError):
        metadata.load(spark, stored, "1.0")


def test_catalog(spark, stored):
    c = api.Catalog(spark, stored)
    d = c.diff("2.3", "2.4", full=True)
    by = {(x["entity"], x["change"]) for x in d["entity_changes"]}
    assert ("ClaimMap", "renamed") in by and ("Kinds", "added") in by and len(by) == 2
    assert {(x["entity"], x["change"], x["details"]) for x in d["rule_changes"]} >= {("VAL-TRUS-0001", "modified", "severity: may -> must_not")}
    assert d["enum_changes"][0]["details"] == "renamed values: A- -> a | removed values: b"
    assert d["summary"]["total_changes"] == len(d["entity_changes"]) + len(d["rule_changes"]) + len(d["enum_changes"])
    same = c.diff("2.4", "2.4")
    assert same["summary"] == {"entity_changes": 0, "rule_changes": 0, "enum_changes": 0}
    shallow = c.diff_versions("2.3", "2.4")
    assert shallow["entities"]["added"] == ["ClaimMap", "Kinds"] and shallow["entities"]["removed"] == ["ClaimMapOld"] and shallow["entities"]["modified"] == []
    assert shallow["rules"]["added"] == ["VAL-CONT-0001"]
    assert c.query_entity("2.4", "Nope")["available_entities"][0] == "ClaimMap" and c.search("2.4", "hashed")["count"] == 2
    assert len(c.query_rules("2.4", "trust")["rules"]) == 2
    with pytest.raises(KeyError):
        c.entity("2.4", "Nope")


def test_missing_sources_give_an_empty_graph(spark, tmp_path):
    g = build_trees(spark, {"0.8": tmp_path})
    assert g.entity.count() == 0 and g.rule.count() == 0 and g.spec_version.count() == 1


def test_keyed_insert(spark, graph):
    row = graph.entity.where("name = 'ClaimMap'").replace("The claim of a maker.", "new").withColumn("ord", F.col("ord") + 999)
    g = graph.add("entity", row)
    found = g.entity.where("name = 'ClaimMap'").collect()
    assert len(found) == 1 and found[0].description == "new" and found[0].ord == graph.entity.where("name = 'ClaimMap'").collect()[0].ord


@pytest.mark.parametrize(("text", "kind", "ref", "item"), [
    ("tstr", "string", "", ""), ("1..10", "integer", "", ""), ("#6.37(bstr)", "bytes", "", ""), ("&( a: 1 )", "enum", "", ""), ("{ a: int }", "map", "", ""), ("[+ foo-map]", "array", "", "FooMap"),
    ("[* tstr]", "array", "", "string"), ("tstr / foo-map", "union", "FooMap", ""), ("~foo_map", "reference", "FooMap", ""), ('"a"', "string", "", ""), ("5", "integer", "", ""), ("float16-32", "float", "", ""),
    ("tstr .regexp \"a\"", "string", "", ""), ("(tstr)", "string", "", ""), ("nil", "any", "", ""), ("h'00'", "bytes", "", ""),
])
def test_cddl_types(text, kind, ref, item):
    ((_, node),) = cddl.Parser(f"x = {{ \"k\": {text} }}").rules()
    assert cddl.infer(node.parts[0][0].type) == (kind, ref, item)


def test_comments_of_other_lines():
    text = '"a": tstr,\n"b": int, ; about b\n"c": int ; about c\n'
    assert cddl.comments(text) == {"a": "about b", "c": "about c"}
    assert cddl.comments(text, compat=False) == {"b": "about b", "c": "about c"}
