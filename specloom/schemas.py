"""Value domains and table schemas of the specification graph."""

from __future__ import annotations

PROPERTY_TYPES = ("string", "integer", "float", "boolean", "bytes", "uri", "datetime", "enum", "array", "map", "reference", "union", "any")
CARDINALITIES = ("1", "0..1", "0..*", "1..*")
RELATIONSHIP_TYPES = ("has_one", "has_many", "belongs_to", "references", "extends")
SEVERITIES = ("must", "shall", "must_not", "shall_not", "should", "should_not", "may")  # in display order
PHASES = ("structural", "cryptographic", "trust", "semantic", "assertion", "ingredient", "timestamp", "signature", "content")
CHANGES = ("added", "removed", "modified", "deprecated", "renamed")
CATEGORIES = tuple("success failure informational unknown".split())

#: Rows carry ``version`` and an explicit ``ord``; nothing relies on the order of a DataFrame.
TABLES = {
    "spec_version": "version string, date string, commit_hash string, tag string, ord int",
    "entity": "version string, ord bigint, name string, description string, parent string, source string, spec_section string, aliases array<string>, deprecated boolean",
    "property": "version string, entity string, ord bigint, name string, type string, description string, required boolean, cardinality string, enum_values array<string>, reference_target string, array_item_type string, pattern string, min_length int, max_length int, deprecated boolean, source string",
    "relationship": "version string, scope string, ord bigint, name string, source string, target string, type string, description string, cardinality string",
    "rule": "version string, ord bigint, rule_id string, description string, severity string, phase string, condition string, action string, referenced_entities array<string>, spec_section string, source_text string",
    "enum_type": "version string, ord bigint, name string, values array<string>, extensible boolean, description string, source string",
    "type_alias": "version string, ord bigint, name string, cddl_name string, base_type string, description string, external boolean",
    "status_code": "version string, ord bigint, code string, meaning string, url_usage string, category string",
    "convention": "version string, document string",
}
