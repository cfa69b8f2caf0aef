import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [p for p in [str(ROOT)] if p not in sys.path]
os.environ.setdefault("PYARROW_IGNORE_TIMEZONE", "1")


@pytest.fixture(scope="session")
def spark():
    from specloom.session import local_session

    return local_session("8", "tests")


TREE = {
    "docs/modules/specs/partials/schemas/cddl/a.cddl": """; The claim of a maker.
claim-map = {
  "name": tstr .size (1..max-len), ; display name
  ? "uris": [1* $hashed-uri-map], ; parts of it
  "old": bool, ; (DEPRECATED) not used
  "region": regionmap,
  ? "extra": int / thing-range,
  "parentOf": hashed-uri-map,
  common-map,
  * tstr => any
}
$action-choice /= "spec.created"
$action-choice /= "spec.edited" ; by hand
$action-choice /= tstr .regexp "x+"
max-len = 100
""",
    "docs/modules/specs/partials/schemas/cddl/b.cddl": """claim-map = { "name": bstr, "later": [* tstr] }
hashed-uri-map = { "url": uri, ? "alg": tstr, }
RegionMap = { "shape": COSE_Sign1 }
$action-choice /= "spec.edited"
$action-choice /= "spec.opened"
$mode /= "a"
""",
    "docs/modules/specs/partials/schemas/cddl/c.cddl": "broken-map = { \"a\" : \n$late /= \"z\"\n",
    "docs/modules/crJSON/partials/crJSON.schema.json": """{"type": "object", "title": "The Doc!", "description": "root", "required": ["items"],
 "properties": {"items": {"items": {"$ref": "#/definitions/Locator"}, "description": "all", "type": "array"}, "when": {"type": "string", "format": "date-time"}},
 "definitions": {"hasheduriMap": {"description": "A hashed link", "type": "object", "properties": {"url": {"description": "where", "type": "string"}}},
  "Locator": {"oneOf": [{"$ref": "#/definitions/hasheduriMap"}, {"$ref": "#/definitions/Plain"}]}, "Plain": {"type": "string"},
  "Kinds": {"type": "object", "required": ["e"], "properties": {"e": {"enum": ["x", 1]}, "u": {"anyOf": [{"type": "string"}]}, "n": {"type": "number", "pattern": "^1$"}, "l": {"type": ["a", "b"]}}}}}""",
    "docs/modules/specs/partials/Validation/Validation.adoc": """== Title

## Trust list

A validator must not accept `claim.invalid` of an xref:x[unknown signer]. It should check the ClaimMap and HashedUriMap. Must it?

NOTE: it may be skipped entirely here.

### Hash binding

The hash may be omitted from the record of content.

Success codes.

|===
|Value | Meaning | Usage
|`ok.one` | All xref:y[well] | url
|===

These are failure codes.

|===
|`bad.two` | Wrong | (multiple)
|===

|===
""",
    "docs/modules/specs/partials/Standard_Assertions/Region.adoc": "= Region\n\n== Description\n\nA `part` of\na picture.\n\nMore",
    "docs/modules/specs/partials/Standard_Assertions/Unknown.adoc": "= Unknown\n\nThis describes a thing that nothing defines.",
}


@pytest.fixture(scope="session")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf-8")
    return root


@pytest.fixture(scope="session")
def graph(spark, tree):
    from specloom.graph import build_trees

    return build_trees(spark, {"2.4": tree}).cut()
