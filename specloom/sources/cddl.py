"""CDDL files as entity, property, edge and enumeration rows.

The grammar needs a real parser, so each file's text goes through a recursive descent in Python, many files in
parallel; everything after (merging, references, edges) is DataFrame work.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specloom.operators import integrate

PRELUDE = {
    **dict.fromkeys(("tstr", "text", "format-string", "jumbf-uri-type", "semver-string"), "string"), **dict.fromkeys(("bstr", "bytes"), "bytes"),
    **dict.fromkeys(("uint", "nint", "int", "integer", "unsigned"), "integer"), **dict.fromkeys(("float", "float16", "float32", "float64", "float16-32", "float32-64"), "float"),
    **dict.fromkeys(("bool", "true", "false"), "boolean"), **dict.fromkeys(("tdate", "time"), "datetime"), "uri": "uri", **dict.fromkeys(("any", "nil", "null", "undefined"), "any"),
}
ROW = (
    "version string, kind string, part bigint, ord bigint, entity string, pos int, name string, type string, description string, required boolean, cardinality string, "
    "reference_target string, array_item_type string, pattern string, min_length int, deprecated boolean, target string, values array<string>, extensible boolean, source string, alias string"
)

_TOKEN = re.compile(
    r"""(?P<space>\s+|;[^\n]*)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<bytes>(?:h|b64)?'(?:[^'\\]|\\.)*')|(?P<number>-?(?:0x[0-9A-Fa-f]+|0b[01]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?))"""
    r"""|(?P<name>[A-Za-z@_$](?:[A-Za-z0-9@_$]|[-.]+(?=[A-Za-z0-9@_$]))*)|(?P<range>\.\.\.?)|(?P<control>\.[A-Za-z][A-Za-z0-9-]*)|(?P<mark>//=|/=|=>|//|[=/{}\[\]()<>,:?*+~&#^])""",
)


class Node(NamedTuple):
    """A type: ``any`` of several, ``value``, ``name``, ``map``, ``array``, ``group``, ``tag``, ``choice``, ``range`` or ``control``."""

    kind: str
    value: Any = None
    parts: tuple = ()


class Entry(NamedTuple):
    occurrence: str
    key: Node | None
    type: Node


class Parser:
    """Rules of a CDDL text; raises ValueError where it isn't CDDL."""

    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str, int]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at]!r} at {at}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "", m[0], at))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead][:2] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, mark: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or (mark is not None and token[1] != mark):
            raise ValueError(f"expected {mark or 'more'}, found {token[1] or 'the end'}")
        self.at += 1
        return token

    def skip(self, mark: str) -> bool:
        if self.peek() == ("mark", mark):
            self.at += 1
            return True
        return False

    def rules(self) -> Iterator[tuple[str, Node]]:
        while self.peek()[0] != "end":
            kind, name = self.take()
            if kind != "name":
                raise ValueError(f"expected a rule, found {name}")
            self.generic()
            _, sign = self.take()
            if sign not in ("=", "/=", "//="):
                raise ValueError(f"expected an assignment, found {sign}")
            # what follows is a type, or else a group entry
            start = self.at
            try:
                node = self.type()
                if self.peek()[0] != "end" and not self.starts_rule():
                    raise ValueError("not a type")
            except ValueError:
                self.at = start
                node = Node("group", parts=((self.entry(),),))
            yield name, node

    def starts_rule(self) -> bool:
        if self.peek()[0] != "name":
            return False
        ahead = 1
        if self.peek(1) == ("mark", "<"):
            while self.peek(ahead)[1] not in (">", ""):
                ahead += 1
            ahead += 1
        return self.peek(ahead)[1] in ("=", "/=", "//=")

    def generic(self) -> None:
        if self.skip("<"):
            while not self.skip(">"):
                self.take()

    def type(self) -> Node:
        parts = [self.type1()]
        while self.skip("/"):
            parts.append(self.type1())
        return parts[0] if len(parts) == 1 else Node("any", parts=tuple(parts))

    def type1(self) -> Node:
        left = self.type2()
        kind, sign = self.peek()
        if kind == "range":
            self.at += 1
            return Node("range", parts=(left, self.type2()))
        if kind == "control":
            self.at += 1
            return Node("control", sign, (left, self.type2()))
        return left

    def type2(self) -> Node:
        kind, token = self.take()
        if kind == "text":
            return Node("value", ("text", token[1:-1]))
        if kind == "bytes":
            return Node("value", ("bytes", token))
        if kind == "number":
            return Node("value", ("number", token))
        if kind == "name":
            self.generic()
            return Node("name", token)
        if token == "~":
            return Node("name", "~" + self.take()[1])
        if token == "&":
            if self.skip("("):
                self.group(")")
            else:
                self.take()
            return Node("choice")
        if token == "#":
            if self.peek()[0] == "number":
                self.take()
                if self.skip("("):
                    self.type()
                    self.take(")")
                return Node("tag")
            return Node("unknown")
        if token == "(":
            start = self.at
            try:
                node = self.type()
                self.take(")")
                return node
            except ValueError:
                self.at = start
                return Node("group", parts=self.group(")"))
        if token == "{":
            return Node("map", parts=self.group("}"))
        if token == "[":
            return Node("array", parts=self.group("]"))
        raise ValueError(f"unexpected {token}")

    def group(self, end: str) -> tuple[tuple[Entry, ...], ...]:
        choices: list[list[Entry]] = [[]]
        while not self.skip(end):
            if self.skip("//"):
                choices.append([])
                continue
            choices[-1].append(self.entry())
            self.skip(",")
        return tuple(map(tuple, choices))

    def entry(self) -> Entry:
        occurrence = ""
        if self.peek()[1] in ("?", "+") and self.peek()[0] == "mark":
            occurrence = self.take()[1]
        elif self.peek() == ("mark", "*") or (self.peek()[0] == "number" and self.peek(1) == ("mark", "*")):
            occurrence = self.take()[1]
            if occurrence != "*":
                occurrence += self.take()[1]
            if self.peek()[0] == "number" and self.peek(1)[1] not in (":", "=>"):
                occurrence += self.take()[1]
        if self.peek(1) == ("mark", ":") and self.peek()[0] in ("name", "text", "number"):
            kind, token = self.take()
            self.take(":")
            key = Node("name", token) if kind == "name" else Node("value", (kind, token.strip('"') if kind == "text" else token))
            return Entry(occurrence, key, self.type())
        node = self.type()
        if self.peek()[1] in ("=>", "^"):
            self.skip("^")
            self.take("=>")
            return Entry(occurrence, node, self.type())
        return Entry(occurrence, None, node)


def camel(name: str) -> str:
    return "".join(p[:1].upper() + p[1:].lower() for p in re.split("[-_]", name) if p)


def first_entry(node: Node) -> Entry | None:
    return next((e for choice in node.parts for e in choice), None)


def infer(node: Node) -> tuple[str, str, str]:
    """Type, reference and array item of a type."""
    if node.kind == "any":
        refs = [r for _, r, _ in map(infer, node.parts) if r]
        return "union", refs[0] if refs else "", ""
    if node.kind == "control":
        return infer(node.parts[0])
    if node.kind == "value":
        return {"text": "string", "bytes": "bytes", "number": "integer"}[node.value[0]], "", ""
    if node.kind == "name":
        bare = node.value.lstrip("$~")
        return (PRELUDE[bare], "", "") if bare in PRELUDE else ("reference", camel(bare), "")
    if node.kind == "array":
        e = first_entry(node)
        kind, ref, _ = infer(e.type) if e else ("", "", "")
        return "array", "", ref if kind == "reference" else kind
    return {"range": "integer", "map": "map", "group": "map", "tag": "bytes", "choice": "enum"}.get(node.kind, "any"), "", ""


def cardinality(entry: Entry) -> tuple[bool, str]:
    """Whether an entry must be there, and how often."""
    required = entry.occurrence != "?"
    e = first_entry(entry.type) if entry.type.kind == "array" else None
    inner = e.occurrence if e else ""
    if re.fullmatch(r"[1-9]\d*\*", inner):
        return required, "1..*" if required else "0..*"
    if inner == "*":
        return required, "0..*"
    return required, "1" if required else "0..1"


def constraints(node: Node) -> tuple[str, int | None]:
    """Pattern and least length of ``.regexp`` and ``.size``."""
    pattern, least = "", None
    if node.kind == "any":
        for p in node.parts:
            a, b = constraints(p)
            pattern, least = a or pattern, b if b is not None else least
    elif node.kind == "control":
        op, (left, right) = node.value.lower(), node.parts
        if "size" in op:
            if right.kind == "range" and right.parts[0].kind == "value" and str(right.parts[0].value[1]).isdigit():
                least = int(right.parts[0].value[1])
        elif ("regexp" in op or "pcre" in op) and right.kind == "value":
            pattern = right.value[1]
        a, b = constraints(left)
        pattern, least = a or pattern, b if b is not None else least
    return pattern, least


def comments(text: str, compat: bool = True) -> dict[str, str]:
    """Comment of every field. With ``compat`` a field without one takes the next comment of the file; else only its own line's."""
    said_of: dict[str, str] = {}
    for m in re.finditer(r'"([^"]+)"[^;]*;\s*(.+)' if compat else r'"([^"\n]+)"[^;\n]*;[ \t]*([^\n]+)', text):
        key, said = m[1], m[2].strip()
        if key[0] not in "^\\" and said:
            said_of.setdefault(key, said)
    return said_of


def leading_comment(text: str, name: str) -> str:
    """Comment lines right before a rule."""
    m = re.search(rf"((?:^[^\S\n]*;.*\n)+)\s*{re.escape(name)}\s*=", text, re.M)
    lines = (line.strip().lstrip(";").strip() for line in m[1].splitlines()) if m else ()
    return " ".join(line for line in lines if line)


def enums(text: str) -> list[tuple[str, list[str], bool]]:
    """A4: enumerations of the ``$name /= value`` lines, extensible if a value isn't a literal."""
    found: dict[str, tuple[list[str], list[bool]]] = {}
    for m in re.finditer(r"^\$([\w-]+)\s*/=\s*([^\n]+?)(?:\s*;.*|)$", text, re.M | re.A):
        values, loose = found.setdefault(camel(m[1]), ([], []))
        literal = re.fullmatch(r'"([^"]+)"', m[2].strip().rstrip(","))
        values.append(literal[1]) if literal else loose.append(True)
    return [(n, v, bool(x)) for n, (v, x) in found.items()]


def parse(text: str, source: str, compat: bool = True) -> Iterator[dict]:
    """Rows of a file: enumerations always, the rest only if all of it parses."""
    for i, (name, values, extensible) in enumerate(enums(text)):
        yield {"kind": "enum", "ord": i, "name": name, "values": values, "extensible": extensible, "description": "", "source": source}
    try:
        rules = list(Parser(text).rules())
    except ValueError:
        return
    index = comments(text, compat)
    for i, (rule, node) in enumerate(rules):
        if node.kind != "map":
            continue
        entity, about = camel(rule.lstrip("$~")), leading_comment(text, rule)
        yield {"kind": "entity", "ord": i, "name": entity, "alias": rule, "description": "".join(about.split("(DEPRECATED)")).strip(), "deprecated": "DEPRECATED" in about, "source": source}
        for pos, e in enumerate(e for choice in node.parts for e in choice):
            row = {"ord": i, "pos": pos, "entity": entity, "source": source}
            if e.key is None:
                if e.type.kind == "name" and e.type.value[0] != "$" and re.search("[-_]map", e.type.value):
                    yield {**row, "kind": "edge", "name": "includes", "target": camel(e.type.value), "type": "extends", "description": f"Inherits fields from {e.type.value}", "cardinality": "1"}
                continue
            if e.key.kind == "name":
                key = e.key.value
                if key in {"any", "tstr", "text"}:  # catches all other keys
                    continue
            elif e.key.kind == "value" and e.key.value[0] == "text":
                key = e.key.value[1]
            else:
                continue
            kind, ref, item = infer(e.type)
            required, many = cardinality(e)
            pattern, least = constraints(e.type)
            said = index.get(key, "")
            clean = re.sub(r"(?i)[(]deprecated[)]", "", said).strip()
            yield {
                **row, "kind": "property", "name": key, "type": kind, "description": clean, "required": required, "cardinality": many, "reference_target": ref, "array_item_type": item,
                "pattern": pattern, "min_length": least, "deprecated": "(deprecated)" in said.lower(),
            }
            if kind in ("reference", "union") and ref:
                yield {**row, "kind": "edge", "name": key, "target": ref, "type": "has_many" if many in ("1..*", "0..*") else "references", "description": clean, "cardinality": many}


#: Rows that a worker hands over at once.
AT_ONCE = 4096
_COLUMNS = [c.split()[0] for c in ROW.split(", ")]


def rows(files: DataFrame, compat: bool = True) -> DataFrame:
    """Rows of ``version, part, file, text``; ``part`` is the file's place among its version's."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a batch of small files has many rows, which take far more memory than their text
        made = ({"version": f.version, "part": f.part, **r} for batch in batches for f in batch.itertuples() for r in parse(f.text, f.file, compat))
        while out := list(islice(made, AT_ONCE)):
            some = pd.DataFrame(out, columns=_COLUMNS)
            yield some.astype(object).where(some.notna(), None)

    return files.select("version", "part", "file", "text").mapInPandas(read, ROW)


def tables(files: DataFrame, compat: bool = True) -> dict[str, DataFrame]:
    """Entity, property, relationship and enumeration tables of all files, merged by A2 and A3."""
    r = rows(files, compat)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    place = (F.col("part") * 1_000_000 + F.col("ord")).alias("ord")
    entity = r.where("kind = 'entity'").select(
        "version", place, "name", text("description"), F.lit("").alias("parent"), "source", F.lit("").alias("spec_section"), F.array("alias").alias("aliases"), "deprecated")
    inner = (F.col("part") * 1_000_000_000_000 + F.col("ord") * 1_000_000 + F.col("pos")).alias("ord")
    # an entity that one file defines twice merges like one of two files
    rule = (F.col("part") * 1_000_000 + F.col("ord")).alias("part")
    prop = r.where("kind = 'property'").select(
        "version", "entity", inner, "name", "type", text("description"), "required", "cardinality", F.array().cast("array<string>").alias("enum_values"), text("reference_target"), text("array_item_type"),
        text("pattern"), "min_length", F.lit(None).cast("int").alias("max_length"), "deprecated", "source", rule)
    edge = r.where("kind = 'edge'").select("version", F.lit("parser").alias("scope"), inner, "name", F.col("entity").alias("source"), "target", "type", text("description"), "cardinality", rule)
    merged_edges = integrate.merge_properties(edge.withColumns({"entity": F.col("source"), "__n": F.col("name"), "name": F.concat_ws("\n", "name", "target")})).withColumn("name", F.col("__n")).drop("entity", "__n", "part")
    # one file's plug lines of a name are one enumeration already
    enum = r.where("kind = 'enum'").select("version", place, "name", "values", "extensible", text("description"), "source")
    return {"entity": integrate.merge_entities(entity), "property": integrate.merge_properties(prop).drop("part"), "relationship": merged_edges, "enum_type": integrate.merge_enums(enum)}
