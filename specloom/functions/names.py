"""Scalar name functions."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

XSD = {
    "string": "string", "integer": "integer", "float": "decimal", "boolean": "boolean", "bytes": "base64Binary", "uri": "anyURI",
    "datetime": "dateTime", "enum": "string",
}
LD_TYPE = {
    "string": "xsd:string", "integer": "xsd:integer", "float": "xsd:decimal", "boolean": "xsd:boolean", "bytes": "xsd:base64Binary",
    "uri": "@id", "datetime": "xsd:dateTime", "reference": "@id", "map": "@id",
}


def literal_map(values: dict[str, str], key: Column) -> Column:
    """Value of a key in a small constant mapping; NULL for others."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key) if values else F.lit(None)


def camel(name: Column) -> Column:
    """``kebab-case`` and ``snake_case`` as ``CamelCase``; the rest of each part is lowered."""
    return F.array_join(F.transform(F.split(name, "[-_]"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 20)))), "")


def without_socket(name: Column) -> Column:
    """Without leading ``$`` and ``~``."""
    return F.regexp_replace(name, r"^[$~]+", "")


def last_segment(ref: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(ref, "/"), -1)


def alias_base(name: Column) -> Column:
    """Base type of a dangling name by what it contains."""
    n = F.lower(name)
    return (
        F.when(n.rlike("string|url|uri|mime|format"), "string").when(n.rlike("range|int|size"), "integer")
        .when(n.rlike("flag|uuid"), "bytes").when(n.rlike("map|group|entry"), "map").otherwise("string")
    )


def normalise(name: Column) -> Column:
    """For loose matching."""
    return F.translate(F.lower(name), "-_.", "")


def _ratios(a: pd.Series, b: pd.Series, least: float) -> pd.Series:
    # the matcher indexes its second sequence, so pairs are taken in the order of that one
    out, matcher = np.full(len(a), np.nan), SequenceMatcher(None)
    last, first, second = None, a.tolist(), b.tolist()
    for i in sorted((i for i in range(len(a)) if first[i] is not None and second[i] is not None), key=second.__getitem__):
        if second[i] != last:
            matcher.set_seq2(last := second[i])
        matcher.set_seq1(first[i])
        bound = min(matcher.real_quick_ratio(), matcher.quick_ratio()) if least else 1.0
        out[i] = bound if bound < least else matcher.ratio()
    return pd.Series(out).where(~np.isnan(out), None).astype("float64")


def name_similarity(a: Column, b: Column, least: float = 0.0) -> Column:
    """Ratio of the matching blocks of two names, in lower case; not symmetric. Below ``least`` only an upper bound that is below it too."""
    return F.pandas_udf(lambda x, y: _ratios(x, y, least), T.DoubleType())(F.lower(a), F.lower(b))


class Alike:
    """The likest of some names that are still free, as :func:`name_similarity` has it (P31); names come in lower case and in order.

    Matching blocks are a common subsequence, so the longest one bounds the ratio from above. It is found for all free
    names at once, a bit of a word for each character of the name asked for; only those that it leaves are matched.
    """

    def __init__(self, found: list[str]) -> None:
        self.names, self.free = found, np.arange(len(found))
        self.sizes = np.array([len(n) for n in found], dtype=np.int64)
        letters = {c: i for i, c in enumerate(sorted(set("".join(found))), 1)}
        self.letters, self.codes = letters, np.zeros((int(self.sizes.max(initial=0)), len(found)), dtype=np.int32)
        for i, n in enumerate(found):
            self.codes[: len(n), i] = [letters[c] for c in n]

    def bounds(self, name: str) -> np.ndarray:
        """No less than the ratio of each free name."""
        sizes, n = self.sizes, len(name)
        if n > 64:
            common = np.minimum(sizes, n)
        else:
            masks = np.zeros(len(self.letters) + 1, dtype=np.uint64)
            for j, c in enumerate(name):
                if c in self.letters:
                    masks[self.letters[c]] |= np.uint64(1 << j)
            rest = np.full(len(sizes), np.uint64(2**64 - 1))
            for row in self.codes:
                both = rest & masks[row]
                rest = (rest + both) | (rest - both)
            own = ~rest & np.uint64((1 << n) - 1)
            common = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1, dtype=np.int64)
        total = sizes + n
        return np.where(total == 0, 1.0, 2.0 * common / np.maximum(total, 1))

    def take(self, name: str, least: float) -> int | None:
        """Place of the likest free name, the first of equal ones, which isn't free any more; None if none is like by ``least``."""
        bounds = self.bounds(name)
        best, at = least, None
        some = np.flatnonzero(bounds >= least)
        matcher = SequenceMatcher(None)
        matcher.set_seq1(name)
        for i in some[np.argsort(-bounds[some], kind="stable")].tolist():
            if bounds[i] < best:
                break
            if at is not None and bounds[i] == best and i > at:
                continue
            matcher.set_seq2(self.names[self.free[i]])
            ratio = matcher.ratio()
            if ratio > best or (ratio == best and (at is None or i < at)):
                best, at = ratio, i
        if at is None:
            return None
        taken = int(self.free[at])
        self.free, self.sizes, self.codes = np.delete(self.free, at), np.delete(self.sizes, at), np.delete(self.codes, at, axis=1)
        return taken


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; two empty ones are alike, an empty and another aren't."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


SIGNATURE = ("type", "required", "cardinality", "reference_target", "array_item_type", "deprecated")


def signature(prefix: str = "") -> Column:
    """What makes a property the same."""
    return F.struct(*[F.col(prefix + c).alias(c) for c in SIGNATURE])


def _shown(value: Column, name: str) -> Column:
    if name in ("required", "deprecated"):
        return F.when(value, "True").otherwise("False")
    quote = F.when(value.contains("'") & ~value.contains('"'), '"').otherwise("'")
    return F.concat(quote, value, quote)


def describe_change(old: Column, new: Column) -> Column:
    """Fields of two signatures that differ."""
    parts = [F.when(~old[n].eqNullSafe(new[n]), F.concat(F.lit(n + ": "), _shown(old[n], n), F.lit(" -> "), _shown(new[n], n))) for n in SIGNATURE]
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "; ")


def iri_part(name: Column) -> Column:
    """Without characters that an IRI can't have."""
    return F.translate(name, " :/`\"'<>{}|\\^", "___")


def member_part(owner: Column, name: Column) -> Column:
    """Local name of a member of an entity."""
    return F.concat(iri_part(owner), F.lit("."), F.translate(iri_part(name), ".-", "__"))


def term_part(name: Column) -> Column:
    """Local name of an entity in a context, which keeps more characters."""
    return F.translate(name, " :/", "___")


def term_member_part(owner: Column, name: Column) -> Column:
    """Local name of a member in a context."""
    return F.concat(F.translate(owner, " :", "__"), F.lit("."), F.translate(name, " :.-", "____"))


def rule_id(phase: Column, number: Column) -> Column:
    """Running id; numbers of over four digits stay whole."""
    return F.concat(F.lit("VAL-"), F.upper(F.substring(phase, 1, 4)), F.lit("-"), F.format_string("%04d", number))
