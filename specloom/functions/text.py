"""Scalar text functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specloom.functions.lexicon import RFC2119, Lexicon


#: Inline code, attributes, anchors, references, and links with their label.
MARKUP = r"\{[^}]+\}|`([^`]+)`|\x5B\x5B[^\x5D]+\x5D\x5D|<<[^>]+>>|xref:[^\x5B]+\x5B([^\x5D]*)\x5D"
_ABOUT = r"(?s)(?:={2,6}|#{2,6})\s*+Description\s*\n\n*(.*?)(?=\n(?:\n|={2,6}|#{2,6})|\z)"


def found(text: Column, pattern: str) -> Column:
    """Whether the pattern is in the text, in any case."""
    return text.rlike("(?i)" + pattern)


def strip(text: Column) -> Column:
    """Without white space at either end; ``trim`` would leave line feeds."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def ladder(text: Column, steps: tuple[tuple[str, str], ...], default: str) -> Column:
    """Name of the first step whose pattern is in the text."""
    out = None
    for name, pattern in steps:
        out = F.when(found(text, pattern), name) if out is None else out.when(found(text, pattern), name)
    return F.lit(default) if out is None else out.otherwise(default)


def severity(sentence: Column, lexicon: Lexicon = RFC2119) -> Column:
    """Strength of a sentence, before markup is removed."""
    return ladder(sentence, lexicon.severities, lexicon.severity_default)


def phase(section: Column, paragraph: Column, lexicon: Lexicon = RFC2119) -> Column:
    """Validation phase by section title and whole paragraph."""
    return ladder(F.concat(section, F.lit(" "), paragraph), lexicon.phases, lexicon.phase_default)


def entity_refs(sentence: Column) -> Column:
    """P5: field-like tokens in backticks, then CamelCase words, each once, in order."""
    ticked = F.filter(
        F.regexp_extract_all(sentence, F.lit(r"`(\p{Alpha}[\p{Alnum}_.-]*)`"), 1),
        lambda t: t.contains(".") | t.contains("_") | t.rlike("^[a-z]"),
    )
    return F.array_distinct(F.concat(ticked, F.regexp_extract_all(sentence, F.lit(r"\b(\p{Upper}\p{Lower}+(?:\p{Upper}\p{Lower}+)+)\b"), 1)))


def clean_markup(text: Column) -> Column:
    """Link labels and code stay, other references go."""
    return strip(F.regexp_replace(text, MARKUP, "$1$2"))


def link_labels(text: Column) -> Column:
    """Links as their labels, where there is one."""
    return F.regexp_replace(text, r"xref:[^\x5B]+\x5B([^\x5D]+)\x5D", "$1")


def sentences(paragraph: Column) -> Column:
    """Sentences, which end before a capital."""
    return F.filter(F.transform(F.split(paragraph, r"(?<=[!.?])\s+(?=\p{Upper})"), strip), lambda s: s != "")


#: Characters before a table that say what it is about.
CONTEXT = 300


def context(before: Column) -> Column:
    return F.right(before, F.lit(CONTEXT))


def category(before: Column) -> Column:
    """Outcome that the 300 characters before a table speak of."""
    return ladder(context(before), (("failure", r"\bfailure\b"), ("informational", r"\binformational\b"), ("success", r"\bsuccess\b")), "unknown")


def skipped(paragraph: Column, lexicon: Lexicon = RFC2119) -> Column:
    """headings, attributes, directives and notes."""
    return found(strip(paragraph), lexicon.skip)


def without_deprecation(description: Column) -> Column:
    """Description without its mark."""
    return strip(F.regexp_replace(description, r"(?i)\(DEPRECATED\)", ""))


def assertion_description(text: Column) -> Column:
    """The paragraph after a Description heading, else the first of over 30 characters that is no heading; NULL if none."""
    headed = F.regexp_extract(text, _ABOUT, 1)
    has = text.rlike(_ABOUT)
    paragraphs = F.filter(F.transform(F.split(text, r"\n\n+"), strip), lambda p: (~p.rlike(r"^[=#\[]")) & (F.length(p) > 30))
    raw = F.when(has, strip(headed)).otherwise(F.when(F.size(paragraphs) > 0, paragraphs[0]))
    return F.when(raw != "", strip(F.regexp_replace(clean_markup(raw), r"\s+", " ")))
