"""Keyword ladders of the text operators, as data: the first pattern that is found decides."""

from __future__ import annotations

from typing import NamedTuple


class Lexicon(NamedTuple):
    """Ladders and cuts of rule extraction. Patterns are Java ones, matched in any case."""

    severities: tuple[tuple[str, str], ...]
    severity_default: str
    phases: tuple[tuple[str, str], ...]
    phase_default: str
    normative: str
    skip: str
    paragraph: str = r"\n\n+"
    header: str = r"#{2,6}"
    min_length: int = 20
    description_cap: int = 500
    source_cap: int = 200
    reference_cap: int = 10


#: Keywords of RFC 2119 and the phases that they are validated in.
RFC2119 = Lexicon(
    severities=(
        ("must_not", r"\bmust not\b"), ("shall_not", r"\bshall not\b"), ("should_not", r"\bshould not\b"),
        ("must", r"\bmust\b"), ("shall", r"\bshall\b"), ("should", r"\bshould\b"), ("may", r"\bmay\b"),
    ),
    severity_default="may",
    phases=(
        ("cryptographic", r"\bcryptograph|\b(?:signature|signing|cose)\b"), ("trust", r"\btrust\b"), ("timestamp", r"\btime.?stamp\b"),
        ("assertion", r"\bassertion\b"), ("ingredient", r"\bingredient\b"), ("content", r"\b(?:content|binding|hash)\b"),
        ("structural", r"\b(?:structure|well.formed|cbor|malformed)\b"),
    ),
    phase_default="structural",
    normative=r"\b(?:shall|must|should|may)\b",
    skip=r"^\s*(?:image::|include::|\[|#|(?:NOTE|TIP|WARNING|CAUTION|IMPORTANT):|\.{1,3}\s)",
)

#: Words of the invented prose in the driver's ``documents`` that stand in for the normative ones.
PROSE = RFC2119._replace(
    severities=(("must", r"\bthat\b"), ("should", r"\bfor\b"), ("may", r"\bof\b")),
    phases=(("cryptographic", r"\b(?:hers|der|und)\b"), ("trust", r"\bla\b"), ("timestamp", r"\bre.?st\b"), ("content", r"\b(?:ing|and)\b")),
    normative=r"\b(?:that|for|of)\b",
    paragraph=r"\n+",
)
