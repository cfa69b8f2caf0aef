"""Operator 4, personal data: a linear-chain conditional random field over word-shape features.

The field is trained here on the small labelled table ``pii_labelled.txt`` and decoded by Viterbi in numpy batches.
Tokens are runs of letters, digits and ``@ . - + ( ) _ / :``, cut at all else; an equals sign is a token of its own.
Features are the shape of a token (what its characters are, how many) and the kinds of its neighbours, with a few words
such as ``token``, ``commit`` or ``tel`` told apart, as the same digits mean this or that after them.
"""

from __future__ import annotations

import pkgutil
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from specloom.llm import crf
from specloom.llm.common import pick, ready
from specloom.llm.kernel import Lookup, as_string, buffers, chunks, runs, span_hash
from specloom.session import table

#: Kinds whose values may be of several tokens; the first one has a label of its own.
SPLIT = ("CARD", "PHONE", "IBAN", "PERSON", "ADDRESS")
LABELS = ("O", "EMAIL", "IP", "SECRET", "NATIONAL_ID", "MAC", *(f"{x}{k}" for k in SPLIT for x in ("B-", "")))
KINDS = tuple(x for x in LABELS[1:] if x[:2] != "B-")
#: A row of the labelled table: a text with its personal data marked as ``[[KIND value]]``.
MARK = re.compile(rf"\[\[({'|'.join(KINDS)}) (.*?)\]\]")
HASHES = 1 << 13
#: Words that say what is next to them, by what they say; those with a capital count only so.
CUES = {
    word: kind
    for kind, words in {
        "secret": "token key apikey secret password passwd pwd bearer auth authorization credential credentials passwort clave jeton",
        "hash": "commit sha sha1 sha256 md5 hash checksum digest revision rev etag uuid build fingerprint",
        "phone": "tel phone telephone fax mobile cell telefon telefono handy portable call",
        "account": "iban konto cuenta compte account bic", "national": "ssn social passport", "title": "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mme Señor Señora",
        "street": "Street St Avenue Ave Road Rd Lane Ln Drive Boulevard Blvd Court Square Straße Strasse Weg Platz Allee Gasse Rue Calle Avenida Plaza Camino",
        "number": "order invoice ticket version isbn issn doi page serial number no nr id item part article rechnung",
    }.items()
    for word in words.split()
}

_LETTER, _TOKEN, _TRIM = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_TOKEN[[*np.flatnonzero(_LETTER), *range(48, 58), *b"@.-+()_/:"]] = True
_TRIM[[*b".-/:_"]] = True
_EQUALS = ord("=")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SHAPE = re.compile(r"([a-z\u0080-\U0010ffff]+)|([A-Z]+)|([0-9]+)|(.)")


def labelled_table() -> list[str]:
    """Marked texts: personal data of every kind among words, and numbers, hashes, versions, dates and names that are none."""
    return pkgutil.get_data("specloom.llm", "pii_labelled.txt").decode().splitlines()


def unmark(marked: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text and the spans that were marked."""
    text, spans, at = "", [], 0
    for m in MARK.finditer(marked):
        text += marked[at : m.start()]
        spans.append((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + marked[at:], spans


class Tokens(NamedTuple):
    """Byte ranges of the tokens of a chunk, which are words of letters alone (but for cues), and the tokens' range of every text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    plain: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray


def tokenize(part: pa.Array) -> Tokens:
    data, offsets = buffers(part)
    start, end = runs(_TOKEN[data], offsets)
    for _ in range(3):  # full stops and the like at a token's end are none of it
        trim = (end - start > 1) & _TRIM[data[end - 1]] if len(end) else np.zeros(0, bool)
        end = end - trim
    if len(end):  # a bracket without its partner is none of it either
        opened, closed = (np.concatenate([[0], np.cumsum(data == c)]) for c in b"()")
        single = end - start > 1
        end = end - (single & (data[end - 1] == 41) & (opened[end] == opened[start]))
        start = start + (single & (data[start] == 40) & (closed[end] == closed[start]))
    equal = np.flatnonzero(data == _EQUALS)
    if len(equal):
        start, end = np.concatenate([start, equal]), np.concatenate([end, equal + 1])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    plain = letters[end] - letters[start] == end - start
    at = np.flatnonzero(plain & (end - start <= _LONGEST))
    for bytes_, known in ((data, _CUES), (_LOWER[data], _LOWER_CUES)):
        plain[at[known(span_hash(bytes_, start[at], end[at]))[0]]] = False
    return Tokens(data, start, end, plain, np.searchsorted(start, offsets), offsets)


def _cue_lookup(cues: list[str]) -> Lookup:
    data, offsets = buffers(pa.array(cues))
    return Lookup(span_hash(data, offsets[:-1], offsets[1:]), 16)


_CUES, _LOWER_CUES = _cue_lookup(sorted(CUES)), _cue_lookup(sorted(c for c in CUES if c.islower()))
_LONGEST = max(len(c.encode()) for c in CUES)


def cue_of(token: str) -> str:
    """What a token says of its neighbours, if it or a part of it is a cue."""
    for part in (token, *re.split(r"[^A-Za-z]+", token)):
        kind = CUES.get(part) or CUES.get(part.lower(), "") if part else ""
        if kind and (part in CUES or part.lower() in CUES):
            return kind
    return ""


def _bucket(n: int) -> int:
    return n if n < 5 else 5 if n < 8 else 6 if n == 8 else 7 if n < 13 else n if n < 17 else 17 if n < 31 else 18 if n < 66 else 19


def shape(token: str) -> str:
    """Kinds of characters, each run once: ``ab1.Co`` is ``a0.Aa``."""
    return "".join("a" if m[1] else "A" if m[2] else "0" if m[3] else m[4] for m in _SHAPE.finditer(token))


def own_features(token: str) -> list[str]:
    s = shape(token)
    n = sum(c.isdigit() for c in token)
    letters = [c for c in token if c.isalpha()]
    hexes = len(token) >= 24 and bool(letters) and n > 2 and set(token) <= set("0123456789abcdefABCDEF")
    return [
        "s" + (s if len(s) < 12 else "long"), f"n{_bucket(n)}", f"l{_bucket(len(token))}", f"h{hexes}", f"d{token.count('.')}{n == len(token) - token.count('.')}",
        f"@{min(token.count('@'), 2)}{token[:1] == '@'}{'.' in token[token.find('@') :]}", f"m{token.count('-')}{n == len(token) - token.count('-')}{_bucket(n)}",
        f"i{bool(re.fullmatch(r'(?:[0-9]{1,3}\.){3}[0-9]{1,3}', token))}", f"e{n == len(token)}{_bucket(n)}",
        f"x{_colons(token)}", f"k{_KEY.match(token) is not None}{len(token) >= 20 and len(set(s) & set('aA0')) == 3}", f"q{cue_of(token)}{bool(re.fullmatch('[A-Z]{2}[0-9]{2}[A-Z0-9]*', token))}",
    ]


#: How well-known keys begin.
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{12}|gh[pousr]_|sk[-_]|xox[abp]-|eyJ[A-Za-z0-9_-]+\.|AIza")


def _colons(token: str) -> str:
    """Groups of hexadecimal digits between colons or hyphens: those of an IPv6 or a hardware address."""
    if re.fullmatch(r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", token):
        return "mac"
    groups = token.split(":")
    six = 3 <= len(groups) <= 9 and all(re.fullmatch("[0-9a-fA-F]{0,4}", g) for g in groups) and (len(groups) == 8 or "::" in token)
    return "six" if six else str(min(len(groups), 4))


#: Features of a token, and what its neighbours tell: the one before, the one after, and the second before.
_OWN = 12
_WIDTH = _OWN + 3


def kind_of(token: str) -> str:
    s = shape(token)
    return (s if len(s) < 8 else "long") + ("=" if token == "=" else "") + cue_of(token)


def _slot(feature: str) -> int:
    h = 2166136261
    for b in feature.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % HASHES


_cache: dict[str, tuple[list[int], int, int, int]] = {}


def _token(token: str) -> tuple[list[int], int, int, int]:
    if token not in _cache:
        if len(_cache) > 200_000:
            _cache.clear()
        k = kind_of(token)
        _cache[token] = ([_slot(f) for f in own_features(token)], _slot("before:" + k), _slot("after:" + k), _slot("second:" + k))
    return _cache[token]


def _word(kind: str) -> tuple[list[int], int, int, int]:
    return [_slot(kind)] * _OWN, _slot("before:" + kind), _slot("after:" + kind), _slot("second:" + kind)


#: Features of plain words: in small letters, and with a capital.
_WORDS = (_word("plain"), _word("capital"))
_EDGE = _word("edge")


def active_features(t: Tokens) -> np.ndarray:
    """Numbers of every token's features."""
    n = len(t.start)
    out = np.empty((n, _WIDTH), np.int32)
    capital = ((t.data[t.start] - 65) < 26).astype(int) if n else np.zeros(0, int)
    out[:, :_OWN] = np.array([w[0] for w in _WORDS], np.int32)[capital]
    tells = np.array([w[1:] for w in _WORDS], np.int32)[capital]
    odd = np.flatnonzero(~t.plain)
    raw = t.data.tobytes()
    for i, a, b in zip(odd.tolist(), t.start[odd].tolist(), t.end[odd].tolist()):
        own, *tells[i] = _token(raw[a:b].decode("utf-8", "replace"))
        out[i, :_OWN] = own
    out[1:, _OWN], out[:-1, _OWN + 1], out[2:, _OWN + 2] = tells[:-1, 0], tells[1:, 1], tells[:-2, 2]
    live = np.flatnonzero(np.diff(t.bounds))
    first, last = t.bounds[live], t.bounds[live + 1] - 1
    out[first, _OWN], out[last, _OWN + 1] = _EDGE[1], _EDGE[2]
    out[first, _OWN + 2] = _EDGE[3]
    second = first[last > first] + 1
    out[second, _OWN + 2] = _EDGE[3]
    return out


def gold_labels(t: Tokens, spans: list[list[tuple[int, int, str]]], texts: list[str]) -> np.ndarray:
    """Labels of tokens that lie in marked spans (of characters)."""
    y = np.zeros(len(t.start), np.int64)
    for i, (text, own) in enumerate(zip(texts, spans)):
        for a, b, kind in own:
            lo, hi = (int(t.offsets[i]) + len(text[:x].encode()) for x in (a, b))
            inside = [k for k in range(t.bounds[i], t.bounds[i + 1]) if t.start[k] < hi and t.end[k] > lo]
            for j, k in enumerate(inside):
                y[k] = LABELS.index("B-" + kind if kind in SPLIT and j == 0 else kind)
    return y


def train(marked: list[str], rounds: int = 120) -> crf.Weights:
    """The field of a labelled table."""
    texts, spans = zip(*map(unmark, marked)) if marked else ((), ())
    t = tokenize(pa.array(texts, pa.string()))
    return crf.train(active_features(t), gold_labels(t, list(spans), list(texts)), t.bounds, HASHES, len(LABELS), ridge=0.3, rounds=rounds)


_certainty: dict[int, tuple[crf.Weights, bool, int]] = {}


def _certain(w: crf.Weights) -> tuple[bool, int]:
    """Whether a word in small letters among words is O on every best path, and up to which number words with a capital between two such words are.

    The first holds if its lead over each other label exceeds whatever the transitions of that label can give back,
    whatever the labels beside it; the second is found by decoding them.
    """
    if id(w.feature) not in _certainty:
        own, before, after, second = (w.feature[np.array([x[i] for x in _WORDS])] for i in range(4))
        score = own.sum(1)[:, None, None, None] + before[:, None, None] + after[:, None] + second
        give = (w.step[:, 1:] - w.step[:, :1]).max(0) + (w.step[1:] - w.step[:1]).max(1)
        sure = bool((score[0, ..., :1] - score[0, ..., 1:] - give).min() > 0)
        calm = 0
        ends = np.full((1, len(LABELS)), -1e9)
        ends[0, 0] = 0
        while sure and calm < 32:
            found = 0
            for outer in (0, 1):  # what is before the word before them
                case = [outer, 0, *[1] * (calm + 1), 0]
                e = np.array([score[case[i], case[i - 1], case[i + 1], case[i - 2]] for i in range(2, calm + 3)])
                found += crf.viterbi(np.concatenate([ends, e, ends]), np.array([0, calm + 3]), w._replace(first=w.first * 0, last=w.last * 0)).any()
            if found:
                break
            calm += 1
        _certainty[id(w.feature)] = (w, sure, calm)
    return _certainty[id(w.feature)][1:]


def decode(t: Tokens, w: crf.Weights) -> np.ndarray:
    """Viterbi labels of all tokens.

    Words that are certainly O cut the chain exactly: only runs of other tokens, and of words with a capital beside
    them, with a certain word on either side, are decoded.
    """
    active = active_features(t)
    sure, calm = _certain(w)
    n = len(t.start)
    if not sure:
        return crf.viterbi(crf.emissions(active, w), t.bounds, w)
    odd = ~t.plain
    near = odd.copy()
    near[1:] |= odd[:-1]
    near[2:] |= odd[:-2]
    near[:-1] |= odd[1:]
    live = np.flatnonzero(np.diff(t.bounds))
    first, last = t.bounds[live], t.bounds[live + 1] - 1
    near[first] = near[last] = near[np.minimum(first + 1, last)] = True  # these have other features
    # words with a capital are decoded with what they touch, or where they are too many
    capital = t.plain & ((t.data[t.start] - 65) < 26)
    a, b = runs(capital, t.bounds)
    reach = np.concatenate([[0], np.cumsum(near)])
    touched = (reach[np.minimum(b + 1, n)] > reach[np.maximum(a - 1, 0)]) | (b - a > calm)
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, a[touched], 1)
    np.add.at(mark, b[touched], -1)
    near |= np.cumsum(mark[:-1]) > 0
    keep = near.copy()
    keep[1:] |= near[:-1]
    keep[:-1] |= near[1:]
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(n, np.int64)
    row = np.searchsorted(t.bounds, at, "right") - 1
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row) != 0)) + 1
    e = crf.emissions(active[at], w)
    starts, ends = at[np.r_[0, cut]], at[np.r_[cut, len(at)] - 1]
    pinned = np.concatenate([np.r_[0, cut][starts != t.bounds[row[np.r_[0, cut]]]], (np.r_[cut, len(at)] - 1)[ends + 1 != t.bounds[row[np.r_[cut, len(at)] - 1] + 1]]])
    e[pinned, 1:] = -1e9  # a run's ends that aren't a text's are certain words
    out = np.zeros(n, np.int64)
    out[at] = crf.viterbi(e, np.r_[0, cut, len(at)], w)
    return out


def find(arr: pa.Array, w: crf.Weights) -> list[list[dict]]:
    """Personal data of every text: kind, first and last character, value."""
    out: list[list[dict]] = [[] for _ in range(len(arr))]
    for first, part in chunks(as_string(arr)):
        t = tokenize(part)
        label = decode(t, w)
        hit = np.flatnonzero(label)
        if not len(hit):
            continue
        row = np.searchsorted(t.bounds, hit, "right") - 1
        raw = t.data.tobytes()
        last: dict | None = None
        spans: list[tuple[int, str, int, int]] = []  # row, kind, bytes
        for r, k in zip(row.tolist(), hit.tolist()):
            y = int(label[k])
            kind = LABELS[y].removeprefix("B-")
            if last and last["at"] == (r, k - 1) and last["kind"] == kind and kind in SPLIT and LABELS[y] == kind:
                spans[-1] = (r, kind, spans[-1][2], int(t.end[k]))
            else:
                spans.append((r, kind, int(t.start[k]), int(t.end[k])))
            last = {"at": (r, k), "kind": kind}
        chars = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])
        for r, kind, a, b in spans:
            base = chars[t.offsets[r]]
            out[first + r].append({"kind": kind, "start_char": int(chars[a] - base), "end_char": int(chars[b] - base), "value": raw[a:b].decode("utf-8", "replace")})
    return out


def personal_data(docs: DataFrame, labelled: list[str] | None = None) -> DataFrame:
    """Personal data in ``docs``: id, kind, character range and value, a row each.

    NULL and empty texts have none; rows with NULL ids and repeated rows are searched like all others. Labels of equal
    scores fall to the first of ``LABELS``. An empty table gives no rows.
    """
    ready(docs)
    w = train(labelled_table() if labelled is None else labelled)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start_char", pa.int64()), ("end_char", pa.int64()), ("value", pa.string())]))

    @arrow_udf("array<struct<kind string, start_char bigint, end_char bigint, value string>>")
    def search(a: pa.Array) -> pa.Array:
        return pa.array(find(a, w), kind)

    d = pick(docs, "doc_id", "text")
    return d.select("doc_id", F.explode(search("text")).alias("p")).select("doc_id", "p.*")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op4_pii": op4_pii}
ORACLES: dict[str, str] = {}
