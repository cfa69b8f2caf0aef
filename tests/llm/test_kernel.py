"""The text kernel against plain Python."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from specloom.llm import kernel as k

TEXTS = st.lists(st.text(alphabet=st.sampled_from(list("aB1_ .,!\nßéÑ日İ-")), max_size=30), max_size=8)


def plain(texts):
    return [re.findall(k.WORD, t) for t in pa.compute.utf8_lower(pa.array(texts, pa.string())).to_pylist()]


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words(texts):
    w = k.words(pa.array(texts, pa.string()))
    got = [[bytes(w.data[a:b]).decode() for a, b in zip(w.start[lo:hi], w.end[lo:hi])] for lo, hi in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == plain(texts)
    # equal words have equal hashes, others other ones
    flat = [x for row in got for x in row]
    assert len(set(flat)) == len(set(w.hash.tolist())) and len({*zip(flat, w.hash.tolist())}) == len(set(flat))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 4), st.booleans())
def test_shingles(texts, n, short):
    h, bounds = k.shingles(k.words(pa.array(texts, pa.string())), n, short)
    want = [[tuple(w[i : i + n]) for i in range(len(w) - n + 1)] or ([tuple(w)] if w and short else []) for w in plain(texts)]
    assert np.diff(bounds).tolist() == [len(x) for x in want]
    flat = [x for row in want for x in row]
    assert len(set(flat)) == len(set(h.tolist())) and len({*zip(flat, h.tolist())}) == len(set(flat))
    d, db = k.distinct(h, bounds)
    assert [sorted(set(h[a:b].tolist())) for a, b in zip(bounds[:-1], bounds[1:])] == [d[a:b].tolist() for a, b in zip(db[:-1], db[1:])]


def test_chunks_and_slices():
    a = pa.array(["ab cd", None, "", "x" * 50, "é é"])
    whole = k.words(k.as_string(a))
    parts = [k.words(p) for _, p in k.chunks(k.as_string(a), 8)]
    assert np.concatenate([p.hash for p in parts]).tolist() == whole.hash.tolist()
    assert k.words(k.as_string(a.slice(3, 2))).hash.tolist() == whole.hash[-3:].tolist()
    assert not len(k.words(pa.array([], pa.string())).hash)


def test_lookup():
    rng = np.random.default_rng(1)
    keys, other = rng.integers(0, 2**64, 500, dtype=np.uint64), rng.integers(0, 2**64, 5000, dtype=np.uint64)
    h = np.concatenate([other, keys])
    at, slot = k.Lookup(keys, 8)(h)
    assert at.tolist() == list(range(5000, 5500)) and (k.Lookup(keys, 8).keys[slot] == h[at]).all()
