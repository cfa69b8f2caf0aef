"""Vectorised text kernel: word boundaries and hashes straight from Arrow's UTF-8 buffers.

A word is a maximal run of ASCII letters, digits, ``_`` or non-ASCII characters of the lower-cased text;
in SQL: ``regexp_extract_all(lower(text), WORD)``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD = r"(?:[a-z0-9_]|[^\x00-\x7F])+"
#: Bytes of text handled at once; bounds the kernel's memory, not what it reads, and keeps its arrays in the cache.
CHUNK = 1 << 18

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=U)
_BASE, _JOIN = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), 95, *range(128, 256)]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit is usable."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h = h * U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, CHUNK + 1)
        with np.errstate(over="ignore"):
            for name, base in (("up", int(_BASE)), ("down", pow(int(_BASE), -1, 2**64))):
                p = np.full(size, base, U)
                p[0] = 1
                _powers[name] = np.multiply.accumulate(p)
    return _powers["up"], _powers["down"]


class Words(NamedTuple):
    """Words of a chunk of texts: byte offsets into ``data``, hash, and the words' range of every text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def as_string(arr) -> pa.Array:
    """A plain string array without nulls; NULL counts as the empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and the rows' offsets into them."""
    offsets = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1, arr.offset * 4).astype(np.int64)
    raw = arr.buffers()[2]
    data = np.frombuffer(raw, np.uint8, offsets[-1] - offsets[0], offsets[0]) if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(arr: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of whole rows of about ``size`` bytes (a longer row is a slice of its own)."""
    _, offsets = buffers(arr)
    at = 0
    while at < len(arr):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, arr.slice(at, to - at)
        at = to


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of True that stay inside a row."""
    edge = np.zeros(len(mask) + 1, bool)
    edge[offsets[:-1]] = True
    before = np.empty_like(mask)
    if len(mask):
        before[0] = False
        before[1:] = mask[:-1]
    before &= ~edge[:-1]
    start = np.flatnonzero(mask & ~before)
    after = np.zeros_like(mask)
    edge[-1] = True
    if len(mask):
        after[:-1] = mask[1:]
    edge[offsets[1:]] = True
    after &= ~edge[1:]
    return start, np.flatnonzero(mask & ~after) + 1


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of every byte span, from one prefix sum."""
    up, down = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U))


def words(arr: pa.Array) -> Words:
    data, offsets = buffers(as_string(pc.utf8_lower(arr)))
    start, end = runs(_WORD[data], offsets)
    return Words(data, start, end, span_hash(data, start, end), np.searchsorted(start, offsets), offsets)


def shingles(w: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in order, and the range of every text.

    A text of 1 to k-1 words has all its words as its one shingle if ``short``, else none.
    """
    h, counts = w.hash, np.diff(w.bounds)
    n = len(h)
    full = np.zeros(n, U)
    if n >= k:
        acc = h[: n - k + 1].copy()
        for j in range(1, k):
            acc = acc * _JOIN + h[j : n - k + 1 + j]
        full[: n - k + 1] = mix(acc + U(k))
    per = np.maximum(counts - k + 1, 0)
    starts = w.bounds[:-1]
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, starts[per > 0], 1)
    np.add.at(keep, (starts + per)[per > 0], -1)
    mask = np.cumsum(keep[:-1]) > 0
    if short:
        for m in range(1, k):
            at = starts[counts == m]
            if len(at):
                acc = h[at].copy()
                for j in range(1, m):
                    acc = acc * _JOIN + h[at + j]
                full[at] = mix(acc + U(m))
                mask[at] = True
                per[counts == m] = 1
    return full[mask], np.concatenate([[0], np.cumsum(per)])


def distinct(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every row."""
    h = h.copy()
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[lo:hi].sort()
    first = np.ones(len(h), bool)
    first[1:] = h[1:] != h[:-1]
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    return h[first], np.concatenate([[0], np.cumsum(first)])[bounds]


class Lookup:
    """Which of many hashes are in a fixed set, and where: a bit table in front of a binary search."""

    def __init__(self, keys: np.ndarray, bits: int = 20) -> None:
        self.keys, self.mask = np.unique(keys), U((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[self.keys & self.mask] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that are in the set, and their index in ``keys``."""
        at = np.flatnonzero(self.table[h & self.mask])
        if not len(at):
            return at, at
        slot = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[slot] == h[at]
        return at[hit], slot[hit]
