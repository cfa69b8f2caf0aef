"""Linear-chain conditional random fields in numpy: training by gradient, decoding by Viterbi over ragged batches."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Weights(NamedTuple):
    """Scores of features (a row each), of label pairs, and of first and last labels."""

    feature: np.ndarray
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def emissions(active: np.ndarray, w: Weights) -> np.ndarray:
    """Label scores of tokens from the numbers of their active features, a row each."""
    return w.feature[active].sum(1)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _step(x: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Log of ``exp(x) @ factor``, row by row."""
    top = x.max(1, keepdims=True)
    return top + np.log(np.exp(x - top) @ factor)


def _order(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the non-empty sequences, longest first, their numbers, and how many are longer than t."""
    length = np.diff(bounds)
    order = np.argsort(-length, kind="stable")
    order = order[length[order] > 0]
    longest = int(length.max(initial=0))
    alive = np.searchsorted(-length[order], -np.arange(longest), "left")
    return bounds[:-1][order], length[order], alive


def viterbi(e: np.ndarray, bounds: np.ndarray, w: Weights) -> np.ndarray:
    """Best label of every token; sequences are the ranges of ``bounds``. All sequences step together, unpadded.

    Of equal scores the smaller label wins.
    """
    out = np.zeros(len(e), np.int64)
    start, length, alive = _order(bounds)
    if not len(start):
        return out
    score = e[start] + w.first
    back = np.zeros(e.shape, np.int8)
    for t in range(1, len(alive)):
        n = alive[t]
        s = score[:n, :, None] + w.step
        back[start[:n] + t] = s.argmax(1)
        score[:n] = s.max(1) + e[start[:n] + t]
    label = (score + w.last).argmax(1)
    for t in range(len(alive) - 1, 0, -1):
        n = alive[t]
        at = start[:n] + t
        out[at] = label[:n]
        label[:n] = back[at, label[:n]]
    out[start] = label
    return out


def gradient(active: np.ndarray, y: np.ndarray, bounds: np.ndarray, w: Weights) -> tuple[float, Weights]:
    """Log-likelihood of the labels and its gradient."""
    e, (start, length, alive) = emissions(active, w), _order(bounds)
    labels = e.shape[1]
    fwd, bwd = np.empty_like(e), np.empty_like(e)
    factor = np.exp(w.step)
    fwd[start] = e[start] + w.first
    for t in range(1, len(alive)):
        at = start[: alive[t]] + t
        fwd[at] = _step(fwd[at - 1], factor) + e[at]
    bwd[start + length - 1] = w.last
    for t in range(len(alive) - 1, 0, -1):
        at = start[: alive[t]] + t
        bwd[at - 1] = _step(e[at] + bwd[at], factor.T)
    z = _lse(fwd[start + length - 1] + w.last, 1)
    row = np.zeros(len(e), np.int64)
    row[start] = np.arange(len(start))
    head = np.zeros(len(e), bool)
    head[start] = True
    of = np.empty(len(e), np.int64)
    position = np.flatnonzero(head)
    of[:] = np.repeat(row[position], np.diff(np.append(position, len(e))))
    node = np.exp(fwd + bwd - z[of][:, None])
    inner = np.flatnonzero(~head)
    before, after = fwd[inner - 1], e[inner] + bwd[inner]
    tops = before.max(1, keepdims=True), after.max(1, keepdims=True)
    scale = np.exp(tops[0] + tops[1] - z[of[inner]][:, None])
    pair = (np.exp(before - tops[0]) * scale).T @ np.exp(after - tops[1]) * factor
    gold = np.zeros_like(node)
    gold[np.arange(len(e)), y] = 1
    diff = gold - node
    f = np.stack([np.bincount(active.ravel(), np.repeat(diff[:, k], active.shape[1]), len(w.feature)) for k in range(labels)], 1)
    seen = np.zeros_like(w.step)
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    end = start + length - 1
    value = e[np.arange(len(e)), y].sum() + (w.step * seen).sum() + w.first[y[start]].sum() + w.last[y[end]].sum() - z.sum()
    return float(value), Weights(f, seen - pair, diff[start].sum(0), diff[end].sum(0))


def train(active: np.ndarray, y: np.ndarray, bounds: np.ndarray, features: int, labels: int, ridge: float = 0.5, rounds: int = 120, rate: float = 0.15) -> Weights:
    """Weights by Adam on the ridge log-likelihood; deterministic."""
    w = [np.zeros((features, labels)), np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels)]
    m, v = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for k in range(1, rounds + 1):
        _, g = gradient(active, y, bounds, Weights(*w))
        for i in range(4):
            step = g[i] - ridge * w[i]
            m[i] = 0.9 * m[i] + 0.1 * step
            v[i] = 0.99 * v[i] + 0.01 * step * step
            w[i] = w[i] + rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return Weights(*w)
