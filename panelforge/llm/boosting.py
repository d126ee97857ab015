"""Histogram gradient-boosted trees for two classes, in numpy.

Features are cut into at most 64 quantile bins. All nodes of a level grow together; a tree is a
complete binary tree in heap order, so a fitted model is three arrays (feature, threshold, value)
and scoring walks all rows of a batch down one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    feature: np.ndarray  # [trees, inner nodes]
    threshold: np.ndarray  # go right if greater
    value: np.ndarray  # [trees, leaves]
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(share: float) -> Trees:
    """A model without trees: every row gets ``share``."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return Trees(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), float(np.log(p / (1 - p))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0, least: float = 4.0) -> Trees:
    """Fit on rows ``x`` (finite floats) and labels ``y`` (0/1). One class only: a constant.

    ``least``: the least sum of second derivatives on either side of a split.
    """
    if not len(y):
        return constant(0.5)
    if y.min() == y.max():
        return constant(float(y[0]) * 0.998 + 0.001)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    start = constant(float(y.mean())).start
    margin, inner = np.full(n, start), (1 << depth) - 1
    out = ([], [], [])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            best, pick, cut = np.full(width, 1e-9), np.full(width, -1), np.zeros(width, np.int64)
            local = (node - first) * BINS
            for j in range(m):
                at = local + binned[:, j]
                gl = np.cumsum(np.bincount(at, g, width * BINS).reshape(width, BINS), axis=1)
                hl = np.cumsum(np.bincount(at, h, width * BINS).reshape(width, BINS), axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least) | (ht - hl < least)] = -np.inf
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], pick[better], cut[better] = top[better], j, k[better]
            for i in np.flatnonzero(pick >= 0).tolist():
                feature[first + i], threshold[first + i] = pick[i], cuts[pick[i]][cut[i]] if cut[i] < len(cuts[pick[i]]) else np.inf
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        margin += value[leaf]
        for kept, new in zip(out, (feature, threshold, value), strict=True):
            kept.append(new)
    return Trees(*map(np.array, out), start)
