"""Gradient-boosted trees on binned features and isotonic calibration, in NumPy.

Training takes a bounded sample on the driver; the fitted model is a few arrays
that tasks evaluate on whole batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of a fixed depth in heap order, with logistic loss."""

    base: float
    depth: int
    features: list[np.ndarray] = field(default_factory=list)
    cuts: list[np.ndarray] = field(default_factory=list)
    leaves: list[np.ndarray] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    bins: int = 32,
    ridge: float = 1.0,
    least_rows: int = 3,
) -> Boosted:
    """Boosted trees for labels 0 and 1; splits by histograms of quantile bins."""
    n, n_features = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(share / (1 - share))), depth)
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            best = np.zeros(width)
            chosen = np.full(width, -1)
            for j, edge in enumerate(edges):
                if not len(edge):
                    continue
                size = len(edge) + 1
                cell = at * size + binned[:, j]
                g, h, c = (
                    np.bincount(cell, w, width * size).reshape(width, size).cumsum(axis=1)
                    for w in (gradient, hessian, np.ones(n))
                )
                left = g[:, :-1] ** 2 / (h[:, :-1] + ridge)
                right = (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(c[:, :-1] < least_rows) | (c[:, -1:] - c[:, :-1] < least_rows)] = 0
                top = gain.argmax(axis=1)
                value = gain[np.arange(width), top]
                better = value > best + 1e-12
                best[better] = value[better]
                chosen[better] = j
                feature[first : first + width][better] = j
                cut[first : first + width][better] = edge[top[better]]
            go_right = (chosen[at] >= 0) & (x[np.arange(n), feature[node]] > cut[node])
            node = 2 * node + 1 + go_right
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
        value = rate * g / (h + ridge)
        score += value[leaf]
        model.features.append(feature)
        model.cuts.append(cut)
        model.leaves.append(value)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map from raw scores to probabilities, linear between its knots."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(raw, self.x, self.y), 0.0, 1.0)


def isotonic(raw: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators, with ties pooled first and one virtual row of each label for smoothing."""
    if len(raw) == 0:
        return Isotonic(np.array([0.0]), np.array([0.5]))
    order = np.argsort(raw, kind="stable")
    values, start = np.unique(raw[order], return_index=True)
    count = np.diff(np.append(start, len(raw))).astype(float)
    total = np.add.reduceat(y[order].astype(float), start)
    blocks: list[list[float]] = []
    for v, t, c in zip(values, total, count, strict=True):
        blocks.append([v, v, t, c])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, t2, c2 = blocks.pop()
            blocks[-1][1] = high
            blocks[-1][2] += t2
            blocks[-1][3] += c2
    knots, means = [], []
    for low, high, t, c in blocks:
        mean = t / c
        mean += (0.5 - mean) / (c + 1) * 0.5
        for v in dict.fromkeys((low, high)):
            knots.append(v)
            means.append(mean)
    return Isotonic(np.array(knots), np.maximum.accumulate(np.array(means)))
