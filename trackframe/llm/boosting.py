"""Histogram gradient-boosted trees for a yes / no label, kept as flat arrays.

Features are cut into quantile bins once; each tree level finds its splits from per-bin sums of
gradients and hessians. A fitted forest is five arrays, so that a batch of rows walks all
trees with a few numpy lookups a level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
RIDGE = 1.0
LEAST_HESSIAN = 2.0


@dataclass
class Forest:
    """Node k of all trees: feature[k] < 0 marks a leaf with value[k]; roots has each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    start: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            inner = f >= 0
            down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[node], self.left[node], self.right[node])
            node = np.where(inner, down, node)
        return 1 / (1 + np.exp(-(self.start + self.value[node].sum(axis=1))))


def constant(p: float) -> Forest:
    none = np.zeros(0)
    return Forest(none.astype(int), none, none.astype(int), none.astype(int), none, none.astype(int), float(np.log(p / (1 - p))), 0)


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """A forest for 0/1 labels; without rows it says 0.5, with one label only a constant near it."""
    if not len(y):
        return constant(0.5)
    p = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return constant(p)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    feature, cut, left, right, value, roots = [], [], [], [], [], []
    start = float(np.log(p / (1 - p)))
    total = np.full(len(y), start)

    def node() -> int:
        for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = prob - y, prob * (1 - prob)
        roots.append(node())
        front = [(roots[-1], np.arange(len(y)))]
        for level in range(depth + 1):
            following = []
            for k, rows in front:
                g, h = grad[rows].sum(), hess[rows].sum()
                best = (1e-6, -1, 0)
                if level < depth and h >= 2 * LEAST_HESSIAN:
                    for j, e in enumerate(edges):
                        if not len(e):
                            continue
                        b = binned[rows, j]
                        gl = np.cumsum(np.bincount(b, grad[rows], len(e) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, hess[rows], len(e) + 1))[:-1]
                        gain = gl**2 / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g**2 / (h + RIDGE)
                        gain[(hl < LEAST_HESSIAN) | (h - hl < LEAST_HESSIAN)] = 0
                        i = int(np.argmax(gain))
                        if gain[i] > best[0]:
                            best = (float(gain[i]), j, i)
                if best[1] < 0:
                    value[k] = -rate * g / (h + RIDGE)
                    total[rows] += value[k]
                    continue
                goes = binned[rows, best[1]] <= best[2]
                feature[k], cut[k], left[k], right[k] = best[1], float(edges[best[1]][best[2]]), node(), node()
                following += [(left[k], rows[goes]), (right[k], rows[~goes])]
            front = following
    arrays = [np.array(a) for a in (feature, cut, left, right, value, roots)]
    return Forest(*arrays, start, depth)
