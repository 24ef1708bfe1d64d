"""Histogram gradient-boosted trees for two classes, kept as flat arrays.

Features are cut into at most ``BINS`` quantile bins; each level of a tree is chosen from one histogram of
gradients per node, feature and bin. A finished model is three arrays over complete trees in heap order
(feature, threshold, value), so scoring walks all rows down one level with a single numpy step.
Training takes a bounded sample on the driver; scoring runs where the rows are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
SMOOTH = 1.0  # added to the second derivatives of a leaf
LEAST_ROWS = 5


@dataclass(frozen=True)
class Trees:
    base: float
    feature: np.ndarray  # [tree, inner node]
    threshold: np.ndarray  # [tree, inner node]; a row goes right if its value is above
    value: np.ndarray  # [tree, leaf]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of features."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.size else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while inner and len(at) and at[0] < inner:  # all rows stand on the same level
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Fit to features ``x`` (rows, features) and labels ``y`` (0 or 1).

    Without rows every score is 0.5; with one class it is that class's smoothed share.
    """
    n, inner = len(y), 2**depth - 1
    base = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))) if n else 0.0
    if n < 2 * LEAST_ROWS or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    features = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(features)]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    cells = binned + np.arange(features) * BINS
    score = np.full(n, base)
    out_feature, out_threshold, out_value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for tree in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            flat = ((node - first)[:, None] * (features * BINS) + cells).ravel()
            sums = [
                np.bincount(flat, None if w is None else np.repeat(w, features), nodes * features * BINS).reshape(nodes, features, BINS).cumsum(2)
                for w in (gradient, curve, None)
            ]
            (g, h, c), (ga, ha, ca) = sums, (s[:, :, -1:] for s in sums)
            gain = g**2 / (h + SMOOTH) + (ga - g) ** 2 / (ha - h + SMOOTH) - ga**2 / (ha + SMOOTH)
            gain[(c < LEAST_ROWS) | (ca - c < LEAST_ROWS)] = 0
            best = gain.reshape(nodes, -1).argmax(1)
            for k in range(nodes):
                f, b = divmod(int(best[k]), BINS)
                if gain[k, f, b] > 1e-9:
                    out_feature[tree, first + k], out_threshold[tree, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), out_feature[tree, node]] > out_threshold[tree, node])
        leaf = node - inner
        out_value[tree] = rate * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, curve, inner + 1) + SMOOTH)
        score += out_value[tree, leaf]
    return Trees(base, out_feature, out_threshold, out_value)
