"""Histogram gradient-boosted trees in numpy: fitted on a bounded sample, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete binary trees. Node ``k`` of a level-ordered tree leads to ``2k + 1`` if the
    feature is at most the threshold, else to ``2k + 2``; leaves follow the inner nodes."""

    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down a tree together, one level at a time."""
        rows = np.arange(len(x))
        out = np.full(len(x), self.base)
        inner = (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` cuts for each feature, at quantiles of its values."""
    cuts = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(column, cuts, method="lower")) for column in x.T]


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 100, depth: int = 4,
        bins: int = 64, rate: float = 0.1, ridge: float = 1.0, least: float = 5.0) -> Trees:
    """Log-loss trees on rows ``x`` with labels 0 or 1. With one kind of label, or none, the
    trees only hold that share. ``least`` is the weight that each side of a split must have."""
    w = np.ones(len(y)) if weight is None else weight.astype(float)
    share = float((w * y).sum() + 0.5) / float(w.sum() + 1)
    base = float(np.log(share / (1 - share)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if len(y) == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)), base, depth)
    edges = bin_edges(x, bins)
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    n_features = x.shape[1]
    margin = np.full(len(y), base)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for level in range(depth):
            first, width = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(width, 1e-9)
            cut = np.full(width, bins)
            for f in range(n_features):
                if not len(edges[f]):
                    continue
                key = at * bins + binned[:, f]
                sums = [np.bincount(key, v, width * bins).reshape(width, bins).cumsum(1) for v in (g, h, w)]
                gl, hl, wl = (s[:, :-1] for s in sums)
                ga, ha, wa = (s[:, -1:] for s in sums)
                gain = gl ** 2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga ** 2 / (ha + ridge)
                gain = np.where((wl >= least) & (wa - wl >= least), gain, 0.0)[:, :len(edges[f])]
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better], cut[better] = value[better], top[better]
                feature[first:first + width][better] = f
                threshold[first:first + width][better] = edges[f][top[better]]
            right = binned[np.arange(len(y)), feature[node]] > cut[at]
            node = 2 * node + 1 + right
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += value[leaf]
        found.append((feature, threshold, value))
    return Trees(*(np.array(part) for part in zip(*found, strict=True)), base, depth)
