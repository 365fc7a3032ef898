"""Histogram gradient-boosted trees in numpy, kept as flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees in shared arrays: node ``i`` of tree ``t`` stands at
    ``t * nodes + i`` with children ``2 i + 1`` and ``2 i + 2``."""

    feature: np.ndarray  # -1 in a leaf
    cut: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; every level moves all rows through all trees at once."""
        nodes = (1 << (self.depth + 1)) - 1
        roots = np.arange(len(self.feature) // nodes) * nodes
        at = np.zeros((len(x), len(roots)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[roots + at]
            right = x[rows, np.maximum(f, 0)] > self.cut[roots + at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return 1 / (1 + np.exp(-(self.base + self.value[roots + at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees:
    """Boosted logistic regression trees on binned features.

    Gradients are summed by (node, bin) with one ``bincount`` a feature and
    level.  Without rows, or with one class only, the prior alone is returned.
    """
    n, width = x.shape
    nodes = (1 << (depth + 1)) - 1
    prior = (y.sum() + 1) / (n + 2)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, value = np.full(trees * nodes, -1), np.zeros(trees * nodes), np.zeros(trees * nodes)
    model = Trees(feature, cut, value, depth, base)
    if not n or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth + 1):
            first, count = (1 << level) - 1, 1 << level
            here = node - first
            live = here >= 0
            sums = [np.bincount(here[live], w[live], count) for w in (g, h)]
            value[t * nodes + first : t * nodes + first + count] = rate * sums[0] / (sums[1] + l2)
            if level == depth:
                break
            best, found, where = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, np.int64)
            for j in range(width):
                key = here[live] * bins + binned[live, j]
                gl, hl, nl = (np.bincount(key, w, count * bins).reshape(count, bins).cumsum(axis=1) for w in (g[live], h[live], None))
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = 0
                gain = gain[:, : len(edges[j])]
                if not gain.shape[1]:
                    continue
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better], found[better], where[better] = gain[np.arange(count), top][better], j, top[better]
            split = found >= 0
            at = t * nodes + first + np.flatnonzero(split)
            feature[at] = found[split]
            cut[at] = [edges[j][b] for j, b in zip(found[split], where[split])]
            moves = live.copy()
            moves[live] = split[here[live]]
            j, b = found[here[moves]], where[here[moves]]
            node[moves] = 2 * node[moves] + 1 + (binned[np.flatnonzero(moves), j] > b)
        score += _leaf_values(model, t, nodes, x)
    return model


def _leaf_values(model: Trees, t: int, nodes: int, x: np.ndarray) -> np.ndarray:
    one = Trees(*(a[t * nodes : (t + 1) * nodes] for a in (model.feature, model.cut, model.value)), model.depth, 0.0)
    p = one.predict(x)
    return np.log(p) - np.log1p(-p)
