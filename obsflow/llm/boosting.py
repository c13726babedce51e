"""Gradient-boosted regression trees for a yes/no target, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete trees of one depth over binned features; the sum of their leaves is a log-odds."""

    edges: list[np.ndarray]
    depth: int
    base: float = 0.0
    feature: list[np.ndarray] = field(default_factory=list)
    bound: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1).astype(np.int16)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > bound[node])
            out += leaf[node - (len(feature))]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, ridge: float = 2.0) -> Trees:
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    start = float((y * weight).sum() / weight.sum())
    model = Trees(edges, depth, float(np.log(start / (1 - start))))
    binned, n_bins = model.binned(x), bins + 1
    total = np.full(len(x), model.base)
    inner = (1 << depth) - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, curve = weight * (y - p), weight * p * (1 - p)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, n_bins, np.int64)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            place = node - first
            best = np.zeros(count)
            for k in range(x.shape[1]):
                key = place * n_bins + binned[:, k]
                g = np.bincount(key, gradient, count * n_bins).reshape(count, n_bins).cumsum(1)
                h = np.bincount(key, curve, count * n_bins).reshape(count, n_bins).cumsum(1)
                whole_g, whole_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (whole_g - g) ** 2 / (whole_h - h + ridge) - whole_g**2 / (whole_h + ridge)
                at = gain.argmax(1)
                better = gain[np.arange(count), at] > best + 1e-9
                best[better] = gain[np.arange(count), at][better]
                feature[first : first + count][better] = k
                bound[first : first + count][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > bound[node])
        place = node - inner
        leaf = rate * np.bincount(place, gradient, 1 << depth) / (np.bincount(place, curve, 1 << depth) + ridge)
        total += leaf[place]
        model.feature.append(feature)
        model.bound.append(bound)
        model.leaf.append(leaf)
    return model
