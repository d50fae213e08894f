"""Gradient-boosted trees for binary labels on binned features, in numpy; small training sets, scored in Spark tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Bins of a feature at most.
BINS = 32


@dataclass
class Boosted:
    """Trees of a fixed depth as arrays: at node i the children are 2i + 1 and 2i + 2."""

    edges: list[np.ndarray]
    base: float
    depth: int
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # feature, bin, leaf values

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def leaf(self, b: np.ndarray, feature: np.ndarray, cut: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(b), np.int64), np.arange(len(b))
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
        return at - (2**self.depth - 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of label 1."""
        b = self.binned(x)
        total = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            total += value[self.leaf(b, feature, cut)]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Fit by Newton steps on the logistic loss; each level splits all its nodes at their best (feature, bin)."""
    edges = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        edges.append((values[:-1] + values[1:]) / 2 if len(values) <= BINS else np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])))
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(edges, float(np.log(share / (1 - share))), depth)
    b = model.binned(x)
    total = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, 255, np.int64)  # bin 255: all rows go left
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, size = 2**level - 1, 2**level
            best = np.full(size, 1e-6)
            for k in range(x.shape[1]):
                slot = (at - first) * BINS + b[:, k]
                gs, hs = (np.bincount(slot, v, size * BINS).reshape(size, BINS).cumsum(axis=1) for v in (g, h))
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
                gain[(hs < 1) | (ha - hs < 1)] = 0
                where = gain.argmax(axis=1)
                value = gain[np.arange(size), where]
                better = value > best
                best[better] = value[better]
                feature[first : first + size][better] = k
                cut[first : first + size][better] = where[better]
            at = 2 * at + 1 + (b[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append((feature, cut, value))
        total += value[leaf]
    return model
