"""Gradient-boosted trees of depth two, fitted on the driver on a bounded table and applied as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, own: np.ndarray):
    """(gain, feature, threshold) of the best cut of these rows."""
    best = (1e-9, -1, 0.0)
    total = g[own].sum() ** 2 / (h[own].sum() + 1)
    for f in range(x.shape[1]):
        for t in np.unique(x[own, f])[1:]:
            left = own & (x[:, f] < t)
            right = own & ~left
            gain = g[left].sum() ** 2 / (h[left].sum() + 1) + g[right].sum() ** 2 / (h[right].sum() + 1) - total
            if gain > best[0]:
                best = (gain, f, float(t))
    return best


class Boosted:
    """Logistic loss; a tree is (feature, threshold, left, right) or a leaf's value. Scores are calibrated by a fitted line on the log-odds."""

    def __init__(self, trees: int = 25, rate: float = 0.3, depth: int = 2):
        self.count, self.rate, self.depth, self.trees, self.line = trees, rate, depth, [], (1.0, 0.0)

    def _grow(self, x, g, h, own, depth):
        _, f, t = _split(x, g, h, own) if depth else (0, -1, 0.0)
        if f < 0:
            return float(self.rate * g[own].sum() / (h[own].sum() + 1))
        left = own & (x[:, f] < t)
        return (f, t, self._grow(x, g, h, left, depth - 1), self._grow(x, g, h, own & ~left, depth - 1))

    def _value(self, tree, x):
        if isinstance(tree, float):
            return np.full(len(x), tree)
        f, t, a, b = tree
        return np.where(x[:, f] < t, self._value(a, x), self._value(b, x))

    def raw(self, x: np.ndarray) -> np.ndarray:
        return sum((self._value(t, x) for t in self.trees), np.zeros(len(x)))

    def fit(self, x: np.ndarray, y: np.ndarray, xc: np.ndarray, yc: np.ndarray) -> Boosted:
        """Trees from (x, y), calibration from (xc, yc)."""
        for _ in range(self.count):
            p = 1 / (1 + np.exp(-self.raw(x)))
            self.trees.append(self._grow(x, y - p, p * (1 - p), np.ones(len(x), bool), self.depth))
        s, a, b = self.raw(xc), 1.0, 0.0
        for _ in range(200):
            gap = yc - 1 / (1 + np.exp(-(a * s + b)))
            a, b = a + 0.5 * ((gap * s).mean() - 1e-3 * (a - 1)), b + 0.5 * (gap.mean() - 1e-3 * b)
        self.line = (float(a), float(b))
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.line[0] * self.raw(x) + self.line[1])))

    def column(self, features: list[Column]) -> Column:
        """The calibrated probability."""

        def of(tree):
            if isinstance(tree, float):
                return F.lit(tree)
            f, t, a, b = tree
            return F.when(features[f] < t, of(a)).otherwise(of(b))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + of(t)
        return 1 / (1 + F.exp(-(total * self.line[0] + self.line[1])))
