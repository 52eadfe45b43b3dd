"""Gradient-boosted trees with logistic loss, fitted on a small table and applied as one SQL expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class BoostedTrees:
    """Trees are nested tuples (feature, threshold, left, right); leaves are numbers."""

    def __init__(self, features: Sequence[str], base: float, trees: list) -> None:
        self.features, self.base, self.trees = list(features), base, trees

    @classmethod
    def fit(cls, features: Sequence[str], x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, least: int = 8) -> BoostedTrees:
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        base = math.log(p / (1 - p))
        z, trees = np.full(len(y), base), []
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, 25))) for f in range(x.shape[1])]

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
            total, weight = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if left:
                for f, cuts in enumerate(edges):
                    for cut in cuts:
                        low = x[rows, f] <= cut
                        n = int(low.sum())
                        if least <= n <= len(rows) - least:
                            a, b = g[rows][low].sum(), h[rows][low].sum()
                            gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                            best = max(best, (gain, (f, float(cut))), key=lambda t: t[0])
            if best[1] is None:
                return float(rate * total / (weight + 1))
            f, cut = best[1]
            low = x[rows, f] <= cut
            return (f, cut, grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

        for _ in range(rounds):
            s = 1 / (1 + np.exp(-z))
            tree = grow(np.arange(len(y)), y - s, s * (1 - s), depth)
            if not isinstance(tree, tuple):
                break
            trees.append(tree)
            z = z + np.array([cls._leaf(tree, row) for row in x])
        return cls(features, base, trees)

    @staticmethod
    def _leaf(tree, row: np.ndarray) -> float:
        while isinstance(tree, tuple):
            f, cut, low, high = tree
            tree = low if row[f] <= cut else high
        return tree

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.array([1 / (1 + math.exp(-self.base - sum(self._leaf(t, row) for t in self.trees))) for row in x])

    def column(self, row: Column) -> Column:
        """The score of a struct that has a field for each feature."""

        def branch(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, cut, low, high = tree
            return F.when(row[self.features[f]] <= F.lit(cut), branch(low)).otherwise(branch(high))

        total = F.lit(self.base)
        for tree in self.trees:
            total = total + branch(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
