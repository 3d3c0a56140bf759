"""A small gradient-boosted tree classifier with calibrated scores, in numpy; it is fitted on bounded samples only."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Regression trees of a fixed depth on logistic loss; `calibration` maps margins to probabilities (Platt)."""

    def __init__(self, trees: list, rate: float, bias: float, calibration: tuple[float, float] = (1.0, 0.0)):
        self.trees, self.rate, self.bias, self.calibration = trees, rate, bias, calibration

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> Boosted:
        """Second-order boosting; cuts between distinct values of each feature."""
        cuts = [((u := np.unique(x[:, j]))[1:] + u[:-1]) / 2 for j in range(x.shape[1])]
        cuts = [c if len(c) <= 32 else np.quantile(c, np.linspace(0, 1, 32)) for c in cuts]
        bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        margin, trees = np.full(len(y), bias), []

        def grow(at: np.ndarray, level: int, g: np.ndarray, h: np.ndarray):
            leaf = float(g[at].sum() / (h[at].sum() + 1.0))
            if level == 0 or len(at) < 2 * least:
                return leaf
            score, best = 1e-6, None
            total, weight = g[at].sum(), h[at].sum()
            for j, c in enumerate(cuts):
                for t in c:
                    left = x[at, j] <= t
                    n = left.sum()
                    if n < least or len(at) - n < least:
                        continue
                    a, b = g[at][left].sum(), h[at][left].sum()
                    gain = a * a / (b + 1) + (total - a) ** 2 / (weight - b + 1) - total * total / (weight + 1)
                    if gain > score:
                        score, best = gain, (j, float(t), left)
            if best is None:
                return leaf
            j, t, left = best
            return j, t, grow(at[left], level - 1, g, h), grow(at[~left], level - 1, g, h)

        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            tree = grow(np.arange(len(y)), depth, y - p, p * (1 - p))
            trees.append(tree)
            margin += rate * cls._apply(tree, x)
        return cls(trees, rate, bias)

    @staticmethod
    def _apply(tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, t, a, b = tree
        return np.where(x[:, j] <= t, Boosted._apply(a, x), Boosted._apply(b, x))

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + self.rate * sum((self._apply(t, x) for t in self.trees), np.zeros(len(x)))

    def calibrated(self, x: np.ndarray, y: np.ndarray, rounds: int = 50) -> Boosted:
        """Platt's sigmoid on rows that were not fitted, by Newton steps with smoothed targets."""
        m, n1 = self.margin(x), y.sum()
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
        a, b = 1.0, 0.0
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(a * m + b)))
            g, w = target - p, p * (1 - p) + 1e-9
            hess = np.array([[(w * m * m).sum() + 1e-6, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-6]])
            step = np.linalg.solve(hess, np.array([(g * m).sum(), g.sum()]))
            a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
        return Boosted(self.trees, self.rate, self.bias, (a, b))

    def probability(self, x: np.ndarray) -> np.ndarray:
        a, b = self.calibration
        return 1 / (1 + np.exp(-(a * self.margin(x) + b)))
