"""Gradient-boosted trees for binary labels in numpy: logistic loss, binned features, complete trees of fixed depth."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``scores`` gives calibrated probabilities; nodes of a tree are stored level by level."""

    def __init__(self, depth: int = 3, rounds: int = 40, rate: float = 0.3, bins: int = 32, ridge: float = 1.0):
        self.depth, self.rounds, self.rate, self.bins, self.ridge = depth, rounds, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.slope, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        mean = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        raw = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            raw += self._grow(binned, cuts, y - p, p * (1 - p))
        return self

    def _grow(self, binned, cuts, g, h) -> np.ndarray:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int64)
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = (1e-9, 0, np.inf, None)
            for j, c in enumerate(cuts):
                if not len(c) or not len(rows):
                    continue
                gs = np.bincount(binned[rows, j], g[rows], len(c) + 1).cumsum()
                hs = np.bincount(binned[rows, j], h[rows], len(c) + 1).cumsum()
                left, right = gs[:-1] ** 2 / (hs[:-1] + self.ridge), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.ridge)
                gain = left + right - gs[-1] ** 2 / (hs[-1] + self.ridge)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, c[k], k)
            feature[i], cut[i] = best[1], best[2]
            node[rows] = 2 * i + 1 + (binned[rows, best[1]] > best[3] if best[3] is not None else 0)
        leaf = node - inner
        value = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        self.trees.append((feature, cut, value))
        return value[leaf]

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
            out += value[node - len(feature)]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt scaling on rows that were not fitted, by Newton's method."""
        z, a, b = self.raw(x), 1.0, 0.0
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((p - y) * z).sum() + 1e-3 * (a - 1), (p - y).sum()])
            hess = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = float(a), float(b)
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(x) + self.shift, -30, 30)))
