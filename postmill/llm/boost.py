"""Gradient-boosted trees for two classes, in numpy; small models trained on the driver in seconds."""

from __future__ import annotations

import numpy as np


class Boost:
    """Logistic boosting of shallow trees over quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        x, y = np.asarray(x, float), np.asarray(y, float)
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)])
        p = y.mean()
        self.start = float(np.log(p / (1 - p)))
        score = np.full(n, self.start)
        size = 2**self.depth
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-score))
            g, h = y - prob, prob * (1 - prob)
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(2 * size)
            node = np.ones(n, int)
            for level in range(self.depth):
                for k in range(2**level, 2 ** (level + 1)):
                    at = np.flatnonzero(node == k)
                    if len(at) < 2:
                        continue
                    total_g, total_h, best, pick = g[at].sum(), h[at].sum(), 1e-6, None
                    for j in range(m):
                        if not len(cuts[j]):
                            continue
                        b = binned[at, j]
                        left_g = np.bincount(b, g[at], len(cuts[j]) + 1).cumsum()[:-1]
                        left_h = np.bincount(b, h[at], len(cuts[j]) + 1).cumsum()[:-1]
                        gain = left_g**2 / (left_h + self.l2) + (total_g - left_g) ** 2 / (total_h - left_h + self.l2) - total_g**2 / (total_h + self.l2)
                        q = int(gain.argmax())
                        if gain[q] > best:
                            best, pick = gain[q], (j, cuts[j][q])
                    if pick:
                        feature[k], cut[k] = pick
                move = feature[node] >= 0
                right = np.zeros(n, bool)
                right[move] = x[np.flatnonzero(move), feature[node[move]]] >= cut[node[move]]
                node = 2 * node + right
            for k in np.unique(node):
                at = node == k
                value[k] = self.rate * g[at].sum() / (h[at].sum() + self.l2)
            self.model.append((feature, cut, value))
            score += value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the second class for each row."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.start)
        columns = np.ascontiguousarray(x.T)
        sides: dict[tuple[int, float], np.ndarray] = {}

        def below(tree: tuple, k: int, level: int):
            """Values under node k, for all rows at once: a column is compared once with each cut."""
            feature, cut, value = tree
            if level == self.depth:
                return value[k]
            f = int(feature[k])
            if f < 0:
                return below(tree, 2 * k, level + 1)
            side = (f, float(cut[k]))
            if side not in sides:
                sides[side] = columns[f] >= cut[k]
            return np.where(sides[side], below(tree, 2 * k + 1, level + 1), below(tree, 2 * k, level + 1))

        for tree in self.model:
            score += below(tree, 1, 0)
        return 1 / (1 + np.exp(-score))
