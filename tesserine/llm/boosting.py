"""Gradient-boosted trees for two classes, trained and applied with numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss, trees of fixed depth over binned features."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, least: int = 4, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.model: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Fit to features ``x`` and labels 0/1 ``y``."""
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            cuts = (values[1:] + values[:-1]) / 2
            self.edges.append(cuts if len(cuts) < self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])))
        b = self._binned(x)
        share = np.clip(y.mean(), 0.01, 0.99)
        self.base = float(np.log(share / (1 - share)))
        z = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-z))
            feature, cut, leaf, place = self._tree(b, p - y, p * (1 - p))
            self.model.append((feature, cut, leaf))
            z += leaf[place]
        return self

    def _tree(self, b, g, h):
        nodes = 2**self.depth - 1
        feature, cut = np.zeros(nodes, dtype=np.int64), np.full(nodes, 10**6)
        place = np.zeros(len(g), dtype=np.int64)
        width = max(len(e) for e in self.edges) + 1
        for level in range(self.depth):
            first, n = 2**level - 1, 2**level
            local = place - first
            best = np.full(n, 1e-6)
            for j in range(b.shape[1]):
                key = local * width + b[:, j]
                sg = np.bincount(key, weights=g, minlength=n * width).reshape(n, width)
                sh = np.bincount(key, weights=h, minlength=n * width).reshape(n, width)
                sc = np.bincount(key, minlength=n * width).reshape(n, width)
                lg, lh, lc = sg.cumsum(1), sh.cumsum(1), sc.cumsum(1)
                tg, th, tc = lg[:, -1:], lh[:, -1:], lc[:, -1:]
                gain = lg**2 / (lh + self.ridge) + (tg - lg) ** 2 / (th - lh + self.ridge) - tg**2 / (th + self.ridge)
                gain[(lc < self.least) | (tc - lc < self.least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(n), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + n][better] = j
                cut[first : first + n][better] = at[better]
            place = 2 * place + 1 + (b[np.arange(len(b)), feature[place]] > cut[place])
        place -= nodes
        leaves = nodes + 1
        leaf = -self.rate * np.bincount(place, weights=g, minlength=leaves) / (np.bincount(place, weights=h, minlength=leaves) + self.ridge)
        return feature, cut, leaf, place

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1."""
        b = self._binned(x)
        z = np.full(len(x), self.base)
        nodes = 2**self.depth - 1
        rows = np.arange(len(x))
        for feature, cut, leaf in self.model:
            place = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                place = 2 * place + 1 + (b[rows, feature[place]] > cut[place])
            z += leaf[place - nodes]
        return z
