"""Gradient-boosted regression trees for a yes/no label, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass
class Tree:
    """A full binary tree of fixed depth: feature and threshold of each inner node, value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        inner = len(self.feature)
        while len(x) and node[0] < inner:
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - inner]


class Boosting:
    """Newton boosting of the logistic loss on quantile bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: float = 1.0, bins: int = 32):
        self.rounds, self.depth, self.rate, self.least, self.bins = rounds, depth, rate, least, bins
        self.trees: list[Tree] = []
        self.prior = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.prior = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
        margin = np.full(len(y), self.prior)
        for _ in range(self.rounds):
            p = _sigmoid(margin)
            tree = self._grow(code, cuts, y - p, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            margin += self.rate * tree(x)
        return self

    def _grow(self, code, cuts, gradient, weight) -> Tree:
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        node = np.zeros(len(code), dtype=np.int64)
        for n in range(inner):
            mine = np.flatnonzero(node == n)
            best = 1e-9
            g, h = gradient[mine], weight[mine]
            for f, c in enumerate(cuts):
                if len(mine) < 2 or not len(c):
                    continue
                gs = np.bincount(code[mine, f], g, len(c) + 1).cumsum()[:-1]
                hs = np.bincount(code[mine, f], h, len(c) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + self.least) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.least) - g.sum() ** 2 / (h.sum() + self.least)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[n], threshold[n] = gain[k], f, c[k]
            split = cuts[feature[n]]
            cut = np.searchsorted(split, threshold[n], "left") if np.isfinite(threshold[n]) else len(split) + 1
            node[mine] = 2 * n + 1 + (code[mine, feature[n]] > cut)
        leaf = node - inner
        g = np.bincount(leaf, gradient, inner + 1)
        h = np.bincount(leaf, weight, inner + 1)
        return Tree(feature, threshold, g / (h + self.least))

    def probability(self, x: np.ndarray) -> np.ndarray:
        margin = np.full(len(x), self.prior)
        for tree in self.trees:
            margin += self.rate * tree(x)
        return _sigmoid(margin)
