"""Gradient-boosted trees for a binary label, on binned features, with logistic loss."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of fixed depth, held as complete binary trees: feature and threshold per inner node, value per leaf."""

    def __init__(self, trees: int = 90, depth: int = 4, rate: float = 0.15, bins: int = 24, penalty: float = 1.0, least: float = 2.0, share: float = 0.5, seed: int = 3) -> None:
        self.trees, self.depth, self.rate, self.bins, self.penalty, self.least, self.share, self.seed = trees, depth, rate, bins, penalty, least, share, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
        inner = (1 << self.depth) - 1
        mean = y.mean().clip(1e-6, 1 - 1e-6)
        self.base = float(np.log(mean / (1 - mean)))
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.threshold = np.full((self.trees, inner), np.inf, np.float32)
        self.value = np.zeros((self.trees, inner + 1), np.float32)
        raw, rng = np.full(n, self.base), np.random.default_rng(self.seed)
        for t in range(self.trees):
            p = 1 / (1 + np.exp(-raw))
            # each tree sees a share of the rows and of the features
            rows = np.flatnonzero(rng.random(n) < self.share)
            seen, grad, hess = binned[rows], (y - p)[rows], (p * (1 - p))[rows]
            some = np.flatnonzero(rng.random(width) < self.share)
            node = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                first, many = (1 << level) - 1, 1 << level
                local, best, choice = node - first, np.zeros(many), [(0, -1)] * many
                for f in some:
                    if not len(cuts[f]):
                        continue
                    wide = len(cuts[f]) + 1
                    key = local * wide + seen[:, f]
                    g = np.bincount(key, grad, many * wide).reshape(many, wide).cumsum(1)
                    h = np.bincount(key, hess, many * wide).reshape(many, wide).cumsum(1)
                    left_g, left_h, all_g, all_h = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                    right_g, right_h = all_g - left_g, all_h - left_h
                    gain = left_g**2 / (left_h + self.penalty) + right_g**2 / (right_h + self.penalty) - all_g**2 / (all_h + self.penalty)
                    gain[(left_h < self.least) | (right_h < self.least)] = 0
                    cut = gain.argmax(1)
                    for k in np.flatnonzero(gain[np.arange(many), cut] > best + 1e-9):
                        best[k], choice[k] = gain[k, cut[k]], (f, int(cut[k]))
                go = np.zeros(len(rows), bool)
                for k, (f, cut) in enumerate(choice):
                    if cut >= 0:
                        self.feature[t, first + k], self.threshold[t, first + k] = f, cuts[f][cut]
                        mine = local == k
                        go[mine] = seen[mine, f] > cut
                node = 2 * node + 1 + go
            leaf = node - inner
            g, h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
            self.value[t] = self.rate * g / (h + self.penalty)
            raw += self._value(x, t)
        return self

    def _value(self, x: np.ndarray, t: int) -> np.ndarray:
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
        return self.value[t][node - self.feature.shape[1]]

    def decide(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row."""
        out = np.full(len(x), self.base)
        for t in range(self.trees):
            out += self._value(x, t)
        return out
