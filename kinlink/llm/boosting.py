"""Boosted trees for two classes, small and plain, and a calibration of their scores."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class BoostedTrees:
    """Gradient boosting of the logistic loss with trees of a fixed depth and Newton leaves."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base = 0.0
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, float), np.asarray(y, float)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = _sigmoid(score)
            self.nodes.append(self._grow(codes, cuts, y - p, p * (1 - p)))
            score += self._apply(x, *self.nodes[-1])
        return self

    def _grow(self, codes, cuts, g, h):
        inner = 2**self.depth - 1
        feature, cut, at = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(g), int)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            best, pick = 1e-6, None
            if len(rows) > 1:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + self.ridge)
                for j, c in enumerate(cuts):
                    if len(c):
                        gs = np.bincount(codes[rows, j], g[rows], len(c) + 1).cumsum()
                        hs = np.bincount(codes[rows, j], h[rows], len(c) + 1).cumsum()
                        gain = gs[:-1] ** 2 / (hs[:-1] + self.ridge) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + self.ridge) - whole
                        k = int(gain.argmax())
                        if gain[k] > best:
                            best, pick = gain[k], (j, k)
            right = np.zeros(len(rows), bool)
            if pick:
                feature[node], cut[node] = pick[0], cuts[pick[0]][pick[1]]
                right = codes[rows, pick[0]] > pick[1]
            at[rows] = 2 * node + 1 + right
        leaf = at - inner
        n = 2**self.depth
        value = self.rate * np.bincount(leaf, g, n) / (np.bincount(leaf, h, n) + self.ridge)
        return feature, cut, value

    def _apply(self, x, feature, cut, value):
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        return value[at - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return self.base + sum((self._apply(x, *t) for t in self.nodes), np.zeros(len(x)))


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """a, b so that sigmoid(a * score + b) is the chance of class 1, by Newton's method."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([score, np.ones(len(score))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(hess, x.T @ (p - target))
    return float(w[0]), float(w[1])


def precise_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least chance from which on at least ``precision`` of the cases are of class 1; 1.01 if there is none."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.append(p[order][1:] != p[order][:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return float(p[order][good[-1]]) if len(good) else 1.01
