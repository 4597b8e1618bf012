"""A random forest of Gini trees in numpy, for small sets of labelled rows."""

from __future__ import annotations

import numpy as np


class Tree:
    """Flat arrays: feature (-1 at a leaf), threshold, the two children, share of label 1."""

    def __init__(self, x: np.ndarray, y: np.ndarray, draw: np.random.Generator, depth: int, least: int, tried: int):
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.low: list[int] = []
        self.high: list[int] = []
        self.share: list[float] = []
        self._grow(x, y, draw, depth, least, tried)
        self.feature, self.low, self.high = (np.array(v, np.int64) for v in (self.feature, self.low, self.high))
        self.threshold, self.share = np.array(self.threshold), np.array(self.share)

    def _grow(self, x, y, draw, depth, least, tried) -> int:
        at = len(self.feature)
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.low.append(at)
        self.high.append(at)
        self.share.append(float(y.mean()))
        if depth == 0 or len(y) < 2 * least or y.min() == y.max():
            return at
        best = (1e-12, -1, 0.0)
        own = y.mean() * (1 - y.mean())
        for f in draw.permutation(x.shape[1])[:tried]:
            order = np.argsort(x[:, f], kind="stable")
            v, s = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            cut = cut[(cut + 1 >= least) & (len(y) - cut - 1 >= least)]
            if not len(cut):
                continue
            a, b = s[cut] / n[cut], (s[-1] - s[cut]) / (len(y) - n[cut])
            gain = own - (n[cut] * a * (1 - a) + (len(y) - n[cut]) * b * (1 - b)) / len(y)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] < 0:
            return at
        go = x[:, best[1]] <= best[2]
        self.feature[at], self.threshold[at] = best[1], best[2]
        self.low[at] = self._grow(x[go], y[go], draw, depth - 1, least, tried)
        self.high[at] = self._grow(x[~go], y[~go], draw, depth - 1, least, tried)
        return at

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            f = self.feature[at]
            inner = np.flatnonzero(f >= 0)
            if not len(inner):
                return self.share[at]
            low = x[inner, f[inner]] <= self.threshold[at[inner]]
            at[inner] = np.where(low, self.low[at[inner]], self.high[at[inner]])


class Forest:
    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 31, depth: int = 8, least: int = 3, seed: int = 11):
        draw = np.random.default_rng(seed)
        tried = max(1, round(np.sqrt(x.shape[1]) * 1.5))
        rows = [draw.integers(0, len(y), len(y)) for _ in range(trees)]
        self.trees = [Tree(x[r], y[r].astype(float), draw, depth, least, tried) for r in rows]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t(x) for t in self.trees], axis=0) if len(x) else np.empty(0)
