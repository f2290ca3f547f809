"""Gradient-boosted trees for a yes/no label over numeric features, fitted with histograms."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    def __init__(self, edges: list[np.ndarray], trees: list, base: float):
        self.edges, self.trees, self.base = edges, trees, base

    @staticmethod
    def _bin(edges: list[np.ndarray], x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, l2: float = 1.0) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = cls._bin(edges, x)
        width = bins + 1
        flat = b + np.arange(b.shape[1]) * width
        rate_yes = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        base = float(np.log(rate_yes / (1 - rate_yes)))
        f, out = np.full(len(y), base), []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (y - p), weight * p * (1 - p)
            node, feature, cut = np.zeros(len(y), np.int64), np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, width, np.int64)
            for level in range(depth):
                first, n = (1 << level) - 1, 1 << level
                key = ((node * b.shape[1] * width)[:, None] + flat).ravel()
                size = n * b.shape[1] * width
                gs = np.bincount(key, np.repeat(g, b.shape[1]), size).reshape(n, b.shape[1], width).cumsum(2)
                hs = np.bincount(key, np.repeat(h, b.shape[1]), size).reshape(n, b.shape[1], width).cumsum(2)
                ga, ha = gs[:, :, -1:], hs[:, :, -1:]
                gain = gs ** 2 / (hs + l2) + (ga - gs) ** 2 / (ha - hs + l2) - ga ** 2 / (ha + l2)
                gain[(hs < 0.5) | (ha - hs < 0.5)] = 0
                best = gain.reshape(n, -1).argmax(1)
                some = gain.reshape(n, -1)[np.arange(n), best] > 1e-6
                feature[first:first + n] = best // width
                cut[first:first + n] = np.where(some, best % width, width)
                node = node * 2 + (b[np.arange(len(b)), feature[first + node]] > cut[first + node])
            gs, hs = np.bincount(node, g, 1 << depth), np.bincount(node, h, 1 << depth)
            leaf = rate * gs / (hs + l2)
            f = f + leaf[node]
            out.append((feature, cut, leaf))
        return cls(edges, out, base)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, rows = self._bin(self.edges, x), np.arange(len(x))
        f = np.full(len(x), self.base)
        for feature, cut, leaf in self.trees:
            node, first = np.zeros(len(x), np.int64), 0
            while first < len(feature):
                at = first + node
                node = node * 2 + (b[rows, feature[at]] > cut[at])
                first = first * 2 + 1
            f += leaf[node]
        return f
