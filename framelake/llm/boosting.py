"""Gradient-boosted trees for a binary label, on histograms of numpy columns."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Trees of fixed depth fitted to the logistic loss; inputs are binned by quantiles."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 0.02, ridge: float = 0.3):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.edges: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int32) if len(self.edges) else np.zeros((len(x), 0), np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges, self.nodes = [], []
        if not len(y):
            return self
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = float(np.log(share / (1 - share)))
        if share <= 1e-4 or share >= 1 - 1e-4:
            return self
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            if len(values) > self.bins:
                values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)))
            self.edges.append((values[:-1] + values[1:]) / 2)
        # rows that are alike once binned share one place, with their number and their sum of labels
        b, place = _distinct(self._binned(x))
        n, m = b.shape
        weight, hits = np.bincount(place, minlength=n).astype(float), np.bincount(place, y, n)
        width = max(len(e) for e in self.edges) + 1
        score = np.full(n, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * p - hits, weight * p * (1 - p)
            feature = np.zeros(2**self.depth - 1, np.int32)
            cut = np.full(2**self.depth - 1, width, np.int32)
            at = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = at - first
                gain = np.zeros((count, m))
                where = np.zeros((count, m), np.int32)
                for j in range(m):
                    cell = local * width + b[:, j]
                    gs = np.bincount(cell, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(cell, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    ok = (hs >= self.least) & (ht - hs >= self.least)
                    value = np.where(ok, gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge), 0)
                    where[:, j] = value.argmax(1)
                    gain[:, j] = value.max(1)
                best = gain.argmax(1)
                nodes = np.arange(count)
                use = gain[nodes, best] > 1e-6
                feature[first : first + count] = best
                cut[first : first + count] = np.where(use, where[nodes, best], width)
                at = 2 * at + 1 + (b[np.arange(n), feature[at]] > cut[at])
            leaf = at - (2**self.depth - 1)
            gs, hs = np.bincount(leaf, g, 2**self.depth), np.bincount(leaf, h, 2**self.depth)
            out = -self.rate * gs / (hs + self.ridge)
            self.nodes.append((feature, cut, out))
            score += out[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x) or not self.nodes:
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        b, place = _distinct(self._binned(x))
        score = np.full(len(b), self.base)
        rows = np.arange(len(b))
        for feature, cut, out in self.nodes:
            at = np.zeros(len(b), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            score += out[at - (2**self.depth - 1)]
        return (1 / (1 + np.exp(-score)))[place]


def _distinct(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and the place of each row among them."""
    if not b.shape[1]:
        return b[:1], np.zeros(len(b), np.int64)
    whole = np.ascontiguousarray(b.astype(np.uint8 if b.max(initial=0) < 256 else b.dtype))
    _, first, place = np.unique(whole.view(np.dtype((np.void, whole.dtype.itemsize * whole.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return b[first], place
