"""Gradient-boosted trees of fixed depth on binned features, for the log loss, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # trees x inner nodes
    border: np.ndarray  # go right if the value is over it
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = int(np.log2(self.leaf.shape[1]))
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for feature, border, leaf in zip(self.feature, self.border, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > border[at])
            out += leaf[at - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.score(x), -30, 30)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> Trees:
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1], method="nearest")) for j in range(k)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    out = Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), float(np.log(p / (1 - p))))
    z = np.full(n, out.start)
    offset = np.arange(k) * bins
    for t in range(trees):
        q = 1 / (1 + np.exp(-z))
        g, h = y - q, q * (1 - q)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            base, width = 2**level - 1, 2**level
            flat = ((at - base)[:, None] * (k * bins) + offset + binned).ravel()
            gs = np.bincount(flat, np.repeat(g, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            hs = np.bincount(flat, np.repeat(h, k), width * k * bins).reshape(width, k, bins).cumsum(2)
            g_all, h_all = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + penalty) + (g_all - gs) ** 2 / (h_all - hs + penalty) - g_all**2 / (h_all + penalty)
            for j, e in enumerate(edges):
                gain[:, j, len(e) :] = 0
            best = gain.reshape(width, -1).argmax(1)
            for node in range(width):
                j, b = divmod(int(best[node]), bins)
                if gain[node, j, b] > 1e-6:
                    out.feature[t, base + node], out.border[t, base + node] = j, edges[j][b]
            at = 2 * at + 1 + (x[np.arange(n), out.feature[t, at]] > out.border[t, at])
        leaf = at - (2**depth - 1)
        value = np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + penalty)
        out.leaf[t] = rate * value
        z += out.leaf[t][leaf]
    return out
