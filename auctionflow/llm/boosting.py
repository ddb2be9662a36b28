"""Gradient-boosted trees and isotonic calibration in numpy, for dense features of bounded samples."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: (centre of each block, its mean label), both increasing."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, weight, sum of scores
    for s, y in zip(score[order].tolist(), label[order].tolist()):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y1, w1, s1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y1, blocks[-1][1] + w1, blocks[-1][2] + s1]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


@dataclass
class Trees:
    """Complete binary trees of one depth, each level of a tree as arrays of (feature, threshold)."""

    depth: int = 4
    rounds: int = 80
    rate: float = 0.15
    bins: int = 48
    penalty: float = 1.0
    least: float = 1.0
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, m = x.shape
        share = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base, self.trees = float(np.log(share / (1 - share))), []
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)], axis=1) if m else np.zeros((n, 0), int)
        width = self.bins + 1
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            features, limits = np.full((1 << self.depth) - 1, -1), np.full((1 << self.depth) - 1, np.inf)
            for level in range(self.depth):
                first, count = (1 << level) - 1, 1 << level
                best, where, cut = np.full(count, 1e-6), np.full(count, -1), np.zeros(count, np.int64)
                for j in range(m):
                    place = node * width + binned[:, j]
                    gs = np.cumsum(np.bincount(place, g, count * width).reshape(count, width), axis=1)
                    hs = np.cumsum(np.bincount(place, h, count * width).reshape(count, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.penalty) + (gt - gs) ** 2 / (ht - hs + self.penalty) - gt**2 / (ht + self.penalty)
                    gain[(hs < self.least) | (ht - hs < self.least)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    at = gain.argmax(axis=1)
                    top = gain[np.arange(count), at]
                    better = top > best
                    best[better], where[better], cut[better] = top[better], j, at[better]
                for k in range(count):
                    if where[k] >= 0:
                        features[first + k], limits[first + k] = where[k], cuts[where[k]][cut[k]]
                f = where[node]
                right = (f >= 0) & (binned[np.arange(n), np.maximum(f, 0)] > cut[node])
                node = node * 2 + right
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.penalty)
            margin += value[node]
            self.trees.append((features, limits, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, limits, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                f = features[at]
                node = node * 2 + ((f >= 0) & (x[rows, np.maximum(f, 0)] >= limits[at]))
            out += value[node]
        return out
