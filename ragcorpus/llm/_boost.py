"""Boosted trees and isotonic calibration for the two classifiers, fitted on a bounded sample of rows."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Gradient-boosted trees of one fixed depth under logistic loss, split on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rows, width = x.shape
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(width)]
        # features that are zero almost everywhere still get a bin of their own above zero
        edges = [np.unique(np.concatenate([e, [v.min(initial=0), *np.quantile(v, [0.25, 0.5, 0.75])] if len(v := x[x[:, f] > 0, f]) else []]) - 1e-12) for f, e in enumerate(edges)]
        most = max(len(e) for e in edges) + 1
        code = np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)], axis=1)
        cell = code + most * np.arange(width)
        self.base = float(np.log((y.sum() + 0.5) / (rows - y.sum() + 0.5)))
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(rows, self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, value, node = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(rows, int)
            for level in range(self.depth):
                for k in range(2**level):
                    at, own = 2**level - 1 + k, np.flatnonzero(node == k)
                    if len(own) < 2:
                        continue
                    flat = cell[own].ravel()
                    gs = np.bincount(flat, np.repeat(g[own], width), most * width).reshape(width, most).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[own], width), most * width).reshape(width, most).cumsum(axis=1)
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.l2) + gr**2 / (hr + self.l2) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.l2)
                    for f, e in enumerate(edges):
                        gain[f, len(e) :] = 0
                    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    if gain[f, b] > 1e-6:
                        feature[at], value[at] = f, edges[f][b]
                node = 2 * node + (x[np.arange(rows), feature[2**level - 1 + node]] >= value[2**level - 1 + node])
            leaf = -self.rate * np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + self.l2)
            self.forest.append((feature, value, leaf))
            margin += leaf[node]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, value, leaf in self.forest:
            node = np.zeros(len(x), int)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = 2 * node + (x[rows, feature[at]] >= value[at])
            out += leaf[node]
        return out


class Isotonic:
    """The non-decreasing step function nearest to the labels (pool adjacent violators), read by interpolation."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # mean, weight, lowest and highest score
        for s, label in zip(score[order].tolist(), y[order].tolist(), strict=True):
            blocks.append([label, 1.0, s, s])
            while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
                mean, weight, _, high = blocks.pop()
                low = blocks[-1]
                low[0] = (low[0] * low[1] + mean * weight) / (low[1] + weight)
                low[1] += weight
                low[3] = high
        # one half of a row of either class in each block keeps small blocks from claiming certainty
        self.at = np.array([v for b in blocks for v in ((b[2],) if b[2] == b[3] else (b[2], b[3]))])
        means = [(b[0] * b[1] + 0.5 * y.mean()) / (b[1] + 0.5) for b in blocks]
        means = np.maximum.accumulate(means)
        self.value = np.array([m for m, b in zip(means, blocks, strict=True) for _ in range(1 if b[2] == b[3] else 2)])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)


class Calibrated:
    """Two boosted models, each fitted on one half; the calibration sees each row by the model that has not."""

    def fit(self, x: np.ndarray, y: np.ndarray, half: np.ndarray, **settings: float) -> Calibrated:
        whole = len(np.unique(y[half == 0])) < 2 or len(np.unique(y[half == 1])) < 2
        self.models = [Boosted(**settings).fit(x, y)] if whole else [Boosted(**settings).fit(x[half == k], y[half == k]) for k in (0, 1)]
        margin = self.models[0].margin(x) if whole else np.where(half == 0, self.models[1].margin(x), self.models[0].margin(x))
        self.isotonic = Isotonic().fit(margin, y)
        return self

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Scores in 0 .. 1; a thousandth is the plain probability, so that the steps keep the order within."""
        if not len(x):
            return np.zeros(0)
        margin = np.mean([m.margin(x) for m in self.models], axis=0)
        return np.clip(0.999 * self.isotonic(margin) + 0.001 / (1 + np.exp(-margin)), 0, 1)
