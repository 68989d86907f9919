"""Gradient-boosted trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Tree:
    """Nodes as arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray, depth: int) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            f = self.feature[at]
            inner = f >= 0
            right = x[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(inner, self.left[at] + right, at)
        return self.value[at]


@dataclass
class Boosted:
    """A sum of trees; ``margin`` is the log odds."""

    depth: int
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t.predict(x, self.depth)
        return out


def _grow(codes: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> Tree:
    feature, cut, left, value = [-1], [0.0], [0], [0.0]
    level = [(0, np.arange(len(g)))]
    for d in range(depth + 1):
        after = []
        for node, rows in level:
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = -gs / (hs + ridge)
            if d == depth or hs < 2 * least:
                continue
            best = (1e-3, -1, 0)
            for f in range(codes.shape[1]):
                c = codes[rows, f]
                gl, hl = np.cumsum(np.bincount(c, g[rows], BINS))[:-1], np.cumsum(np.bincount(c, h[rows], BINS))[:-1]
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(hl < least) | (hs - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0] and k < len(cuts[f]):
                    best = (float(gain[k]), f, k)
            if best[1] < 0:
                continue
            _, f, k = best
            goes = codes[rows, f] > k
            feature[node], cut[node], left[node] = f, float(cuts[f][k]), len(feature)
            for part in (rows[~goes], rows[goes]):
                after.append((len(feature), part))
                feature.append(-1)
                cut.append(0.0)
                left.append(0)
                value.append(0.0)
        level = after
    return Tree(np.array(feature), np.array(cut), np.array(left), np.array(value))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0) -> Boosted:
    """Fit on features ``x``, labels 0/1 and weights by Newton boosting of the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    p = (weight * y).sum() / weight.sum()
    model = Boosted(depth, float(np.log(p / (1 - p))))
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-margin))
        tree = _grow(codes, cuts, weight * (q - y), weight * q * (1 - q), depth, ridge, least)
        tree.value *= rate
        margin += tree.predict(x, depth)
        model.trees.append(tree)
    return model
