"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Node arrays of all trees, one after another; a leaf has itself as both children."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row: all rows go down all trees together, one level a step."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.bias)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.bias + self.value[node].sum(axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Forest:
    """Logistic boosting on quantile bins. monotone: feature -> 1 if the output may only rise with it, -1 only fall.

    A split on such a feature needs its children's values in that order, and their midpoint bounds all values below
    each child, so that the whole tree keeps the order. Without rows the forest is a constant 0.5.
    """
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    bias = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))) if len(y) else 0.0
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(x.shape[1])]
    code = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]) if len(x) else np.zeros((0, x.shape[1]), int)
    margin = np.full(len(y), bias)

    def leaf(v: float) -> int:
        at = len(value)
        feature.append(0), threshold.append(0.0), left.append(at), right.append(at), value.append(v)
        return at

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        best_value = lambda a, b: np.clip(-a / (b + ridge), low, high)
        G, H = g[rows].sum(), h[rows].sum()
        own = float(best_value(G, H))
        loss = lambda a, b, v: a * v + 0.5 * (b + ridge) * v * v
        best = (-1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                c = code[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(c, weights=v, minlength=len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                vl, vr = best_value(gl, hl), best_value(G - gl, H - hl)
                gain = loss(gl, hl, vl) + loss(G - gl, H - hl, vr) - loss(G, H, own)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if monotone.get(f):
                    ok &= monotone[f] * (vr - vl) >= 0
                if ok.any():
                    k = int(np.where(ok, gain, 0).argmin())
                    if ok[k] and gain[k] < best[0]:
                        best = gain[k], (f, k, float(vl[k]), float(vr[k]))
        if best[1] is None:
            return leaf(own * rate)
        f, k, vl, vr = best[1]
        at = leaf(0.0)
        middle, sign = (vl + vr) / 2, monotone.get(f, 0)
        below = code[rows, f] <= k
        a = grow(rows[below], g, h, level + 1, middle if sign < 0 else low, middle if sign > 0 else high)
        b = grow(rows[~below], g, h, level + 1, middle if sign > 0 else low, middle if sign < 0 else high)
        feature[at], threshold[at], left[at], right[at] = f, float(edges[f][k]), a, b
        return at

    for _ in range(trees if len(y) and 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-margin))
        first = len(value)
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -4.0, 4.0))
        one = Forest(*(np.array(v) for v in (feature, threshold, left, right, value)), np.array([first]), depth, 0.0)
        margin = margin + one.margin(x)
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), depth, bias)
