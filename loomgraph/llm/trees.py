"""Gradient-boosted trees for two classes in numpy, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees in five parallel arrays.  A leaf points to itself, so scoring is `depth` vectorised steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.nan_to_num(np.asarray(x, float))
        if not len(x):
            return np.zeros(0)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            low = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(low, self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_forest(
    x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
    bins: int = 64, min_rows: int = 10, ridge: float = 1.0,
) -> Forest:
    """Fit log loss on x (rows by features) and y (0 or 1).

    monotone holds -1, 0 or 1 a feature: a split that breaks the wanted order of its two values is not taken, and
    the midpoint of the two values bounds all leaves below it, so the whole forest is monotonic in that feature.
    One class or no rows gives a forest without trees.
    """
    x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
    rate_of = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(rate_of / (1 - rate_of)))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
        margin = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            roots.append(_grow(nodes, code, edges, p - y, np.maximum(p * (1 - p), 1e-9), monotone, depth, rate, bins, min_rows, ridge, margin))
    flat = np.array(nodes, float).reshape(-1, 5)
    return Forest(
        np.array(roots, np.int64), flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 2].astype(np.int64),
        flat[:, 3].astype(np.int64), flat[:, 4], base, depth,
    )


def _grow(nodes, code, edges, grad, hess, monotone, depth, rate, bins, min_rows, ridge, margin) -> int:
    def leaf(value: float) -> int:
        nodes.append([0, 0.0, len(nodes), len(nodes), value])
        return len(nodes) - 1

    def best(g, h, lo, hi):
        return np.clip(-g / (h + ridge), lo, hi)

    def loss(g, h, v):
        return g * v + 0.5 * (h + ridge) * v * v

    def split(rows: np.ndarray, level: int, lo: float, hi: float) -> int:
        g, h = grad[rows].sum(), hess[rows].sum()
        own = best(g, h, lo, hi)
        found = None
        if level < depth and len(rows) >= 2 * min_rows:
            for f in range(code.shape[1]):
                if not len(edges[f]):
                    continue
                c = code[rows, f]
                gl = np.cumsum(np.bincount(c, grad[rows], bins))[: len(edges[f])]
                hl = np.cumsum(np.bincount(c, hess[rows], bins))[: len(edges[f])]
                nl = np.cumsum(np.bincount(c, minlength=bins))[: len(edges[f])]
                vl, vr = best(gl, hl, lo, hi), best(g - gl, h - hl, lo, hi)
                gain = loss(g, h, own) - loss(gl, hl, vl) - loss(g - gl, h - hl, vr)
                bad = (nl < min_rows) | (len(rows) - nl < min_rows) | ((vr - vl) * monotone[f] < 0)
                gain[bad] = -1
                at = int(gain.argmax())
                if gain[at] > 1e-6 and (found is None or gain[at] > found[0]):
                    found = (gain[at], f, at, vl[at], vr[at])
        if found is None:
            margin[rows] += rate * own
            return leaf(rate * own)
        _, f, at, vl, vr = found
        me = len(nodes)
        nodes.append([f, edges[f][at], 0, 0, 0.0])
        low = code[rows, f] <= at
        mid, m = (vl + vr) / 2, monotone[f]
        nodes[me][2] = split(rows[low], level + 1, max(lo, mid) if m < 0 else lo, min(hi, mid) if m > 0 else hi)
        nodes[me][3] = split(rows[~low], level + 1, max(lo, mid) if m > 0 else lo, min(hi, mid) if m < 0 else hi)
        return me

    return split(np.arange(len(grad)), 0, -np.inf, np.inf)
