"""Small boosted trees: fitted on the driver from a bounded labelled sample, applied as a column expression."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Tree = tuple  # (feature, threshold, low, high) or (leaf,)


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> list[Tree]:
    """Newton boosting of the logistic loss with exact splits; rows are a bounded sample."""
    score, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        tree = _grow(x, g, h, np.arange(len(y)), depth, rate, ridge)
        score += _apply(tree, x)
        out.append(tree)
    return out


def _grow(x, g, h, at, depth, rate, ridge) -> Tree:
    leaf = (float(-rate * g[at].sum() / (h[at].sum() + ridge)),)
    if depth == 0 or len(at) < 8:
        return leaf
    best = (1e-6, None, None)
    whole = g[at].sum() ** 2 / (h[at].sum() + ridge)
    for f in range(x.shape[1]):
        v = x[at, f]
        order = np.argsort(v, kind="stable")
        cuts = np.nonzero(np.diff(v[order]))[0]
        if not len(cuts):
            continue
        gl, hl = np.cumsum(g[at][order])[cuts], np.cumsum(h[at][order])[cuts]
        gr, hr = g[at].sum() - gl, h[at].sum() - hl
        gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - whole
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, float((v[order][cuts[k]] + v[order][cuts[k] + 1]) / 2))
    if best[1] is None:
        return leaf
    low = x[at, best[1]] <= best[2]
    return (best[1], best[2], _grow(x, g, h, at[low], depth - 1, rate, ridge), _grow(x, g, h, at[~low], depth - 1, rate, ridge))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _apply(tree[2], x), _apply(tree[3], x))


def predict(trees: Sequence[Tree], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-sum(_apply(t, x) for t in trees)))


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the held-out precision is at least ``precision``; over 1 if none is."""
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    # a threshold takes all rows of equal score
    last = np.append(np.diff(p[order]) != 0, True)
    good = np.nonzero((right >= precision) & last)[0]
    return float(p[order][good[-1]]) if len(good) else 2.0


def logit(p: float) -> float:
    """The margin of a threshold, with room for the rounding of a sum."""
    return math.inf if p >= 1 else math.log(p / (1 - p)) - 1e-6


def column(trees: Sequence[Tree], features: Sequence[Column]) -> Column:
    """The summed margin of all trees over feature columns."""

    def of(t: Tree) -> Column:
        if len(t) == 1:
            return F.lit(t[0])
        return F.when(features[t[0]] <= F.lit(t[1]), of(t[2])).otherwise(of(t[3]))

    total = F.lit(0.0)
    for t in trees:
        total = total + of(t)
    return total
