"""Low-dimensional layouts of a bounded sample on the driver, and colours of all rows from them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import color, vec
from ..sources.shared import remove, written
from ..sources.tables import to_numpy
from .affinity import DISTANCE_OF
from .knn import extrapolate, listed
from .sampling import SampleConfig, subsample
from .stats import quantile_normalize, quantiles

Reduction = Callable[[np.ndarray, str, int], np.ndarray]  # rows, metric, seed -> layout


def pairwise(x: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS)
        return np.clip(1 - x @ x.T, 0, 2)
    s = (x * x).sum(1)
    return np.sqrt(np.maximum(0, s[:, None] + s - 2 * x @ x.T))


def tsne(dim: int, perplexity: float = 150, steps: int = 300) -> Reduction:
    """Exact t-SNE: neighbour widths by bisection, gradient descent with momentum and early exaggeration."""

    def reduce(x: np.ndarray, metric: str, seed: int) -> np.ndarray:
        n = len(x)
        if n < 3:
            return np.zeros((n, dim))
        d = pairwise(x, metric) ** 2
        np.fill_diagonal(d, np.inf)
        goal = np.log(min(perplexity, max(1.5, n // 2)))
        lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.full(n, 1 / max(1e-12, float(np.median(d[np.isfinite(d)]))))
        for _ in range(60):
            p = np.exp(-(d - d.min(1, keepdims=True)) * beta[:, None])
            p /= p.sum(1, keepdims=True)
            h = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
            lo, hi = np.where(h > goal, beta, lo), np.where(h > goal, hi, beta)
            beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
        p = (p + p.T) / (2 * n)
        y = np.random.default_rng(seed).standard_normal((n, dim)) * 1e-4
        move, rate = np.zeros_like(y), max(50.0, n / 12)
        for t in range(steps):
            q = 1 / (1 + pairwise(y, "euclidean") ** 2)
            np.fill_diagonal(q, 0)
            g = ((12 if t < 100 else 1) * p - q / q.sum()) * q
            move = (0.5 if t < 100 else 0.8) * move - rate * 4 * (g.sum(1)[:, None] * y - g @ y)
            y = y + move
            y -= y.mean(0)
        return y

    return reduce


def _curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """(a, b) of 1 / (1 + a d^2b), fitted by least squares to 1 up to ``min_dist`` and exponential decay beyond."""
    x = np.linspace(0, 3 * spread, 300)[1:]
    want = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):  # damped Gauss and Newton steps
        base = a * x ** (2 * b)
        y = 1 / (1 + base)
        slope = np.stack([-(y**2) * x ** (2 * b), -(y**2) * base * 2 * np.log(x)], 1)
        step = np.linalg.solve(slope.T @ slope + 1e-6 * np.eye(2), slope.T @ (want - y))
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-3, b + 0.5 * step[1])
    return float(a), float(b)


def _fuzzy(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j, weight) of the symmetric fuzzy graph of each row's k nearest."""
    n = len(d)
    near = np.argsort(d, 1, kind="stable")[:, :k]
    dist = np.take_along_axis(d, near, 1)
    rho, goal = dist[:, :1], np.log2(k) if k > 1 else 1.0
    lo, hi, s = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):
        total = np.exp(-np.maximum(0, dist - rho) / s[:, None]).sum(1)
        lo, hi = np.where(total < goal, s, lo), np.where(total < goal, hi, s)
        s = np.maximum(1e-9, np.where(np.isinf(hi), s * 2, (lo + hi) / 2))
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.maximum(0, dist - rho) / s[:, None]), 1)
    w = w + w.T - w * w.T
    i, j = np.nonzero(np.triu(w, 1))
    return i, j, w[i, j]


def _start(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray, dim: int, draw: np.random.Generator) -> np.ndarray:
    """Leading nontrivial eigenvectors of the normalised graph, spread over ten units, with a little noise."""
    a = np.zeros((n, n))
    a[i, j] = a[j, i] = w
    s = 1 / np.sqrt(np.maximum(a.sum(1), 1e-12))
    v = np.linalg.eigh(s[:, None] * a * s)[1][:, ::-1][:, 1 : dim + 1]
    y = np.zeros((n, dim))
    y[:, : v.shape[1]] = v
    return 10 * y / max(1e-12, float(np.abs(y).max())) + draw.standard_normal((n, dim)) * 1e-4


def umap(dim: int, neighbours: int = 150, min_dist: float = 0.1, steps: int = 200, output: str = "euclidean", negatives: int = 5) -> Reduction:
    """A fuzzy neighbour graph laid out from its eigenvectors by sampled gradient steps.

    In every step edges are drawn by their weight; their ends attract each other along the fitted curve, and each
    first end is repelled by ``negatives`` random rows. With ``output="haversine"`` points stay on the unit sphere and
    the layout has two angles.
    """

    def reduce(x: np.ndarray, metric: str, seed: int) -> np.ndarray:
        n = len(x)
        if n < 3:
            return np.zeros((n, dim))
        draw, ball = np.random.default_rng(seed), output == "haversine"
        d = pairwise(x, metric)
        np.fill_diagonal(d, np.inf)
        i, j, w = _fuzzy(d, min(neighbours, n - 1))
        y = _start(n, i, j, w, 3 if ball else dim, draw)
        a, b = _curve(min_dist)
        share = w / w.max()
        for t in range(steps):
            if ball:
                y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), vec.EPS)
            rate = 1 - t / steps
            use = draw.random(len(w)) < share
            p, q = np.concatenate([i[use], j[use]]), np.concatenate([j[use], i[use]])
            gap = y[p] - y[q]
            sq = (gap**2).sum(1, keepdims=True)
            pull = np.clip(-2 * a * b * np.where(sq > 0, sq, 1) ** (b - 1) / (1 + a * sq**b) * gap, -4, 4) * (sq > 0)
            far = draw.integers(0, n, (negatives, len(p)))
            move = np.zeros_like(y)
            np.add.at(move, p, pull)
            for other in far:
                gap = y[p] - y[other]
                sq = (gap**2).sum(1, keepdims=True)
                np.add.at(move, p, np.clip(2 * b / ((0.001 + sq) * (1 + a * sq**b)) * gap, -4, 4) * (p != other)[:, None])
            # Moves of a step are made together: they are averaged over a row's edges.
            y = y + rate * move / np.maximum(1, np.bincount(p, minlength=n))[:, None]
        if ball:
            y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), vec.EPS)
            return np.stack([np.arccos(np.clip(y[:, 2], -1, 1)), np.arctan2(y[:, 1], y[:, 0])], 1)
        return y - y.mean(0)

    return reduce


def reduced(df: DataFrame, reduction: Reduction, num_sample: int = 1000, kind: str = "cosine", k: int = 10, seed: int = 0, smooth: bool = True, columns: int = 3) -> DataFrame:
    """``(id, out)``: smooth all rows over their nearest of a farthest-point sample, lay out a second sample, extrapolate.

    Smoothed rows and the result are written once: many passes read them, none forms them again.
    """
    distance = DISTANCE_OF[kind]
    x = df.select("id", "v")
    if smooth:
        ids = subsample(x, distance, SampleConfig("fps", 10_000))
        anchors = x.join(ids, "id", "left_semi").withColumn("out", F.col("v"))
        x = written(extrapolate(anchors, x, k, kind).select("id", F.col("out").alias("v")), "smooth")
    ids = subsample(x, distance, SampleConfig("fps", num_sample))
    at, sample = to_numpy(x.join(ids, "id", "left_semi").where(vec.finite("v")), max(num_sample, 10_000))
    y = reduction(sample, "cosine" if kind == "cosine" else "euclidean", seed)
    anchors = df.sparkSession.createDataFrame(pa.table({"id": pa.array(at), "v": listed(sample), "out": listed(y)}))
    out = written(extrapolate(anchors, x, k, kind), "layout")
    if smooth:
        remove(x)
    return out


def color_rows(df: DataFrame, reduction: Reduction, rgb_func: Callable[[DataFrame, float], DataFrame], num_sample: int = 1000, affinity_type: str = "cosine", q: float = 0.95, knn: int = 10, seed: int = 0, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Colours of all rows by any layout of a sample and any map of its coordinates to colours.

    ``reduction`` takes (rows, metric, seed) and gives their layout; ``transform`` may change (id, out) before
    ``rgb_func`` makes (id, r, g, b) of (id, out) and q.
    """
    y = reduced(df, reduction, num_sample, affinity_type, knn, seed)
    return rgb_func(y if transform is None else transform(y), q)


def rgb_of_cube(y: DataFrame, q: float) -> DataFrame:
    cols = y.select("id", *(F.col("out")[i].alias(c) for i, c in enumerate("rgb")))
    return quantile_normalize(cols, ["r", "g", "b"], q)


def rgb_of_plane(y: DataFrame, q: float) -> DataFrame:
    cols = quantile_normalize(y.select("id", F.col("out")[0].alias("x"), F.col("out")[1].alias("y")), ["x", "y"], q)
    return cols.select("id", *(c.alias(n) for c, n in zip(color.map_2d(F.col("x"), F.col("y")), "rgb", strict=True)))


def lab_cube(df: DataFrame, q: float = 0.95, full_range: bool = True) -> DataFrame:
    """``(id, r, g, b)`` of three coordinates ``(id, v)`` as LAB: centred, turned so that the least axis is lightness.

    One aggregate of moments, one of quantiles. a and b reach 128 at the q quantile of their length, lightness
    spans 100 around the middle; without ``full_range`` all axes have the scale of lightness.
    """
    from .linalg import moments, signed

    _, mean, cov = moments(df)
    axes = signed(np.linalg.eigh(cov)[1])  # ascending: the least axis first
    turned = df.select("id", *(vec.total(F.transform(F.zip_with("v", F.array(*(F.lit(float(x)) for x in mean)), lambda a, b: a - b), lambda x, i: x * F.get(F.array(*(F.lit(float(w)) for w in axes[:, j])), i))).alias(c) for j, c in enumerate("lab")))
    far = quantiles(turned.select(F.hypot("a", "b").alias("ab")), ["ab"], [q])["ab"][0]
    lo, hi = quantiles(turned, ["l"], [(1 - q) / 2, (1 + q) / 2])["l"]
    wide = F.lit(100.0 / (hi - lo) if lo is not None and hi > lo else 0.0)
    flat = F.lit(128.0 / far if far else 0.0) if full_range else wide
    rgb = color.lab_to_rgb(F.col("l") * wide + 50.0, F.col("a") * flat, F.col("b") * flat)
    return turned.select("id", *(c.alias(n) for c, n in zip(rgb, "rgb", strict=True)))


def rgb_from_tsne_2d(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", perplexity: float = 150, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    return color_rows(df, tsne(2, min(perplexity, num_sample // 2)), rgb_of_plane, num_sample, affinity_type, q, knn, seed)


def rgb_from_tsne_3d(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", perplexity: float = 150, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    return color_rows(df, tsne(3, min(perplexity, num_sample // 2)), rgb_of_cube, num_sample, affinity_type, q, knn, seed)


def rgb_from_euclidean_tsne_3d(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", perplexity: float = 150, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    flat = lambda y: y.select("id", vec.to_euclidean("out", DISTANCE_OF[affinity_type]).alias("out"))
    return color_rows(df, tsne(3, min(perplexity, num_sample // 2)), rgb_of_cube, num_sample, affinity_type, q, knn, seed, flat)


def rgb_from_umap_2d(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", n_neighbors: int = 150, min_dist: float = 0.1, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    return color_rows(df, umap(2, n_neighbors, min_dist), rgb_of_plane, num_sample, affinity_type, q, knn, seed)


def rgb_from_umap_3d(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", n_neighbors: int = 150, min_dist: float = 0.1, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    return color_rows(df, umap(3, n_neighbors, min_dist), rgb_of_cube, num_sample, affinity_type, q, knn, seed)


def rgb_from_umap_sphere(df: DataFrame, num_sample: int = 1000, affinity_type: str = "cosine", n_neighbors: int = 150, min_dist: float = 0.1, q: float = 0.95, knn: int = 10, seed: int = 0) -> DataFrame:
    ball = lambda y: y.select("id", F.array(*color.sphere(F.col("out")[0], F.col("out")[1])).alias("out"))
    return color_rows(df, umap(2, n_neighbors, min_dist, output="haversine"), rgb_of_cube, num_sample, affinity_type, q, knn, seed, ball)
