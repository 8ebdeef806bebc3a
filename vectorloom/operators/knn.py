"""Nearest-anchor extrapolation: each row gets the weighted mean of its nearest anchors' outputs, however many anchors there are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.tables import matrix, to_numpy
from .affinity import MOST, affinities, block, sigma, sliced
from .stats import scale_factor

#: Digits of an affinity that count for its rank: equal ones must not differ by the order of a sum.
DIGITS = 12


def nearest(anchors: DataFrame, queries: DataFrame, k: int | None = 10, kind: str = "cosine", gamma: float = 1.0, most: int = MOST) -> DataFrame:
    """``(id, anchor_id, w, rank)``: the k largest affinities of each query, ties by anchor id.

    Up to ``most`` anchors are broadcast and each block of queries gives its k nearest at once; more are met in cells
    (``neighbours``). Both are exact. ``k`` None ranks all pairs, for a bounded set of anchors alone.
    """
    if k is None:
        pairs = affinities(anchors, queries, kind, gamma).select(F.col("j").alias("id"), F.col("i").alias("anchor_id"), "w")
        return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("w"), "anchor_id")))
    if not few(anchors, most):
        return many(anchors, queries, k, kind, gamma)
    ids, x = to_numpy(anchors.select("id", "v").where(vec.finite("v")), most)
    if not len(ids):
        return queries.sparkSession.createDataFrame([], "id bigint, anchor_id bigint, w double, rank int")
    shared = queries.sparkSession.sparkContext.broadcast((ids, x, sigma(x) if kind == "rbf" else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, y, scale = shared.value
        n = min(k, len(names))
        for b in sliced(batches, len(names)):
            rows = matrix(b.column(1), y.shape[1])
            good = np.nonzero(np.isfinite(rows).all(1))[0]
            w = np.round(block(y, rows[good], kind, gamma, scale), DIGITS)
            at = largest(w, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(0))[good], n)), pa.array(names[at].reshape(-1)), pa.array(np.take_along_axis(w, at, 1).reshape(-1)), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(good)))], names=["id", "anchor_id", "w", "rank"])

    return queries.select("id", "v").mapInArrow(run, "id bigint, anchor_id bigint, w double, rank int")


def few(anchors: DataFrame, most: int) -> bool:
    return anchors.select("id").limit(most + 1).count() <= most


def many(anchors: DataFrame, queries: DataFrame, k: int, kind: str, gamma: float) -> DataFrame:
    """``nearest`` among anchors of any number."""
    from .neighbours import nearest_of_many

    if kind == "rbf":
        scale = scale_factor(anchors.where(vec.finite("v"))).first()[0] or 1.0
        w = F.exp(-0.5 * F.col("d2") / float(scale**2 * gamma))
    else:
        w = F.exp(-F.col("d2") / (2.0 * gamma))
    return nearest_of_many(anchors, queries, k, kind).select("id", "anchor_id", w.alias("w"), F.col("rank").cast("int").alias("rank"))


def extrapolate_native(anchors: DataFrame, queries: DataFrame, k: int | None = 10, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``(id, pos, value)``; ``anchors`` has ``(id, v, out)``. For small or checked work."""
    near = nearest(anchors, queries, k, kind, gamma)
    outs = anchors.select(F.col("id").alias("anchor_id"), F.posexplode("out").alias("pos", "y"))
    return near.join(outs, "anchor_id").groupBy("id", "pos").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("value"))


def extrapolate(anchors: DataFrame, queries: DataFrame, k: int | None = 10, kind: str = "cosine", gamma: float = 1.0, most: int = MOST) -> DataFrame:
    """``(id, out)`` in blocks: up to ``most`` anchors are broadcast, queries stream and nothing is shuffled; more are met in cells or, without k, in tiles."""
    if not few(anchors, most):
        return _extrapolate_many(anchors, queries, k, kind, gamma)
    dim = anchors.select(F.size("v")).first()
    _, both = to_numpy(anchors.select("id", F.concat("v", "out").alias("v")), MOST)
    a, y = np.split(both, [dim[0] if dim else 0], 1)
    scale = sigma(a) if kind == "rbf" else None
    shared = queries.sparkSession.sparkContext.broadcast((a, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, out = shared.value
        for b in sliced(batches, len(x)):
            rows = matrix(b.column(1), x.shape[1])
            w = np.nan_to_num(block(x, rows, kind, gamma, scale))
            if k is not None and k < len(x):
                at = largest(w, k)
                w = np.take_along_axis(w, at, 1)
                got = (w[:, :, None] * out[at]).sum(1) / np.maximum(w.sum(1, keepdims=True), 1e-12)
            else:
                got = w @ out / np.maximum(w.sum(1, keepdims=True), 1e-12)
            got[~np.isfinite(rows).all(1)] = np.nan
            yield pa.RecordBatch.from_arrays([b.column(0), listed(got)], names=["id", "out"])

    return queries.select("id", "v").mapInArrow(run, "id bigint, out array<double>")


def _extrapolate_many(anchors: DataFrame, queries: DataFrame, k: int | None, kind: str, gamma: float) -> DataFrame:
    """The same for anchors of any number: outputs come to the pairs by anchor id, at most k of them to a query."""
    if k is None:
        from .tiles import product

        scale = scale_factor(anchors.where(vec.finite("v"))).first()[0] if kind == "rbf" else None
        held = anchors.where(vec.finite("v")).select("id", "v", F.concat("out", F.array(F.lit(1.0))).alias("a"))
        got = product(queries.where(vec.finite("v")), held, kind, gamma, scale).withColumn("s", F.greatest(F.element_at("y", -1), F.lit(1e-12)))
        found = got.select("id", F.transform(F.slice("y", F.lit(1), F.size("y") - 1), lambda x: x / F.col("s")).alias("found"))
    else:
        near = many(anchors, queries, k, kind, gamma)
        outs = anchors.select(F.col("id").alias("anchor_id"), "out")
        held = near.join(outs, "anchor_id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "out"))).alias("p"))
        start = F.transform(F.col("p")[0]["out"], lambda x: x * 0.0)
        sums = F.aggregate("p", start, lambda acc, e: F.zip_with(acc, e["out"], lambda s, x: s + x * e["w"]))
        total = F.greatest(F.aggregate("p", F.lit(0.0), lambda acc, e: acc + e["w"]), F.lit(1e-12))
        found = held.select("id", sums.alias("y"), total.alias("s")).select("id", F.transform("y", lambda x: x / F.col("s")).alias("found"))
    width = (anchors.select(F.size("out")).first() or [0])[0]
    missing = F.array_repeat(F.lit(float("nan")), width)
    return queries.select("id").join(found, "id", "left").select("id", F.coalesce("found", missing).alias("out"))


def largest(w: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest of each row, largest first, equal ones by column: without sorting whole rows."""
    edge = np.partition(w, w.shape[1] - k, axis=1)[:, w.shape[1] - k]
    above = w > edge[:, None]
    # Of those equal to the k-th the first ones, as many as are missing.
    equal = w == edge[:, None]
    take = above | (equal & (np.cumsum(equal, 1) <= k - above.sum(1, keepdims=True)))
    at = np.nonzero(take)[1].reshape(len(w), k)
    return np.take_along_axis(at, np.argsort(-np.take_along_axis(w, at, 1), axis=1, kind="stable"), 1)


def listed(x: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.reshape(-1)))


def extrapolate_with_subsampling(full: DataFrame, queries: DataFrame, config, k: int | None = 10, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """Anchors are a sample of ``full (id, v, out)``."""
    from .affinity import DISTANCE_OF
    from .sampling import subsample

    ids = subsample(full.select("id", "v"), DISTANCE_OF[kind], config)
    return extrapolate(full.join(ids, "id", "left_semi"), queries, k, kind, gamma)
