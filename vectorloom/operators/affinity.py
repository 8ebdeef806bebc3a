"""Distances, affinities and degrees: a bounded side is a matrix on every executor, the other streams through array kernels; two sides of any size meet in pieces.

Blocks of a batch have at most ``CELLS`` pairs; pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import written
from ..sources.tables import CHUNK, matrix, to_numpy
from .stats import normal_tail, scale_factor

DISTANCE_OF = {"cosine": "cosine", "rbf": "euclidean"}
#: Rows of a side that may be broadcast; pairs a task works on at once.
MOST, CELLS = 20_000, 1 << 21


def sliced(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of which a matrix of ``width`` columns has at most ``CELLS`` elements."""
    rows = max(1, CELLS // max(1, width))
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _pairs(a: DataFrame, b: DataFrame, name: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``(i, j, name)`` for all pairs: up to ``MOST`` rows of ``b`` are broadcast, ``a`` streams; more meet it in pieces."""
    if b.select("id").limit(MOST + 1).count() > MOST:
        return _pairs_of_many(a, b, name, value)
    ids, y = to_numpy(b, MOST)
    shared = a.sparkSession.sparkContext.broadcast((ids, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        js, other = shared.value
        for part in sliced(batches, len(js)):
            got = value(matrix(part.column(1), other.shape[1]), other)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(part.column(0)), len(js))), pa.array(np.tile(js, part.num_rows)), pa.array(got.reshape(-1))], names=["i", "j", name])

    return a.select("id", "v").mapInArrow(run, f"i bigint, j bigint, {name} double")


def _pairs_of_many(a: DataFrame, b: DataFrame, name: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The same for sides of any size: a task holds a piece of b and forms ``CELLS`` pairs at once, all of which it gives."""
    from .paired import Side, paired
    from .tiles import dealt, each, pieces

    high, wide = pieces(a, a.count(), CHUNK, 1 << 18), pieces(b, b.count(), CHUNK, MOST)
    none = F.array(F.lit(0.0)).alias("a")
    left = a.select(dealt(high).alias("p"), each(wide).alias("q"), "id", "v", none)
    right = b.select(each(high).alias("p"), dealt(wide).alias("q"), "id", "v", none)

    def meet(p: int, q: int, there: Side, here: Side) -> pa.RecordBatch:
        got = value(here[1], there[1])
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(here[0], len(there[0]))), pa.array(np.tile(there[0], len(here[0]))), pa.array(got.reshape(-1))], names=["i", "j", name])

    return paired(right, left, meet, f"i bigint, j bigint, {name} double", high * wide, (F.col("p") * wide + F.col("q")).cast("int"))


def block_distance(x: np.ndarray, y: np.ndarray, distance: str) -> np.ndarray:
    if distance == "cosine":
        return 1 - unit(x) @ unit(y).T
    if distance == "euclidean":
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T))
    raise ValueError(f"unknown distance: {distance}")


def distances(a: DataFrame, b: DataFrame, distance: str = "cosine") -> DataFrame:
    """``(i, j, d)`` for all pairs of rows of a and of b."""
    if distance not in DISTANCE_OF.values():
        raise ValueError(f"unknown distance: {distance}")
    return _pairs(a, b, "d", lambda x, y: block_distance(x, y, distance))


def affinities(a: DataFrame, b: DataFrame | None = None, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``(i, j, w)`` for all pairs of rows of a and of b. For "rbf" the scale comes from ``a`` alone."""
    if kind not in DISTANCE_OF:
        raise ValueError(f"unknown affinity: {kind}")
    scale = scale_factor(a).first()[0] if kind == "rbf" else None
    return _pairs(a, a if b is None else b, "w", lambda x, y: block(y, x, kind, gamma, scale))


def degrees(pairs: DataFrame, node: str = "i") -> DataFrame:
    """``(id, degree)``: sums of affinities, NaN as 0."""
    return pairs.groupBy(F.col(node).alias("id")).agg(F.sum(F.nanvl("w", F.lit(0.0))).alias("degree"))


def pair_degrees(df: DataFrame, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``degrees`` of all pairs of a table, summed where they are formed, whatever its size: no pair is a row. A missing row has 0."""
    if kind not in DISTANCE_OF:
        raise ValueError(f"unknown affinity: {kind}")
    from .tiles import symmetric

    scale = scale_factor(df).first()[0] if kind == "rbf" else None
    rows = df.select("id", "v").where(vec.finite("v")).withColumn("a", F.array(F.lit(1.0)))
    found = symmetric(rows, rows.count(), kind, gamma, scale).select("id", F.col("y")[0].alias("degree"))
    return df.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0.0)).alias("degree"))


def normalized(pairs: DataFrame, rows: DataFrame, columns: DataFrame) -> DataFrame:
    """``(i, j, w)`` divided by the root of both degrees."""
    r = rows.select(F.col("id").alias("i"), F.col("degree").alias("di"))
    c = columns.select(F.col("id").alias("j"), F.col("degree").alias("dj"))
    return pairs.join(r, "i").join(c, "j").select("i", "j", F.try_divide(F.col("w"), F.sqrt(F.col("di") * F.col("dj"))).alias("w"))


def normalized_affinities(df: DataFrame, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``(i, j, w)`` of a table, divided by the root of both degrees where they are formed: degrees first, then the pairs, which are never shuffled.

    Beyond ``MOST`` rows pairs with a missing row are NaN and the other degrees leave it out; degrees come to the pairs as a last coordinate of the vectors.
    """
    if kind not in DISTANCE_OF:
        raise ValueError(f"unknown affinity: {kind}")
    if df.select("id").limit(MOST + 1).count() > MOST:
        scale = scale_factor(df).first()[0] if kind == "rbf" else None
        # Written: counts and both sides read them, and each reading would sum all pairs again.
        told = written(df.select("id", "v").join(all_degrees(df, kind, gamma), "id").select("id", F.concat("v", F.array("degree")).alias("v")), "degrees")
        return _pairs(told, told, "w", lambda x, y: block(y[:, :-1], x[:, :-1], kind, gamma, scale) / np.sqrt(x[:, -1:] * y[:, -1]))
    ids, x = to_numpy(df, MOST)
    scale = sigma(x) if kind == "rbf" else None
    got = block_degrees(df, x, kind, gamma).toArrow()  # a number for each of the bounded rows
    order = np.argsort(np.asarray(got.column("id")), kind="stable")
    degree = np.asarray(got.column("degree"))[order]
    shared = df.sparkSession.sparkContext.broadcast((x, degree))

    def value(rows: np.ndarray, _: np.ndarray) -> np.ndarray:
        y, d = shared.value
        w = block(y, rows, kind, gamma, scale)
        return w / np.sqrt(np.nansum(w, 1)[:, None] * d)

    return _pairs(df, df, "w", value)


def all_degrees(df: DataFrame, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``(id, degree)`` of every row against all rows: up to ``MOST`` of them are broadcast, more are summed in tiles, missing rows left out and NaN."""
    if df.select("id").limit(MOST + 1).count() <= MOST:
        return block_degrees(df, to_numpy(df, MOST)[1], kind, gamma)
    from .tiles import symmetric

    rows = df.select("id", "v").where(vec.finite("v")).withColumn("a", F.array(F.lit(1.0)))
    scale = scale_factor(df).first()[0] if kind == "rbf" else None
    found = symmetric(rows, rows.count(), kind, gamma, scale).select("id", F.col("y")[0].alias("degree"))
    return df.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(float("nan"))).alias("degree"))


def sigma(x: np.ndarray, c: float = 2.0) -> float:
    """The same scale for a bounded matrix."""
    lo, hi = np.nanquantile(x, normal_tail(c), axis=0)
    return float(np.linalg.norm(hi - lo) / (2 * c))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS)


def block(anchors: np.ndarray, rows: np.ndarray, kind: str, gamma: float, scale: float | None = None) -> np.ndarray:
    """Affinity of every row (first axis) with every anchor."""
    if kind == "cosine":
        return np.exp(-(1 - unit(rows) @ unit(anchors).T) / gamma)
    if kind == "rbf":
        square = np.maximum(0, (rows**2).sum(1)[:, None] + (anchors**2).sum(1) - 2 * rows @ anchors.T)
        return np.exp(-0.5 * square / (scale**2 * gamma))
    raise ValueError(f"unknown affinity: {kind}")


def exponents(x: np.ndarray, kind: str, gamma: float, scale: float | None, rows: bool) -> np.ndarray:
    """A side of affinities as factors: the exponents are the products of those of rows with those of columns."""
    one = np.ones((len(x), 1))
    if kind == "cosine":
        return np.concatenate([unit(x) / gamma, -one / gamma], 1) if rows else np.concatenate([unit(x), one], 1)
    square = (x**2).sum(1)[:, None]
    if kind == "distance":
        return np.concatenate([-2 * x, square, one], 1) if rows else np.concatenate([x, one, square], 1)
    if kind == "rbf":
        by = 1 / (scale**2 * gamma)
        return np.concatenate([x * by, -0.5 * by * square, -0.5 * by * one], 1) if rows else np.concatenate([x, one, square], 1)
    raise ValueError(f"unknown affinity: {kind}")


def tile(rows: np.ndarray, columns: np.ndarray, kind: str) -> np.ndarray:
    """The affinities of two such sides, in one array; Euclidean distances for "distance"."""
    w = rows @ columns.T
    if kind == "distance":
        return np.sqrt(np.maximum(w, 0, out=w), out=w)
    if kind == "rbf":
        np.minimum(w, 0, out=w)
    return np.exp(w, out=w)


def block_degrees(df: DataFrame, anchors: np.ndarray, kind: str = "cosine", gamma: float = 1.0) -> DataFrame:
    """``(id, degree)`` of every row against a bounded set of anchors, in blocks."""
    if len(anchors) > MOST:
        raise ValueError(f"more than {MOST} anchors")
    scale = sigma(anchors) if kind == "rbf" else None
    shared = df.sparkSession.sparkContext.broadcast(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, len(shared.value)):
            w = block(shared.value, matrix(b.column(1), shared.value.shape[1]), kind, gamma, scale)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w.sum(1))], names=["id", "degree"])

    return df.select("id", "v").mapInArrow(run, "id bigint, degree double")
