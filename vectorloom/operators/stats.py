"""Quantiles, normalisation and summaries as partial aggregates and projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vec import clamp, null_nan
from ..sources.shared import remove, written
from ..sources.tables import matrix
from . import linalg

#: Bits of a value that a pass of the exact quantiles tells apart; values that are fetched rather than counted further.
DIGIT, FETCH = 11, 10_000


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    b = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(b >> np.uint64(63) == 1, ~b, b | np.uint64(1 << 63))


def _doubles(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63) == 1, u ^ np.uint64(1 << 63), ~u).view(np.float64)


def vector_quantiles(df: DataFrame, vector: str, probabilities: list[float]) -> np.ndarray:
    """Exact, linearly interpolated quantiles per coordinate (probabilities x d); NaN and NULL ignored, NaN where nothing is left.

    The column is written once: its passes don't form it again.
    """
    held = written(df.select(F.col(vector).cast("array<double>").alias("v")), "quantiles")
    try:
        return _selected(held, "v", probabilities)
    finally:
        remove(held)


def _selected(df: DataFrame, vector: str, probabilities: list[float]) -> np.ndarray:
    """A radix selection: passes count the next ``DIGIT`` bits of the values that may still be the wanted ones (partial
    aggregates of fixed size); the last few of these values are fetched. No task ever holds or sorts a column.
    """
    first = df.select(F.size(vector).alias("d")).where("d >= 0").first()
    if first is None:
        return np.full((len(probabilities), 0), np.nan)
    d, size = first.d, 1 << DIGIT
    shift = 64 - DIGIT

    def leading(x: np.ndarray) -> np.ndarray:
        digit, good = (_ordered(x) >> np.uint64(shift)).astype(np.int64), ~np.isnan(x)
        return np.stack([np.bincount(digit[good[:, j], j], minlength=size) for j in range(d)])

    counts = linalg.summed(df, [vector], leading).reshape(d, size)
    n = counts.sum(1)
    spot = [[p * max(0, m - 1) for p in probabilities] for m in n]
    wanted = sorted({(j, int(r)) for j in range(d) if n[j] for h in spot[j] for r in (math.floor(h), math.ceil(h))})
    state = {}  # (coordinate, rank): (known leading bits, rank among values that have them, their number)

    def narrowed(at: np.ndarray, rank: int, prefix: int) -> tuple[int, int, int]:
        upto = np.cumsum(at)
        k = int(np.searchsorted(upto, rank, side="right"))
        return prefix * len(at) + k, rank - int(upto[k] - at[k]), int(at[k])

    for j, r in wanted:
        state[j, r] = narrowed(counts[j], r, 0)
    while shift and sum({(j, s[0]): s[2] for (j, _), s in state.items()}.values()) > FETCH:
        held, step = sorted({(j, s[0]) for (j, _), s in state.items()}), min(DIGIT, shift)
        shift -= step

        def deeper(x: np.ndarray, held=held, step=step, shift=shift) -> np.ndarray:
            u, good = _ordered(x), ~np.isnan(x)
            out = []
            for j, prefix in held:
                mine = u[good[:, j], j] >> np.uint64(shift)
                mine = mine[mine >> np.uint64(step) == prefix]
                out.append(np.bincount((mine & np.uint64((1 << step) - 1)).astype(np.int64), minlength=1 << step))
            return np.stack(out)

        found = dict(zip(held, linalg.summed(df, [vector], deeper).reshape(len(held), -1), strict=True))
        state = {k: narrowed(found[k[0], s[0]], s[1], s[0]) for k, s in state.items()}
    held = sorted({(j, s[0]) for (j, _), s in state.items()})

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0), d)
            u, good = _ordered(x), ~np.isnan(x)
            for k, (j, prefix) in enumerate(held):
                mine = u[good[:, j], j]
                mine = mine[mine >> np.uint64(shift) == prefix]
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), k)), pa.array(mine.view(np.int64))], names=["k", "u"])

    if shift:
        got = df.select(vector).mapInArrow(last, "k bigint, u bigint").toArrow()  # at most FETCH rows
        of, u = np.asarray(got.column(0)), np.asarray(got.column(1)).view(np.uint64)
        values = {key: np.sort(u[of == k]) for k, key in enumerate(held)}
        exact = {key: float(_doubles(values[key[0], s[0]][s[1]][None])[0]) for key, s in state.items()}
    else:
        exact = {key: float(_doubles(np.array([s[0]], np.uint64))[0]) for key, s in state.items()}
    out = np.full((len(probabilities), d), np.nan)
    for j in range(d):
        for i, h in enumerate(spot[j]):
            if n[j]:
                lo, hi = exact[j, math.floor(h)], exact[j, math.ceil(h)]
                out[i, j] = lo if lo == hi else (math.ceil(h) - h) * lo + (h - math.floor(h)) * hi
    return out


def quantiles(df: DataFrame, columns: list[str], probabilities: list[float], accuracy: int | None = None) -> dict[str, list[float]]:
    """Linearly interpolated quantiles per column; NaN and NULL ignored. With ``accuracy`` approximate, in one pass."""
    if accuracy is not None:
        row = df.agg(*(F.percentile_approx(null_nan(c), F.array(*(F.lit(p) for p in probabilities)), accuracy).alias(c) for c in columns)).first()
        return {c: list(row[c]) if row[c] is not None else [None] * len(probabilities) for c in columns}
    got = vector_quantiles(df.select(F.array(*(F.col(c).cast("double") for c in columns)).alias("v")), "v", probabilities)
    return {c: [None if np.isnan(x) else float(x) for x in got[:, j]] if got.size else [None] * len(probabilities) for j, c in enumerate(columns)}


def quantile_normalize(df: DataFrame, columns: list[str], q: float = 0.95, accuracy: int | None = None) -> DataFrame:
    """Each column to ``(x - Q(1-q)) / (Q(q) - Q(1-q))`` in [0, 1]; a constant column becomes 0."""
    return normalize_between(df, quantiles(df, columns, [1 - q, q], accuracy))


def normalize_between(df: DataFrame, edge: dict[str, list[float]]) -> DataFrame:
    """Columns to their place between two edges, in [0, 1]; 0 where these are one."""
    lit = lambda x: F.lit(x).cast("double")
    scaled = lambda c: F.coalesce(clamp(F.try_divide(F.col(c) - lit(edge[c][0]), lit(edge[c][1]) - lit(edge[c][0]))), F.lit(0.0))
    return df.select(*(scaled(c).alias(c) if c in edge else c for c in df.columns))


def normal_tail(c: float = 2.0) -> tuple[float, float]:
    """Probabilities of a normal variable below -c and below c standard deviations."""
    return (math.erf(-c / math.sqrt(2)) + 1) / 2, (math.erf(c / math.sqrt(2)) + 1) / 2


def scale_factor(df: DataFrame, vector: str = "v", c: float = 2.0) -> DataFrame:
    """One row ``sigma``: the length of the per-coordinate spreads between the normal tails, over 2c."""
    lo, hi = vector_quantiles(df, vector, list(normal_tail(c)))
    sigma = float(np.sqrt(((hi - lo) ** 2).sum()) / (2 * c)) if len(lo) else None
    return df.sparkSession.createDataFrame([(sigma,)], "sigma double")


def vector_sum(df: DataFrame, vector: str = "v", by: list[str] | None = None) -> DataFrame:
    """``(*by, pos, total)``: sums per coordinate, NaN as 0."""
    return df.select(*(by or []), F.posexplode(vector).alias("pos", "x")).groupBy(*(by or []), "pos").agg(F.sum(F.nanvl("x", F.lit(0.0))).alias("total"))


def profile(df: DataFrame, column: str) -> DataFrame:
    """One row: any NaN, any infinity, largest and smallest absolute value."""
    x = F.col(column)
    ok = F.when(~F.isnan(x), F.abs(x))
    return df.agg(F.coalesce(F.bool_or(F.isnan(x)), F.lit(False)).alias("has_nan"), F.coalesce(F.bool_or(F.abs(x) == F.lit(float("inf"))), F.lit(False)).alias("has_inf"), F.max(ok).alias("max_abs"), F.min(ok).alias("min_abs"))


def heatmap(df: DataFrame, column: str, gamma: float = 1.0, out: str = "heat") -> DataFrame:
    """Contrast of a distance over the whole table: standardised, ``exp(-gamma z)``, scaled between its 1 % tails."""
    moments = df.agg(F.avg(column).alias("__m"), F.stddev_samp(column).alias("__s"))
    shaped = df.crossJoin(F.broadcast(moments)).withColumn("__h", F.exp(-F.lit(gamma) * F.try_divide(F.col(column) - F.col("__m"), F.col("__s")))).drop("__m", "__s")
    lo, hi = quantiles(shaped, ["__h"], [0.01, 0.99])["__h"]
    lit = lambda x: F.lit(x).cast("double")
    scaled: Column = F.coalesce(F.try_divide(F.col("__h") - lit(lo), lit(hi) - lit(lo)), F.lit(0.0))
    return shaped.withColumn(out, scaled).drop("__h")
