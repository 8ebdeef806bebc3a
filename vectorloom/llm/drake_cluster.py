"""Centroid clustering with Drake's adaptive bounds, exact in whole numbers.

Each vector keeps its centroid, lower bounds on the distances to its several nearest other centroids, in order, and
one bound for all the rest. When centroids move, bounds move with them; the distance to the own centroid is
then formed exactly. If that is certainly less than every bound, nothing else is looked at; if it is less than the bounds from the z-th on, the first z
centroids are compared exactly; if no order can be certified, all centroids are. Equal distances are
never certified, so ties always come to the exact comparison, where the smaller number wins. How many bounds are kept
falls with what was used (from a quarter of the centroids to an eighth).

A round is one pass over the vectors and their bounds, written to the shared folder (the last round's is deleted), and one sum over the
vectors that changed their centroid. Centroids, counts and sums are fixed in size whatever the rows; nothing is shuffled but these sums.

Components become whole numbers ``floor(scale * x)``. They are kept as doubles, which hold each of them exactly; where squares
might not fit a double's 53 bits, distances are formed by Python's integers. A distance, or a sum, beyond a long is given as
the largest long.

Defined results: vectors that are null, of another length, or with a null or non-finite component (after scaling) are left out; fewer vectors than
centroids give as many centroids as vectors; repeated ids are vectors of their own (the first by components is a seed); a null id
is clustered but no seed unless ids run out; empty tables give empty tables; other columns don't take part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard

K, ROUNDS, SCALE = 16, 3, 64
LONGEST = (1 << 63) - 1
#: Below this, sums of products of whole numbers are exact in doubles.
EXACT = float(1 << 53)
#: By what bounds give way to rounding.
SLACK = 1e-12
#: Rows worked on at once.
ROWS = 4096
STATE = "`key` {0}, v array<double>, was int, cluster int, distance bigint, near array<int>, low array<double>, rest double, used int, scans int"


def whole(df: DataFrame, key: str, vector: str, dim: int, scale: int = SCALE) -> DataFrame:
    """``(key, v)``: the kept vectors in whole numbers."""
    x = F.col(vector).cast("array<double>")
    good = (F.size(x) == dim) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e * float(scale)) < float("inf")))
    kept = df.where(F.coalesce(good, F.lit(False)))
    # A double's floor as a double: a long would not hold every one. Below 2^53 the long is exact, beyond it a double has no fraction.
    down = lambda e: F.when(F.abs(e) < EXACT, F.floor(e).cast("double")).otherwise(e)
    return kept.select(F.col(key).alias("key"), F.transform(x, lambda e: down(e * float(scale))).alias("v"))


def seeds(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors that come first by the hash of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = kept.select(order.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).toArrow()
    return [[int(x) for x in row] for row in first.column("v").to_pylist()]


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centroids, exact while all sums stay below ``EXACT``."""
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)


@dataclass
class Bounds:
    """One pass: the centroids, how far each has moved, and how many bounds are kept."""

    centroids: list[list[int]]
    moved: np.ndarray | None = None
    keep: int = 1
    c: np.ndarray = field(init=False)

    def __post_init__(self):
        self.c = np.array([[float(x) for x in row] for row in self.centroids])

    def start(self, x: np.ndarray) -> tuple:
        n, b = len(x), min(self.keep, len(self.c) - 1)
        return self._certify(x, np.zeros(n, np.int64), np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n))

    def step(self, x: np.ndarray, a: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> tuple:
        b = min(self.keep, near.shape[1])
        if b < near.shape[1]:  # the bounds given up join the rest
            rest = np.minimum(rest, low[:, b:].min(1))
            near, low = near[:, :b], low[:, :b]
        return self._certify(x, a, near, low - self.moved[near], rest - self.moved.max())

    def _certify(self, x: np.ndarray, a: np.ndarray, near: np.ndarray, low: np.ndarray, rest: np.ndarray) -> tuple:
        """(centroid, distance, near, low, rest, used bounds, distances formed) of each row; distances are Python's integers or doubles."""
        n, k = len(x), len(self.c)
        b = near.shape[1]
        most = np.maximum(np.abs(x).max(1, initial=0), np.abs(self.c).max(initial=0))
        big = 4 * most * most * x.shape[1] >= EXACT
        if big.any():
            out = [np.empty((n, *y.shape[1:]), y.dtype) for y in (a, np.empty(0, object), near, low, rest, a, a)]
            few, many = np.nonzero(~big)[0], np.nonzero(big)[0]
            for at, part in ((few, self._certify(x[few], a[few], near[few], low[few], rest[few])), (many, self._by_integers(x[many], b))) if len(few) else ((many, self._by_integers(x, b)),):
                for whole_column, column in zip(out, part, strict=True):
                    whole_column[at] = column
            return tuple(out)
        a, near, low, rest = a.copy(), near.copy(), low.copy(), rest.copy()
        d = ((x - self.c[a]) ** 2).sum(1)
        own = np.sqrt(d) * (1 + SLACK)
        # The least bound from the z-th on, z = b: that of the rest alone.
        edge = np.minimum.accumulate(np.concatenate([low, rest[:, None]], 1)[:, ::-1], 1)[:, ::-1] * (1 - SLACK)
        sure = own[:, None] < edge
        z = np.where(sure.any(1), sure.argmax(1), b + 1)
        used, scans = np.minimum(z, b), np.ones(n, np.int64)
        for i in np.unique(z[(z > 0) & (z <= b)]):
            at = np.nonzero(z == i)[0]
            ids = np.concatenate([a[at, None], near[at, :i]], 1)
            far = ((x[at, None] - self.c[ids]) ** 2).sum(2)
            order = np.lexsort((ids, far), axis=1)
            ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
            a[at], d[at], near[at, :i], low[at, :i] = ids[:, 0], far[:, 0], ids[:, 1:], np.sqrt(far[:, 1:]) * (1 - SLACK)
            scans[at] += i
        at = np.nonzero(z > b)[0]
        if len(at):
            far = squares(x[at], self.c)
            order = np.argsort(far, axis=1, kind="stable")
            far = np.take_along_axis(far, order, 1)
            a[at], d[at], near[at], low[at] = order[:, 0], far[:, 0], order[:, 1 : b + 1], np.sqrt(far[:, 1 : b + 1]) * (1 - SLACK)
            rest[at] = np.sqrt(far[:, b + 1]) * (1 - SLACK) if b + 1 < k else np.inf
            scans[at] = k
        return a, [int(y) for y in d], near, low, rest, used, scans

    def _by_integers(self, x: np.ndarray, b: int) -> tuple:
        """All distances by Python's integers; no bounds, so that the next pass does the same."""
        n, k = len(x), len(self.c)
        a, d = np.zeros(n, np.int64), []
        for i, row in enumerate(x.tolist()):
            whole_row = [int(y) for y in row]
            far = [sum((p - q) ** 2 for p, q in zip(whole_row, c, strict=True)) for c in self.centroids]
            a[i] = min(range(k), key=lambda j: (far[j], j))
            d.append(min(far[a[i]], LONGEST))
        return a, d, np.zeros((n, b), np.int64), np.zeros((n, b)), np.zeros(n), np.full(n, b), np.full(n, k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(x.reshape(-1), kind))


def assign(state: DataFrame, bounds: Bounds, dim: int, first: bool) -> DataFrame:
    """``STATE`` of one pass."""
    kind = dict(state.dtypes)["key"]
    shared = state.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                x = _matrix(part.column(1), dim)
                if first:
                    was, got = pa.nulls(len(x), pa.int32()), now.start(x)
                else:
                    was = part.column(2)
                    near = part.column(3)
                    wide = len(near.flatten()) // max(1, len(near))
                    got = now.step(x, np.asarray(was, np.int64), np.asarray(near.flatten(), np.int64).reshape(len(x), wide), np.asarray(part.column(4).flatten()).reshape(len(x), wide), np.asarray(part.column(5)))
                a, d, near, low, rest, used, scans = got
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), was, pa.array(a, pa.int32()), pa.array([min(y, LONGEST) for y in d], pa.int64()), _lists(near, pa.int32()), _lists(low, pa.float64()), pa.array(rest), pa.array(used, pa.int32()), pa.array(scans, pa.int32())], names=["key", "v", "was", "cluster", "distance", "near", "low", "rest", "used", "scans"])

    columns = ["key", "v"] if first else ["key", "v", "cluster", "near", "low", "rest"]
    return state.select(columns).mapInArrow(run, STATE.format(kind))


def changes(state: DataFrame, dim: int) -> dict[int, list[int]]:
    """By centroid, what its count and the sums of its components gain from the vectors that came or left. Exact, of fixed size."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            x = _matrix(batch.column(2), dim)
            small = 2 * np.abs(x).max(initial=0) * len(x) < EXACT
            for column, sign in ((0, -1), (1, 1)):
                at = np.asarray(pc.fill_null(batch.column(column), -1))
                for c in np.unique(at[at >= 0]):
                    mine = x[at == c]
                    sums = [int(y) for y in mine.sum(0)] if small else [sum(int(y) for y in col) for col in mine.T.tolist()]
                    old = total.setdefault(int(c), [0] * (dim + 1))
                    total[int(c)] = [o + sign * y for o, y in zip(old, [len(mine), *sums], strict=True)]
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([",".join(map(str, y)) for y in total.values()])], names=["c", "x"])

    def add(table: pa.Table) -> pa.Table:
        sums = [0] * (dim + 1)
        for x in table.column("x").to_pylist():
            sums = [s + int(y) for s, y in zip(sums, x.split(","), strict=True)]
        return pa.table({"c": table.column("c").slice(0, 1), "x": pa.array([",".join(map(str, sums))])})

    moved = state.where("was is null or was != cluster").select("was", "cluster", "v")
    got = moved.mapInArrow(part, "c int, x string").groupBy("c").applyInArrow(add, "c int, x string").toArrow()
    return {c: [int(y) for y in x.split(",")] for c, x in zip(got.column("c").to_pylist(), got.column("x").to_pylist(), strict=True)}


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = K, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE) -> tuple[DataFrame, list[list[int]]]:
    """``(key, cluster, distance, scans)`` of every kept vector and the final centroids; ``scans``: distances formed in the last pass."""
    kept = whole(df, key, vector, dim, scale)
    centroids = seeds(kept, k, seed)
    if not centroids:
        kind = dict(kept.dtypes)["key"]
        return kept.sparkSession.createDataFrame([], f"`{key}` {kind}, cluster int, distance bigint, scans int"), []
    totals = [[0] * (dim + 1) for _ in centroids]
    most, least = max(1, len(centroids) // 4), max(1, len(centroids) // 8)
    bounds, state, old = Bounds(centroids, None, most), kept, None
    for turn in range(rounds):
        state, old = cut(assign(state, bounds, dim, turn == 0), "drake"), state if turn else None
        discard(old)
        for c, gain in changes(state, dim).items():
            totals[c] = [x + y for x, y in zip(totals[c], gain, strict=True)]
        fresh = [[s // t[0] for s in t[1:]] if t[0] else row for t, row in zip(totals, bounds.centroids, strict=True)]
        moved = np.array([float(sum((p - q) ** 2 for p, q in zip(x, y, strict=True))) ** 0.5 for x, y in zip(fresh, bounds.centroids, strict=True)]) * (1 + SLACK)
        used = state.agg(F.max("used")).first()[0] or 0
        bounds = Bounds(fresh, moved, max(least, min(bounds.keep, used)))
    out = cut(assign(state, bounds, dim, rounds == 0).select(F.col("key").alias(key), "cluster", "distance", "scans"), "clusters")
    if rounds:
        discard(state)
    return out, bounds.centroids


def digest(df: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """``(key, cluster, distance, cluster_inertia, inertia, centroid_sha256)``."""
    got, centroids = cluster(df, key, **options)
    spark = df.sparkSession
    sums = {r.cluster: int(r.s) for r in got.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    whole_sum = min(sum(sums.values()), LONGEST)
    rows = [(c, min(s, LONGEST), whole_sum, hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return got.join(F.broadcast(table), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
