"""Landmark sampling: all rows, a hashed random sample, farthest points, farthest points of refined embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import remove, written
from ..sources.tables import matrix

METHODS = ("full", "random", "fps", "fps_recursive")
#: Farthest rows that a task gives in a pass, at most; those of all tasks together, about; chosen points after which distances are written.
POOL, POOLED, KEEP = 1024, 100_000, 256


@dataclass(frozen=True)
class SampleConfig:
    method: str = "full"
    num_sample: int = 10_000
    fps_dim: int = 12
    n_iter: int | None = None
    seed: int = 42

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown sampling method: {self.method}")
        if self.method == "fps_recursive" and self.n_iter is None:
            raise ValueError("fps_recursive needs n_iter")


def random_sample(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``(id)`` of n rows: finite ones first, in the order of a hash of seed and id (whatever the partitions)."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    return df.select("id", vec.finite("v").alias("ok"), key.alias("h")).orderBy(F.desc("ok"), "h", "id").limit(n).select("id")


def farthest(x: np.ndarray, n: int) -> np.ndarray:
    """Greedy farthest points from the first row on: each next row is the farthest from those chosen, first on ties."""
    n = min(n, len(x))
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.zeros(n, np.int64)
    near = ((x - x[0]) ** 2).sum(1)
    near[0] = -1
    for k in range(1, n):
        i = out[k] = int(np.argmax(near))
        near = np.minimum(near, ((x - x[i]) ** 2).sum(1))
        near[i] = -1
    return out


def principal(df: DataFrame, dim: int, vector: str = "v") -> DataFrame:
    """Rows projected on their ``dim`` leading directions: a partial aggregate of moments (a few passes for wide vectors), one projection."""
    from .knn import listed
    from .linalg import leading

    mean, axes, _ = leading(df, dim, vector)
    shared = df.sparkSession.sparkContext.broadcast((mean, axes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, a = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), listed((matrix(b.column(1), len(m)) - m) @ a)], names=["id", "v"])

    return df.select("id", vector).mapInArrow(run, "id bigint, v array<double>")


def fps(df: DataFrame, distance: str, n: int, dim: int = 12, pool: int = POOL, keep: int = KEEP) -> DataFrame:
    """``(id)`` of n farthest points among the finite rows, in at most ``dim`` directions: the exact greedy choice at any size.

    Distances to the chosen points only fall, so a row's last known distance is a bound. In a pass each task evaluates the rows whose bound may be
    among its ``pool`` farthest, gives these and the last of them as an edge; all its other rows come after that edge. The driver chooses among what the
    tasks gave, farthest first, smaller id first, as long as the choice comes before every task's edge; then the next pass learns of the new points.
    After ``keep`` points the rows are written with their distances. The choice doesn't depend on partitions.
    """
    rows = df.select("id", vec.to_euclidean("v", distance).alias("v")).where(vec.finite("v"))
    first = rows.select(F.size("v")).first()
    if first is None or n < 1:
        return df.select("id").limit(0)
    if first[0] > dim:
        rows = principal(rows, dim)
    held = written(rows.withColumn("near", F.lit(float("inf"))), "fps")
    seed = held.agg(F.min(F.struct("id", "v")).alias("s")).first().s
    ids, points, known = [seed.id], [np.array(seed.v)], 0
    each = max(16, min(pool, POOLED // max(1, held.rdd.getNumPartitions())))
    while len(ids) < n:
        if len(ids) - known > keep:
            fresh = written(_nearer(held, ids[known:], np.array(points[known:])), "fps")
            remove(held)
            held, known = fresh, len(ids)
        more = _choices(held, ids[known:], np.array(points[known:]), each, n - len(ids))
        if not more:
            break
        ids += [i for i, _ in more]
        points += [x for _, x in more]
    remove(held)
    return df.sparkSession.createDataFrame(pa.table({"id": pa.array(sorted(ids), pa.int64())}))


def _evaluated(near: np.ndarray, x: np.ndarray, ids: np.ndarray, chosen: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances to the nearest of old and new points; -1 for the chosen rows."""
    for p in points:
        near = np.minimum(near, ((x - p) ** 2).sum(1))
    return np.where(np.isin(ids, chosen), -1.0, near)


def _nearer(held: DataFrame, ids: list[int], points: np.ndarray) -> DataFrame:
    """The rows with their distances up to date, chosen ones left out."""
    shared = held.sparkSession.sparkContext.broadcast((np.array(ids), points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, new = shared.value
        for b in batches:
            near = _evaluated(np.asarray(b.column(2)), matrix(b.column(1)), np.asarray(b.column(0)), chosen, new)
            rows = pa.array(np.nonzero(near >= 0)[0])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(near[near >= 0])], names=["id", "v", "near"])

    return held.mapInArrow(run, "id bigint, v array<double>, near double")


def _choices(held: DataFrame, ids: list[int], points: np.ndarray, pool: int, n: int) -> list[tuple[int, np.ndarray]]:
    """The next choices, at most n, that one pass can be sure of; none if no rows are left."""
    shared = held.sparkSession.sparkContext.broadcast((np.array(ids), points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, new = shared.value
        best, more = None, False
        for b in batches:
            names, bound = np.asarray(b.column(0)), np.asarray(b.column(2))
            order = np.argsort(-bound, kind="stable")
            for s in range(0, len(order), 4096):
                at = order[s : s + 4096]
                if best is not None and len(best[0]) == pool:
                    at = at[bound[at] >= best[1][-1]]  # the others cannot come before the pool's last
                    more |= len(at) < min(4096, len(order) - s)
                if not len(at):
                    break
                x = matrix(b.column(1).take(pa.array(at)))
                near = _evaluated(bound[at], x, names[at], chosen, new)
                good = near >= 0
                got = (names[at][good], near[good], x[good])
                best = got if best is None else tuple(np.concatenate(z) for z in zip(best, got, strict=True))
                rank = np.lexsort((best[0], -best[1]))
                more |= len(rank) > pool
                best = tuple(z[rank[:pool]] for z in best)
        if best is not None and len(best[0]):
            from .knn import listed

            last = np.zeros(len(best[0]), bool)
            last[-1] = more
            yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[1]), listed(best[2]), pa.array(last)], names=["id", "near", "v", "edge"])

    got = held.mapInArrow(run, "id bigint, near double, v array<double>, edge boolean").toArrow()  # the pools: bounded by POOLED
    if not got.num_rows:
        return []
    names, near, x, edge = np.asarray(got.column(0)), got.column(1).to_numpy().copy(), matrix(got.column(2)), got.column(3).to_numpy(zero_copy_only=False)
    # The first of the edges, farthest first: what comes before it comes before all rows that no task gave.
    edges = sorted((-near[i], names[i]) for i in np.nonzero(edge)[0])
    out: list[tuple[int, np.ndarray]] = []
    while len(out) < n:
        top = near.max(initial=-1.0)
        if top < 0:
            break
        at = np.nonzero(near == top)[0]
        i = at[np.argmin(names[at])]
        if edges and (-top, names[i]) > edges[0]:
            break
        out.append((int(names[i]), x[i]))
        near = np.where(near < 0, near, np.minimum(near, ((x - x[i]) ** 2).sum(1)))
        near[i] = -1.0
    return out


def subsample(df: DataFrame, distance: str = "cosine", config: SampleConfig = SampleConfig()) -> DataFrame:
    """``(id)`` of the sample; all rows if the sample is as large as the table."""
    if config.method == "full":
        return df.select("id")
    if config.num_sample >= df.count():
        return df.select("id")
    if config.method == "random":
        return random_sample(df, config.num_sample, config.seed)
    if config.method == "fps":
        return fps(df, distance, config.num_sample, config.fps_dim)
    from ..plans.nystrom import NystromNCut

    ids = fps(df, distance, config.num_sample, config.fps_dim)
    for _ in range(config.n_iter):
        model = NystromNCut(n_components=config.fps_dim, affinity_type="cosine" if distance == "cosine" else "rbf")
        emb = model.fit_transform(df, sample_ids=ids).select("id", F.slice("ev", 1, config.fps_dim).alias("v"))
        ids = fps(emb, "cosine", config.num_sample, config.fps_dim)
    return ids
