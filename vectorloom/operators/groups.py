"""Many graphs in one table, of any size: one set of passes for all large groups.

Groups of up to ``LARGE`` rows share tasks, a group to a call. The others, of which there can be no more than rows / ``LARGE``, are numbered; their rows are
written once, and every pass goes over the rows of a run of groups whose models (bounded by ``BYTES``) are broadcast: each task adds up
what its rows give to their groups, and sums meet by group and position. So a large group is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from ..sources.tables import matrix
from .linalg import PIECE

#: Rows up to which a group is one call; bytes of models that are broadcast at once.
LARGE, BYTES = 4096, 64 << 20

Model = object
Kernel = Callable[[Model, np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Large:
    """``rows (k, id, v, o)``, written; ``keys (group, k)``; the rows of each k; the group column's name. ``o``: the hash that orders ids."""

    rows: DataFrame
    keys: DataFrame
    n: list[int]
    group: str

    def runs(self, size: int) -> Iterator[tuple[range, DataFrame]]:
        """Runs of groups whose models of ``size`` bytes each fit in a broadcast, and their rows."""
        step = max(1, BYTES // max(1, size))
        for lo in range(0, len(self.n), step):
            ks = range(lo, min(lo + step, len(self.n)))
            yield ks, self.rows.where(F.col("k").between(ks[0], ks[-1]))

    def named(self, out: DataFrame, *columns: str) -> DataFrame:
        """``out`` with the group's value for its number."""
        return out.join(F.broadcast(self.keys), "k").select(self.group, *columns)


def parted(df: DataFrame, group: str, vector: str = "v", large: int = LARGE, seed: int = 42) -> tuple[DataFrame, Large | None]:
    """The rows of groups of up to ``large`` rows, and the others; None if there are none."""
    spark = df.sparkSession
    found = df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > large).orderBy(group).toArrow()
    if not found.num_rows:
        return df, None
    keys = spark.createDataFrame(found.drop_columns(["n"]).append_column("k", pa.array(np.arange(found.num_rows), pa.int64())), f"{group} {dict(df.dtypes)[group]}, k bigint")
    same = lambda d: d[group].eqNullSafe(F.col("__group"))
    told = F.broadcast(keys.withColumnRenamed(group, "__group"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))
    rows = written(df.join(told, same(df)).select("k", "id", F.col(vector).alias("v"), order.alias("o")), "groups")
    return df.join(told, same(df), "left_anti"), Large(rows, keys, found.column("n").to_pylist(), group)


def _by_group(batch: pa.RecordBatch, models: dict, step: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, ids, matrix) of a batch's rows by group, ``step`` at most at once."""
    k = np.asarray(batch.column(0))
    order = np.argsort(k, kind="stable")
    at, first = np.unique(k[order], return_index=True)
    for g, rows in zip(at.tolist(), np.split(order, first[1:]), strict=True):
        if g in models:
            for s in range(0, len(rows), step):
                part = batch.take(pa.array(rows[s : s + step]))
                yield g, np.asarray(part.column(1)), matrix(part.column(2))


def sums(rows: DataFrame, models: dict[int, Model], kernel: Kernel, step: int = 4096) -> dict[int, np.ndarray]:
    """For each group with a model: the sum over its rows of ``kernel(model, ids, x)``."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for g, ids, x in _by_group(batch, shared.value, step):
                part = np.asarray(kernel(shared.value[g], ids, x), float).reshape(-1)
                total[g] = total[g] + part if g in total else part
        for g, x in total.items():
            cuts = range(0, len(x), PIECE)
            yield pa.RecordBatch.from_arrays([pa.array([g] * len(cuts), pa.int64()), pa.array(list(cuts), pa.int64()), pa.array([x[c : c + PIECE].tobytes() for c in cuts], pa.binary())], names=["k", "pos", "x"])

    def add(table: pa.Table) -> pa.Table:
        """Parts of one piece: one for each task at most."""
        whole = sum(np.frombuffer(x) for x in table.column("x").to_pylist())
        return pa.table({"k": table.column("k").slice(0, 1), "pos": table.column("pos").slice(0, 1), "x": pa.array([whole.tobytes()], pa.binary())})

    schema = "k bigint, pos bigint, x binary"
    got = rows.select("k", "id", "v").mapInArrow(run, schema).groupBy("k", "pos").applyInArrow(add, schema).toArrow().sort_by([("k", "ascending"), ("pos", "ascending")])
    out: dict[int, list] = {}
    for k, x in zip(got.column("k").to_pylist(), got.column("x").to_pylist(), strict=True):
        out.setdefault(k, []).append(np.frombuffer(x))
    return {k: np.concatenate(x) for k, x in out.items()}


def mapped(rows: DataFrame, models: dict[int, Model], kernel: Kernel, step: int = 4096) -> DataFrame:
    """``(k, id, y)``: ``kernel(model, ids, x)`` of the rows of groups with a model, a row each."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .knn import listed

        for batch in batches:
            for g, ids, x in _by_group(batch, shared.value, step):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), g, np.int64)), pa.array(ids), listed(kernel(shared.value[g], ids, x))], names=["k", "id", "y"])

    return rows.select("k", "id", "v").mapInArrow(run, "k bigint, id bigint, y array<double>")


def least(rows: DataFrame, models: dict[int, Model], kernel: Kernel, step: int = 4096) -> dict[int, np.ndarray]:
    """For each group: the vector of the finite row for which the kernel's value is least, the smaller id among equals."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .knn import listed

        best: dict[int, tuple] = {}
        for batch in batches:
            for g, ids, x in _by_group(batch, shared.value, step):
                value = np.where(np.isfinite(x).all(1), kernel(shared.value[g], ids, x), np.inf)
                i = np.lexsort((ids, value))[0]
                if np.isfinite(value[i]) and (g not in best or (value[i], ids[i]) < best[g][:2]):
                    best[g] = (value[i], ids[i], x[i])
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(list(best), pa.int64()), pa.array([b[0] for b in best.values()], pa.float64()), pa.array([b[1] for b in best.values()], pa.int64()), listed(np.stack([b[2] for b in best.values()]))], names=["k", "c", "id", "v"])

    got = rows.select("k", "id", "v").mapInArrow(run, "k bigint, c double, id bigint, v array<double>")
    return {r.k: np.array(r.b.v) for r in got.groupBy("k").agg(F.min(F.struct("c", "id", "v")).alias("b")).collect()}  # a row for each group of the run
