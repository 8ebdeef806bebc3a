"""Two tables of any size, side by side in pieces: one piece of the first is held by a task, rows of the second stream past it.

Both sides carry a key ``(p, q)``; how rows are dealt to keys is the caller's. They come together by one shuffle and one sort, so a task holds the rows
of one key's first side (bounded by the caller's dealing) and a batch of the second.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import matrix
from .affinity import CELLS

#: ids, vectors, extra columns
Side = tuple[np.ndarray, np.ndarray, np.ndarray]
COLUMNS = ["p", "q", "id", "v", "a"]


def paired(held: DataFrame, streamed: DataFrame, kernel: Callable[[int, int, Side, Side], pa.RecordBatch], schema: str, tasks: int | None = None, task: Column | None = None, cells: int = CELLS, order: str | None = None) -> DataFrame:
    """``kernel(p, q, held rows by id, streamed rows)`` for all slices of the rows that share a key.

    Keys go to tasks by a hash or, where ``tasks`` says how many there are, by the number ``task`` of theirs: a task each, none of which gets two while another has none.
    ``cells``: pairs that a call of the kernel gets at most. ``order``: a column of both tables by which rows of a key come; held ones then stay so instead of by id.
    Both tables are ``(p bigint, q bigint, id bigint, v array<double>, a array<double>)``. Keys with one side alone give nothing.
    """
    by = [order] if order else []
    both = held.select("p", "q", F.lit(0).alias("side"), "id", "v", "a", *by).unionByName(streamed.select("p", "q", F.lit(1).alias("side"), "id", "v", "a", *by))
    spread = both.repartition("p", "q") if task is None else both.withColumn("task", task).repartitionById(tasks, F.col("task")).drop("task")
    dealt = spread.sortWithinPartitions("p", "q", "side", *by, *(["id"] if order else [])).drop(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, block = None, [], None
        for batch in batches:
            p, q, side = (np.asarray(batch.column(c)) for c in range(3))
            edges = np.nonzero((np.diff(p) != 0) | (np.diff(q) != 0) | (np.diff(side) != 0))[0] + 1
            for lo, hi in zip([0, *edges], [*edges, len(p)], strict=True):
                if lo == hi:
                    continue
                if (p[lo], q[lo]) != now:
                    now, parts, block = (p[lo], q[lo]), [], None
                if side[lo] == 0:
                    parts.append(batch.slice(lo, hi - lo))
                    continue
                if block is None and parts:
                    block, parts = _side(pa.Table.from_batches(parts), not order), []
                if block is not None:
                    step = max(1, cells // len(block[0]))
                    for s in range(lo, hi, step):
                        yield kernel(int(p[lo]), int(q[lo]), block, _side(batch.slice(s, min(step, hi - s)), False))

    return dealt.mapInArrow(run, schema)


def _side(rows: pa.Table | pa.RecordBatch, by_id: bool) -> Side:
    ids, v, a = np.asarray(rows.column(3)), matrix(rows.column(4)), matrix(rows.column(5))
    if by_id:
        order = np.argsort(ids, kind="stable")
        ids, v, a = ids[order], v[order], a[order]
    return ids, v, a


def first_of(rows: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first k rows of every value of ``by`` with their ``rank``: a sorted stream, no group is held."""
    dealt = rows.repartition(by).sortWithinPartitions(by, *order)
    names = [*rows.columns, "rank"]
    at = rows.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, 0
        for batch in batches:
            key = np.asarray(batch.column(at))
            if not len(key):
                continue
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            rank = np.arange(len(key)) - np.repeat(starts, np.diff(np.append(starts, len(key)))) + 1
            if key[0] == last:
                first = starts[1] if len(starts) > 1 else len(key)
                rank[:first] += seen
            last, seen = key[-1], int(rank[-1])
            keep = np.nonzero(rank <= k)[0]
            if len(keep):
                got = batch.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(rank[keep])], names=names)

    kinds = dict(rows.dtypes)
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", rank bigint")


def added(rows: DataFrame, by: str = "id", vector: str = "y", order: str = "q") -> DataFrame:
    """``(by, vector)``: sums of the vectors of each value of ``by``, in the order of ``order``: a sorted stream."""
    dealt = rows.select(by, order, vector).repartition(by).sortWithinPartitions(by, order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .knn import listed

        last, total = None, None
        for batch in batches:
            key, y = np.asarray(batch.column(0)), matrix(batch.column(2))
            if not len(key):
                continue
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            sums, ids = np.add.reduceat(y, starts, axis=0), key[starts]
            if last is not None:
                if ids[0] == last:
                    sums[0] += total
                else:
                    yield pa.RecordBatch.from_arrays([pa.array([last]), listed(total[None])], names=[by, vector])
            if len(ids) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(ids[:-1]), listed(sums[:-1])], names=[by, vector])
            last, total = ids[-1], sums[-1]
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), listed(total[None])], names=[by, vector])

    return dealt.mapInArrow(run, f"{by} bigint, {vector} array<double>")
