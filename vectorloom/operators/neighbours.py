"""Exact nearest neighbours among anchors of any number: a join of cells.

Anchors are dealt to cells by their nearest pivot (pivots are a hashed sample of bounded size) and, within a cell, by their distance to it, to
blocks of ``BLOCK`` rows; so a block is a ring of a cell, and a crowded cell many blocks. On the driver and in a
broadcast lie only pivots and a few numbers for each block.

A query first meets the blocks that seem nearest, as few as hold k anchors. The k-th distance found there bounds the
true one; by the triangle inequality it rules out every block whose ring is further off, and the query meets all others.
Nothing is approximate: where rings rule out little, as with random vectors of many dimensions, more blocks are met, not fewer neighbours found.

Both meetings are joins (``paired``). The first is by block: how many queries a block gets is estimated from a bounded sample of them, and
a block with many is dealt to several tasks; the estimate concerns their balance, not what is found. The second is by region, a run of
blocks: a query goes once to each region with a block that isn't ruled out, however many these are, and there meets these blocks alone. Regions
are few as the pieces of ``tiles`` are, so what moves grows with the tables, not with the number of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import remove, written
from ..sources.tables import matrix, to_numpy
from .affinity import CELLS, sliced
from .paired import Side, first_of, paired

#: Anchors of a block; pivots at most; queries of a block that one task takes; queries whose ways are looked at to deal blocks out.
BLOCK, PIVOTS, QUERIES, SAMPLED = 8192, 4096, 1 << 16, 10_000
#: Digits of a squared distance that count: equal ones must not differ by the order of a sum.
DIGITS = 10
#: Anchors of a region, and queries that one task of the second meeting takes, at most.
REGION = 1 << 17
#: Queries and anchors whose products are held at once; anchors of one product, which is to stay near the core; anchors of which the least is taken.
HIGH, WIDE, TILE, GROUP = 1024, 2048, 512, 32


@dataclass
class Rings:
    """What tasks know of the anchors: pivots and, for each block, its cell, its rows and the least and greatest distance to the pivot."""

    pivots: np.ndarray
    block: np.ndarray
    cell: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    most: np.ndarray
    k: int

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances to the pivots of each row."""
        return np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * x @ self.pivots.T))

    def first(self, x: np.ndarray) -> np.ndarray:
        """Blocks that each row meets first: those that seem nearest, as few as hold k rows."""
        d = self.far(x)[:, self.cell]
        seem = np.maximum(0, np.maximum(d - self.most, self.least - d)) + 1e-3 * d
        # So many blocks hold k rows, whichever they are.
        few = min(len(self.rows), int(np.searchsorted(np.cumsum(np.sort(self.rows)), self.k)) + 1)
        near = np.argpartition(seem, few - 1, axis=1)[:, :few]
        order = np.take_along_axis(near, np.argsort(np.take_along_axis(seem, near, 1), axis=1, kind="stable"), 1)
        # A block is met while the ones before it hold fewer than k rows.
        before = np.cumsum(self.rows[order], 1) - self.rows[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, before < self.k, 1)
        return out

    def limit(self, x: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """Squared distances up to which an anchor may be within the edge (n x 1) of each row, however its products were rounded."""
        reach = np.sqrt((self.pivots**2).sum(1).max()) + self.most.max() + np.sqrt((x**2).sum(1, keepdims=True))
        return edge * (1 + 1e-9) + 1e-9 + 1e-15 * (x.shape[1] + 8) * reach**2

    def open(self, x: np.ndarray, edge: np.ndarray, some: slice = slice(None)) -> np.ndarray:
        """Which blocks, of some, may hold an anchor within the edge of each row."""
        d = self.far(x)[:, self.cell[some]]
        return np.maximum(0, np.maximum(d - self.most[some], self.least[some] - d)) ** 2 <= self.limit(x, edge)


def placed(df: DataFrame, kind: str, anchors: bool) -> DataFrame:
    """``(id, v)`` of the finite rows in the Euclidean geometry of the affinity.

    Zero vectors have cosine 0 to all others: they get a coordinate of their own, one for anchors and another for queries.
    """
    v: Column = F.col("v")
    if kind == "cosine":
        zero = vec.norm("v") <= vec.EPS
        own = F.array(F.lit(1.0), F.lit(0.0)) if anchors else F.array(F.lit(0.0), F.lit(1.0))
        v = F.concat(vec.normalized("v"), F.when(zero, own).otherwise(F.array(F.lit(0.0), F.lit(0.0))))
    elif kind != "rbf":
        raise ValueError(f"unknown affinity: {kind}")
    return df.where(vec.finite("v")).select("id", v.alias("v"))


def hashed(df: DataFrame, n: int) -> DataFrame:
    return df.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n)


def ringed(anchors: DataFrame, block: int) -> tuple[DataFrame, np.ndarray]:
    """``(p, id, v)``, written: the anchors with the number of their block, and the pivots."""
    spark = anchors.sparkSession
    n = anchors.count()
    _, pivots = to_numpy(hashed(anchors, max(1, min(PIVOTS, -(-n // block)))), PIVOTS)
    shared = spark.sparkContext.broadcast(pivots)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in sliced(batches, len(c)):
            x = matrix(b.column(1), c.shape[1])
            cell = np.argmin((c**2).sum(1) - 2 * x @ c.T, 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.sqrt(((x - c[cell]) ** 2).sum(1))), b.column(0), b.column(1)], names=["cell", "r", "id", "v"])

    dealt = anchors.mapInArrow(to_cells, "cell bigint, r double, id bigint, v array<double>")
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // block)))
    ranged = dealt.repartitionByRange(parts, "cell", "r", "id").sortWithinPartitions("cell", "r", "id")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, at = None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            out = np.empty(b.num_rows, np.int64)
            for i, c in enumerate(np.asarray(b.column(0)).tolist()):
                if c != last or held == block:
                    last, held, at = c, 0, at + 1
                held += 1
                out[i] = at
            yield pa.RecordBatch.from_arrays([pa.array(out), *b.columns], names=["p", "cell", "r", "id", "v"])

    return written(ranged.mapInArrow(number, "p bigint, cell bigint, r double, id bigint, v array<double>"), "rings"), pivots


def nearest_of_many(anchors: DataFrame, queries: DataFrame, k: int, kind: str = "cosine", block: int = BLOCK, most: int = QUERIES, region: int = REGION) -> DataFrame:
    """``(id, anchor_id, d2, rank)``, written: the k anchors of least squared distance to each finite query, equal ones by anchor id.

    Distances are those of normalised vectors for "cosine" (two minus twice the cosine), of the vectors as they are for "rbf".
    Missing anchors and queries take no part. Fewer than k anchors give as many rows.
    """
    there = written(placed(anchors, kind, True), "anchors")
    rings, pivots = ringed(there, block)
    remove(there)
    asked = written(placed(queries, kind, False), "queries")
    stats = rings.groupBy("p").agg(F.first("cell").alias("cell"), F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).toArrow().sort_by("p")
    p, cell, rows, lo, hi = (stats.column(c).to_numpy() for c in ("p", "cell", "n", "lo", "hi"))
    if not len(p):
        return asked.sparkSession.createDataFrame([], "id bigint, anchor_id bigint, d2 double, rank bigint")
    slack = 1e-9 * (1 + np.abs(hi).max())
    known = Rings(pivots, p, cell, rows, lo - slack, hi + slack, k)
    total = asked.count()
    first = first_of(_met(rings, asked, known, total, most), "id", ["d2", "anchor_id"], k)
    edge = first.groupBy("id").agg(F.max("d2").alias("d2"), F.count("*").alias("n"))
    edged = asked.join(edge, "id", "left").select("id", "v", F.array(F.when(F.col("n") >= k, F.col("d2")).otherwise(F.lit(float("inf")))).alias("a"))
    open_ = written(edged, "edges")
    out = written(first_of(_all_met(rings, open_, known, total, region), "id", ["d2", "anchor_id"], k), "nearest")
    for table in (open_, asked, rings):
        remove(table)
    return out


def _met(rings: DataFrame, queries: DataFrame, known: Rings, total: int, most: int) -> DataFrame:
    """``(id, anchor_id, d2)``: up to k candidates of each query from each block it meets first."""
    spark = queries.sparkSession
    shared, k = spark.sparkContext.broadcast(known), known.k

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for b in sliced(batches, 4 * len(now.block)):
            i, j = np.nonzero(now.first(matrix(b.column(1), now.pivots.shape[1])))
            at = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(now.block[j]), b.column(0).take(at), b.column(1).take(at)], names=["p", "id", "v"])

    schema = "p bigint, id bigint, v array<double>"
    some = hashed(queries, SAMPLED)
    counts = {r.p: r.n for r in some.mapInArrow(send, schema).groupBy("p").agg(F.count("*").alias("n")).collect()}  # at most a row for each block
    scale = total / max(1, min(total, SAMPLED))
    many = [(int(p), max(1, -(-int(counts.get(p, 0) * scale) // most))) for p in known.block.tolist()]
    split = F.broadcast(spark.createDataFrame([x for x in many if x[1] > 1], "p bigint, s int"))
    times, none = F.coalesce("s", F.lit(1)), F.array(F.lit(0.0)).alias("a")
    held = rings.join(split, "p", "left").select("p", F.explode(F.sequence(F.lit(0).cast("bigint"), (times - 1).cast("bigint"))).alias("q"), "id", "v", none)
    sent = queries.mapInArrow(send, schema).join(split, "p", "left").select("p", F.pmod(F.xxhash64("id"), times).cast("bigint").alias("q"), "id", "v", none)

    def meet(p: int, q: int, anchors: Side, rows: Side) -> pa.RecordBatch:
        ids, x = anchors[:2]
        if len(ids) <= 2 * GROUP * k:
            found, at, far = _ranked(ids, x, rows[1], k)
            row = np.repeat(np.arange(len(at)), at.shape[1])
        else:
            row, found, far = _nearest(ids, x, rows[1], np.full(len(rows[0]), np.inf), shared.value, lambda *_: np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(rows[0][row]), pa.array(found.reshape(-1)), pa.array(far.reshape(-1))], names=["id", "anchor_id", "d2"])

    return paired(held, sent, meet, "id bigint, anchor_id bigint, d2 double", None, None, CELLS << 4)


def _ranked(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, places, squared distances), rows x k: the nearest of anchors that are sorted by id."""
    from .knn import largest

    far = np.round(np.maximum(0, (rows**2).sum(1)[:, None] + (x**2).sum(1) - 2 * rows @ x.T), DIGITS)
    at = largest(-far, min(k, len(ids)))
    return ids[at], at, np.take_along_axis(far, at, 1)


def _all_met(rings: DataFrame, queries: DataFrame, known: Rings, total: int, region: int) -> DataFrame:
    """``(id, anchor_id, d2)``: up to k candidates of each query ``(id, v, a)``, a its edge, from each region with a block that the edge doesn't rule out."""
    from .tiles import dealt, each, pieces

    spark = queries.sparkSession
    n = int(known.rows.sum())
    share = -(-n // pieces(rings, n, region, region))
    begun = (np.cumsum(known.rows) - known.rows) // share
    starts = np.nonzero(np.append(True, np.diff(begun) != 0))[0]  # of the regions among the blocks
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(begun))))
    stripes = pieces(queries, total, region, region)
    shared = spark.sparkContext.broadcast((known, starts))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first = shared.value
        for b in sliced(batches, 4 * len(now.block)):
            x = matrix(b.column(1), now.pivots.shape[1])
            i, j = np.nonzero(np.logical_or.reduceat(now.open(x, matrix(b.column(2), 1)), first, axis=1))
            home = np.argmin((now.pivots**2).sum(1) - 2 * x @ now.pivots.T, 1)
            for s in range(0, len(i), 1 << 14):
                at = pa.array(i[s : s + (1 << 14)])
                yield pa.RecordBatch.from_arrays([pa.array(j[s : s + (1 << 14)]), pa.array(home[at.to_numpy()]), *(b.column(c).take(at) for c in range(3))], names=["p", "o", "id", "v", "a"])

    place = spark.createDataFrame(pa.table({"p": pa.array(known.block), "g": pa.array(of), "o": pa.array(np.arange(len(of)))}))
    held = rings.join(F.broadcast(place), "p").select(F.col("g").alias("p"), each(stripes).alias("q"), "id", "v", F.array(F.col("o").cast("double")).alias("a"), "o")
    sent = queries.mapInArrow(send, "p bigint, o bigint, id bigint, v array<double>, a array<double>").select("p", dealt(stripes).alias("q"), "id", "v", "a", "o")

    def meet(p: int, q: int, anchors: Side, rows: Side) -> pa.RecordBatch:
        ids, found, far = _in_region(anchors, rows, shared.value[0])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found), pa.array(far)], names=["id", "anchor_id", "d2"])

    # Queries of a cell come together, so that a tile of them leaves out what none of them needs; anchors by block.
    return paired(held, sent, meet, "id bigint, anchor_id bigint, d2 double", len(starts) * stripes, (F.col("p") * stripes + F.col("q")).cast("int"), 1 << 31, "o")


def _in_region(anchors: Side, rows: Side, known: Rings) -> Side:
    """(ids, anchors, squared distances): for each row its k best, at most, among the anchors of the blocks that its edge doesn't rule out."""
    o = anchors[2][:, 0].astype(np.int64)
    lo = int(o[0])
    bounds = np.searchsorted(o, np.arange(lo, int(o[-1]) + 2))  # of the blocks among the anchors

    def needed(y: np.ndarray, edge: np.ndarray) -> np.ndarray:
        need = known.open(y, edge[:, None], slice(lo, lo + len(bounds) - 1)).any(0)
        return np.concatenate([np.arange(bounds[b], bounds[b + 1]) for b in np.nonzero(need)[0]] or [np.zeros(0, np.int64)])

    row, name, far = _nearest(anchors[0], anchors[1], rows[1], rows[2][:, 0], known, needed)
    return rows[0][row], name, far


def _nearest(ids: np.ndarray, x: np.ndarray, rows: np.ndarray, edges: np.ndarray, known: Rings, needed: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Side:
    """(places of rows, ids, squared distances): for each row its k best, at most, within its edge among the anchors that are ``needed(some rows, their edges)``.

    Products are taken in single precision first, if its error is small beside the edges; what they don't rule out is decided in double precision.
    All pairs cost a product and the least of a group; only groups whose least is within the edge are looked at again. The k-th of these least ones
    bounds the k-th distance, so an edge that tells nothing yet is drawn in at once.
    """
    k, square = known.k, (x**2).sum(1)
    reach = float(np.sqrt(square.max(initial=0)) + np.sqrt((rows**2).sum(1).max(initial=0))) ** 2
    usual = np.median(edges) if len(edges) else 0.0
    if usual == np.inf:
        usual = np.median(_ranked(ids[:WIDE], x[:WIDE], rows[:: -(-len(rows) // 16)], k)[2][:, -1])
    kind = np.float32 if np.isfinite(reach) and reach < 1e30 and 1e-6 * (x.shape[1] + 8) * reach <= 0.1 * usual < np.inf else np.float64
    margin = 2.0 * float(np.finfo(kind).eps) * (x.shape[1] + 8) * reach
    some = x.any(0) & rows.any(0)
    right = np.empty((len(x), int(some.sum()) + 1), kind)
    right[:, :-1], right[:, -1] = x[:, some], square
    flat = np.empty((min(WIDE, len(x)) + GROUP) * min(HIGH, len(rows)), kind)
    out = []
    for s in range(0, len(rows), HIGH):
        y, edge = rows[s : s + HIGH], edges[s : s + HIGH].copy()
        n, own, use = len(y), (y**2).sum(1), needed(y, edge)
        left = np.concatenate([-2 * y[:, some], np.ones((n, 1))], 1).astype(kind).T
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        seen = merged = 0
        while seen < len(use):
            at = use[seen : seen + WIDE]
            seen += len(at)
            groups = -(-len(at) // GROUP)
            p, least = flat[: groups * GROUP * n].reshape(groups * GROUP, n), np.empty((groups, n), kind)
            p[len(at) :] = np.inf
            run = right[at[0] : at[-1] + 1] if at[-1] - at[0] < len(at) else right[at]
            for t in range(0, len(at), TILE):
                np.matmul(run[t : t + TILE], left, out=p[t : min(t + TILE, len(at))])
                p[t : t + TILE].reshape(-1, GROUP, n).min(1, out=least[t // GROUP : (t + TILE) // GROUP])

            def limits() -> np.ndarray:
                return np.minimum(known.limit(y, edge[:, None])[:, 0] - own + margin, np.finfo(kind).max).astype(kind)  # noqa: B023

            limit = limits()
            near = least <= limit
            loose = np.nonzero(near.sum(0) > 2 * k)[0] if groups > k else []
            if len(loose):
                kth = np.partition(least[:, loose], k - 1, axis=0)[k - 1].astype(float)
                edge[loose] = np.minimum(edge[loose], np.maximum(0, kth + own[loose] + margin))
                limit = limits()
                near = least <= limit
            # Rows with many candidates, as where vectors are equal, are ranked among all these anchors.
            heavy = near.sum(0) > 4 * k if np.isfinite(reach) else np.ones(n, bool)
            g, i = np.divmod(np.flatnonzero(near & ~heavy), n)
            cell, j = np.nonzero(p.reshape(groups, GROUP, n)[g, :, i] <= limit[i, None])
            i, j = i[cell], g[cell] * GROUP + j
            heavy |= np.bincount(i, minlength=n) > 4 * k
            if heavy.any():
                i, j = i[~heavy[i]], j[~heavy[i]]
                which, by_id = np.nonzero(heavy)[0], at[np.argsort(ids[at], kind="stable")]
                step = max(64, (1 << 19) // len(at))
                for h in range(0, len(which), step):
                    got, _, d = _ranked(ids[by_id], x[by_id], y[which[h : h + step]], k)
                    found.append((np.repeat(which[h : h + step], got.shape[1]), got.reshape(-1), d.reshape(-1)))
            d = np.round(np.maximum(0, own[i] + square[at[j]] - 2 * np.einsum("ij,ij->i", y[i], x[at[j]])), DIGITS)
            found.append((i, ids[at[j]], d))
            # What was found draws the edges in whenever twice as much has been seen, or much has been found.
            if seen >= min(len(use), 2 * merged) or sum(len(f[0]) for f in found) > 8 * k * n:
                row, name, far = (np.concatenate(z) for z in zip(*found, strict=True))
                good = far <= known.limit(y, edge[:, None])[row, 0]
                row, name, far = row[good], name[good], far[good]
                order = np.lexsort((name, far, row))
                row, name, far = row[order], name[order], far[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                last = place == k - 1
                edge[row[last]] = np.minimum(edge[row[last]], far[last])
                found, merged = [(row[place < k], name[place < k], far[place < k])], seen
        out.append((found[0][0] + s, *found[0][1:]))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
