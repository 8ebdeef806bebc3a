"""Eigenpairs of a symmetric operator over vectors of any length: bases are tables ``(id, x)``, the driver holds matrices of their width alone.

``apply`` maps a table ``(id, x)`` to ``(id, y)`` with y = A x, a column of arrays each. Bases become orthonormal by their Gram matrix, twice (the second time repairs
what the first leaves of rounding); directions that depend on others are dropped. Every step's table is written once to the shared folder and the last one deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, written
from ..sources.tables import matrix
from . import linalg
from .knn import listed

Apply = Callable[[DataFrame], DataFrame]
#: Squared length, relative to the longest, below which a direction of a basis is dropped.
DEPENDENT = 1e-13


def times(df: DataFrame, m: np.ndarray, vector: str = "x", out: str = "x") -> DataFrame:
    """``(id, out)``: every row's vector times a small matrix."""
    shared = df.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), listed(matrix(b.column(1), m.shape[0]) @ shared.value)], names=["id", out])

    return df.select("id", vector).mapInArrow(run, f"id bigint, {out} array<double>")


def orthonormal(df: DataFrame, vector: str = "x", twice: bool = True) -> DataFrame:
    """``(id, x)``, written: an orthonormal basis of the span of the columns, those that depend on others left out. Nearly orthonormal, if not ``twice``."""
    now = written(df.select("id", F.col(vector).alias("x")), "basis")
    g = linalg.gram(now, "x")
    size = np.sqrt(np.maximum(np.diag(g), 1e-300))
    w, u = np.linalg.eigh(g / np.outer(size, size))
    use = w > DEPENDENT * w[-1]
    once = written(times(now, (u[:, use] / np.sqrt(w[use])) / size[:, None]), "basis")
    remove(now)
    if not twice:
        return once
    # Once more: lengths lost to rounding in the first step come back.
    w, u = np.linalg.eigh(linalg.gram(once, "x"))
    use = w > 1e-6
    out = written(times(once, u[:, use] / np.sqrt(w[use])), "basis")
    remove(once)
    return out


def start(ids: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """``(id, x)``: normal draws by a hash of seed, id and place, whatever the partitions."""

    def uniform(j: Column, which: int) -> Column:
        return (F.pmod(F.xxhash64(F.lit(seed), F.lit(which), "id", j), F.lit(1 << 53)) + 1) / float(1 << 53)

    draw = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.sqrt(-2 * F.log(uniform(j, 1))) * F.cos(2 * np.pi * uniform(j, 2)))
    return ids.select("id", draw.alias("x"))


def beside(*tables: DataFrame) -> DataFrame:
    """``(id, x)``: bases side by side."""
    out = tables[0].select("id", F.col("x").alias("x0"))
    for i, t in enumerate(tables[1:], 1):
        out = out.join(t.select("id", F.col("x").alias(f"x{i}")), "id")
    return out.select("id", F.concat(*(f"x{i}" for i in range(len(tables)))).alias("x"))


def _ritz(both: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values and coordinates of the leading pairs in the span of x, of ``(id, x, y)`` with y = A x, and the inverse of the Gram matrix of x, which is nearly orthonormal."""
    g = linalg.summed(both, ["x", "y"], lambda x, y: np.stack([x.T @ x, x.T @ y]))
    g = g.reshape(2, int(round((len(g) / 2) ** 0.5)), -1)
    e, u = np.linalg.eigh(g[0])
    root = u / np.sqrt(e)
    m = root.T @ g[1] @ root
    w, v = np.linalg.eigh((m + m.T) / 2)
    order = np.argsort(-np.abs(w), kind="stable")[:k]
    return w[order], root @ v[:, order], root @ root.T


def _residuals(both: DataFrame, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the residuals r = A x v - w x v, which are never stored: their Gram matrix and their products with x."""
    shared = both.sparkSession.sparkContext.broadcast((w, v))

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        w, v = shared.value
        r = y @ v - (x @ v) * w
        return np.concatenate([r.T @ r, x.T @ r])

    got = linalg.summed(both, ["x", "y"], kernel).reshape(-1, len(w))
    return got[: len(w)], got[len(w) :]


def _combined(both: DataFrame, p: np.ndarray, q: np.ndarray) -> DataFrame:
    """``(id, x)``: y p - x q of every row."""
    shared = both.sparkSession.sparkContext.broadcast((p, q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), listed(matrix(b.column(2), len(p)) @ p - matrix(b.column(1), len(q)) @ q)], names=["id", "x"])

    return both.select("id", "x", "y").mapInArrow(run, "id bigint, x array<double>")


def _solved(apply: Apply, ids: DataFrame, k: int, most: int, steps: int, seed: int, tolerance: float, late: bool, begin: DataFrame | None) -> tuple[np.ndarray, DataFrame, float]:
    """The k leading pairs from a basis that grows by a block a step: the residuals of the leading Ritz vectors that are not small yet, orthogonal to the basis.

    A x is kept beside x, so each column is multiplied by A once and never again. A basis of more than ``most`` blocks of the first one's width is drawn together to its leading Ritz
    vectors and, if ``late``, the directions in which they went last.
    """
    n = ids.count()
    k = min(k, n)
    width = min(n, 2 * k + 10)
    first = start(ids, width, seed)
    if begin is not None:  # as many columns of draws go as there are columns to begin with
        first = beside(begin, first).select("id", F.slice("x", 1, width).alias("x"))
    x = orthonormal(first)
    both, grown = written(x.join(apply(x).select("id", "y"), "id").select("id", "x", "y"), "basis"), 0
    remove(x)
    while True:
        w, v, inverse = _ritz(both, width)
        gram, cross = _residuals(both, w, v)
        size = np.sqrt(np.maximum(np.diag(gram), 0))
        least = tolerance * max(1e-300, float(np.abs(w).max()))
        off, steps = float(size[:k].max()) / max(1e-300, float(np.abs(w).max())), steps - 1
        use = np.nonzero(size[: k + 5] > 0.1 * least)[0]
        if off > tolerance and steps and len(use):
            # Coordinates that make the residuals orthonormal and orthogonal to the basis; the Gram matrix of the next step takes account of what rounding leaves.
            out = inverse @ (cross[:, use] / size[use])
            e, u = np.linalg.eigh(gram[np.ix_(use, use)] / np.outer(size[use], size[use]) - (cross[:, use] / size[use]).T @ out)
            t = u[:, e > 1e-10] / np.sqrt(e[e > 1e-10])
            t = t[:, max(0, t.shape[1] - (n - len(v))) :]
        else:
            t = np.zeros((0, 0))
        if not t.size:
            fresh = written(times(both, v[:, :k]), "ritz")
            remove(both)
            return w[:k], fresh, off
        p = (v[:, use] / size[use]) @ t
        block = written(_combined(both, p, (v[:, use] * w[use] / size[use]) @ t + out @ t), "block")
        old = both
        if len(v) + t.shape[1] > most * width:
            keep = v
            if late and grown:
                last = v.copy()
                last[: len(v) - grown] = 0
                last -= v @ (v.T @ np.linalg.solve(inverse, last))
                g = last.T @ np.linalg.solve(inverse, last)
                e, u = np.linalg.eigh((g + g.T) / 2)
                keep = np.concatenate([v, last @ (u[:, e > 1e-8] / np.sqrt(e[e > 1e-8]))], 1)
            both = times(both, keep).join(times(both.select("id", "y"), keep, "y", "y"), "id")
        grown = t.shape[1]
        new = block.withColumnRenamed("x", "bx").join(apply(block).select("id", F.col("y").alias("by")), "id")
        both = written(both.join(new, "id").select("id", F.concat("x", "bx").alias("x"), F.concat("y", "by").alias("y")), "basis")
        remove(old)
        remove(block)


def krylov(apply: Apply, ids: DataFrame, k: int, depth: int = 3, rounds: int = 30, seed: int = 0, tolerance: float = linalg.RESIDUAL, begin: DataFrame | None = None) -> tuple[np.ndarray, DataFrame, float]:
    """(values, ``(id, x)`` written, residual) of the k leading pairs by magnitude: block Krylov bases of ``depth`` blocks, restarted until the residual is small.

    ``begin``: a table ``(id, x)`` of columns that may be near to the leading vectors; normal draws fill the block."""
    return _solved(apply, ids, k, depth, rounds * depth, seed, tolerance, False, begin)


def lobpcg(apply: Apply, ids: DataFrame, k: int, rounds: int = 60, seed: int = 0, tolerance: float = linalg.RESIDUAL, begin: DataFrame | None = None) -> tuple[np.ndarray, DataFrame, float]:
    """The same by locally optimal steps: the block, its residuals and its last directions."""
    return _solved(apply, ids, k, 2, rounds, seed, tolerance, True, begin)


def solved(apply: Apply, ids: DataFrame, k: int, solver: str, begin: Callable[[int], DataFrame] | None = None) -> tuple[np.ndarray, DataFrame]:
    """(values, ``(id, x)`` written) of the k leading pairs by what stands for a solver where no matrix is formed.

    "svd_lowrank" restarts short block Krylov bases, "lobpcg" takes locally optimal steps. The other two, full decompositions in memory, aren't full ones here: "eigh" takes long
    bases from another start, "svd" the singular pairs, from bases of the squared operator, with the signs of their values. ``begin`` gives a start by its seed.
    """
    if solver not in linalg.SOLVERS:
        raise ValueError(f"unknown solver: {solver}")
    seed = {"eigh": 1, "svd": 2}.get(solver, 0)
    options = {"seed": seed, "begin": begin and begin(seed)}
    if solver == "lobpcg":
        return lobpcg(apply, ids, k, **options)[:2]
    if solver != "svd":
        return krylov(apply, ids, k, depth=5 if solver == "eigh" else 3, **options)[:2]
    # A residual of the square is one of the operator times the sum of both values.
    _, x, _ = krylov(lambda q: apply(apply(q).withColumnRenamed("y", "x")), ids, k, tolerance=linalg.RESIDUAL / 10, **options)
    both = written(x.join(apply(x), "id").select("id", "x", "y"), "ritz")
    w, v, _ = _ritz(both, k)
    out = written(times(both, v), "ritz")
    for t in (x, both):
        remove(t)
    return w, out


def signs(df: DataFrame, vector: str = "x") -> np.ndarray:
    """For each column 1 or -1, by which its sum isn't negative; where the sum is nearly zero, its largest entry's."""
    g = linalg.summed(df, [vector], lambda x: np.concatenate([np.ones(1) * len(x), x.sum(0)]))
    total, n = g[1:], g[0]
    weak = np.abs(total) < 1e-9 * np.sqrt(n)
    out = np.where(total < 0, -1.0, 1.0)
    if weak.any():
        each = df.select("id", F.posexplode(vector).alias("pos", "e")).where(F.col("pos").isin([int(i) for i in np.nonzero(weak)[0]]))
        for r in each.groupBy("pos").agg(F.max_by("e", F.struct(F.abs("e"), -F.col("id"))).alias("e")).collect():  # a row for each column
            out[r.pos] = -1.0 if r.e < 0 else 1.0
    return out
