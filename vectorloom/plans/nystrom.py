"""Normalised cut by landmarks: exact on the landmarks alone, extended to all other rows in three passes."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..operators import linalg, tall, tiles
from ..operators.affinity import CELLS, DISTANCE_OF, MOST, block, sigma, sliced
from ..operators.knn import few, listed
from ..operators.sampling import SampleConfig, subsample
from ..operators.stats import scale_factor
from ..sources.shared import remove, written
from ..sources.tables import complement, matrix, reassembled, to_numpy
from ..streaming.online import Online, exists

#: Rows up to which a cut of all of them is one matrix, on the driver; rows from which the solvers of a larger one begin.
FULL, MARKS = 5_000, 1024


@dataclass
class LaplacianKernel:
    """Affinities with a bounded landmark set and the degrees they give."""

    anchors: np.ndarray
    kind: str = "cosine"
    gamma: float = 1.0
    adaptive: bool = False
    solver: str = "svd_lowrank"

    def __post_init__(self):
        x = self.anchors
        self.scale = sigma(np.where(np.isfinite(x), x, np.nan)) if self.kind == "rbf" else None
        self.missing = ~np.isfinite(x).all(1)
        self.filled = np.where(self.missing[:, None], 0.0, x)
        self.a = block(self.filled, self.filled, self.kind, self.gamma, self.scale)
        self.a[self.missing] = self.a[:, self.missing] = 0.0
        u, w = linalg.solve_eig(self.a, x.shape[1] + 1, self.solver)
        inverse = np.where(w > 1e-10 * max(1e-300, np.abs(w).max(initial=0)), 1 / np.where(w == 0, 1, w), 0.0)
        self.inverse = (u * inverse) @ u.T
        self.inner = self.a.sum(1)
        self.outer = np.zeros(len(x))

    @property
    def row_sum(self) -> np.ndarray:
        """Degrees of the landmarks; infinite for missing ones, so that their scale is 0."""
        return np.where(self.missing, np.inf, self.inner + self.outer)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Rows x landmarks, NaN for missing rows."""
        w = block(self.filled, rows, self.kind, self.gamma, self.scale)
        w[:, self.missing] = 0.0
        if self.adaptive:
            w = w / np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", w, self.inverse, w), 1e-12))[:, None]
        w[~np.isfinite(rows).all(1)] = np.nan
        return w

    def rows_degree(self, w: np.ndarray) -> np.ndarray:
        """Degrees of other rows: to the landmarks exactly, to the rest through the landmarks."""
        return w.sum(1) + w @ (self.inverse @ self.outer)

    def normalized(self, w: np.ndarray) -> np.ndarray:
        d = self.rows_degree(w)
        return w / np.sqrt(np.where(d > 0, d, np.nan)[:, None] * self.row_sum)

    def normalized_anchors(self) -> np.ndarray:
        d = self.row_sum
        return self.a / np.sqrt(d[:, None] * d)


def landmark_root(k: LaplacianKernel, solver: str = "svd_lowrank") -> tuple[np.ndarray, np.ndarray]:
    """Positive eigenpairs of the normalised landmark block, at most d + 1."""
    u, w = linalg.solve_eig(k.normalized_anchors(), k.anchors.shape[1] + 1, solver)
    use = w > 1e-10
    return u[:, use], w[use]


def joint_spectrum(k: LaplacianKernel, u: np.ndarray, w: np.ndarray, g: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, map of normalised affinities to embeddings) of landmarks and other rows, whose Gram matrix in ``u`` is g."""
    root = 1 / np.sqrt(w)
    lam, q = np.linalg.eigh(np.diag(w) + root[:, None] * g * root)
    order = np.argsort(-lam, kind="stable")[:c]
    lam, q = lam[order], q[:, order]
    t = (u * root) @ q / np.sqrt(lam)
    # Signs by the embeddings of the landmarks.
    return lam, t * np.where((k.normalized_anchors() @ t).sum(0) < 0, -1.0, 1.0)


class NystromNCut(Online):
    """``fit_transform`` gives ``(id, ev)``: the leading eigenvectors of the normalised affinity.

    ``kernel_type`` makes the kernel of the landmarks: ``LaplacianKernel`` or a class (or function of its fields) that
    offers what it does: ``anchors``, ``missing``, ``outer``, ``raw``, ``normalized`` and ``normalized_anchors``.

    Component 0 is the trivial one and is kept. Missing rows get NaN. At most d + 1 components exist when
    landmarks stand for other rows.
    """

    def __init__(self, n_components: int, affinity_type: str = "cosine", affinity_focal_gamma: float = 1.0, adaptive_scaling: bool = False, sample_config: SampleConfig = SampleConfig(), eig_solver: str = "svd_lowrank", kernel_type: Callable = LaplacianKernel, history: str | None = None):
        if affinity_type not in DISTANCE_OF:
            raise ValueError(f"unknown affinity: {affinity_type}")
        self.n_components, self.kind, self.gamma, self.adaptive, self.config, self.solver = n_components, affinity_type, affinity_focal_gamma, adaptive_scaling, sample_config, eig_solver
        self.kernel_type, self.kernel, self.full, self.history = kernel_type, None, None, history

    def fit(self, df: DataFrame, sample_ids: DataFrame | None = None, most: int = FULL) -> NystromNCut:
        """Learn from the sample. Where all of more than ``most`` rows are landmarks, they are in tiles (adaptive scaling and other kernels have no tiles: up to ``MOST`` rows)."""
        self.full = None
        plain = self.kernel_type is LaplacianKernel and not self.adaptive
        if plain and sample_ids is None and self.config.method == "full" and not few(df, most):
            self.full = tiled_spectrum(df, self.n_components, self.kind, self.gamma, solver=self.solver)
            self.eigenvalues_ = self.full[2]
            return self
        ids = subsample(df, DISTANCE_OF[self.kind], self.config) if sample_ids is None else sample_ids
        self.ids, x = to_numpy(df.join(ids.select("id"), "id", "left_semi"), MOST)
        self.kernel = k = self.kernel_type(x, self.kind, self.gamma, self.adaptive, self.solver)
        n = k.normalized_anchors()
        u, w = linalg.solve_eig(n, max(self.n_components, x.shape[1] + 1), self.solver)
        self._spectrum(u, w)
        return self

    def _spectrum(self, u: np.ndarray, w: np.ndarray) -> None:
        if self.n_components > u.shape[1]:
            warnings.warn(f"only {u.shape[1]} components exist", stacklevel=3)
        c = min(self.n_components, u.shape[1])
        self.eigenvalues_, self.map = w[:c], u[:, :c] / np.where(np.abs(w[:c]) < 1e-12, np.inf, w[:c])

    def state(self) -> dict:
        if self.full is not None:
            raise ValueError("a cut of all rows in tiles has tables for its state: write them")
        return super().state()

    def update(self, rows: DataFrame) -> DataFrame:
        """Embeddings of new rows, whose degrees join the state.

        The spectrum reflects landmarks and these rows; with a ``history`` (a folder), landmarks and all rows ever fed, each id once.
        """
        if self.full is not None:
            raise ValueError("a cut of all rows in tiles isn't updated: sample landmarks")
        if self.history is not None:
            self.absorb(rows)
            self.refresh(rows.sparkSession)
        else:
            self._learn(rows, self.kernel.outer)
        return self.transform(rows)

    def absorb(self, rows: DataFrame) -> None:
        """Keep rows whose ids are neither landmarks' nor in the history. A batch fed again, or a row fed twice, changes nothing; rows of one id count once, the least vector of them."""
        spark = rows.sparkSession
        marks = spark.createDataFrame(pa.table({"id": pa.array(self.ids, pa.int64())}))
        new = rows.join(F.broadcast(marks), "id", "left_anti").groupBy("id").agg(F.min("v").alias("v"))
        known = self.fed(spark)
        if known is not None:
            new = new.join(known.select("id"), "id", "left_anti")
        new.write.parquet(f"{self.history}/{uuid.uuid4().hex}")

    def fed(self, spark: SparkSession) -> DataFrame | None:
        """``(id, v)`` of the history; None before the first batch."""
        if not exists(spark, self.history):
            return None
        return spark.read.schema("id bigint, v array<double>").option("recursiveFileLookup", "true").parquet(self.history)

    def refresh(self, spark: SparkSession) -> None:
        """Degrees and spectrum of landmarks and history by two passes over it: the same as one update with all of its rows."""
        rows = self.fed(spark)
        if rows is not None:
            self._learn(rows, np.zeros(len(self.kernel.anchors)))

    def _learn(self, rows: DataFrame, before: np.ndarray) -> None:
        """Degrees: those before and those to ``rows``; spectrum: that of landmarks and ``rows``."""
        k = self.kernel
        shared = rows.sparkSession.sparkContext.broadcast(k)
        most = max(1, CELLS // len(k.anchors))
        outer = linalg.summed(rows, ["v"], lambda x: np.nan_to_num(shared.value.raw(x)).sum(0), most)
        if outer is None:
            return
        k.outer = before + outer
        # Rank d + 1 root of the normalised landmark block; the Gram matrix is kept in its coordinates.
        u, w = landmark_root(k, self.solver)
        late = rows.sparkSession.sparkContext.broadcast((k, u))

        def squares(x: np.ndarray) -> np.ndarray:
            kernel, base = late.value
            b = np.nan_to_num(kernel.normalized(kernel.raw(x))) @ base
            return b.T @ b

        g = linalg.summed(rows, ["v"], squares, most).reshape(len(w), -1)
        if self.n_components > len(w):
            warnings.warn(f"only {len(w)} components exist", stacklevel=3)
        self.eigenvalues_, self.map = joint_spectrum(k, u, w, g, self.n_components)

    def transform_anchors(self) -> np.ndarray:
        v = self.kernel.normalized_anchors() @ self.map
        v[self.kernel.missing] = np.nan
        return v

    def transform(self, rows: DataFrame) -> DataFrame:
        """``(id, ev)`` of any rows by the fitted map: a projection without a shuffle; works on streams (after a cut in tiles: a product in tiles)."""
        if self.full is not None:
            return self._transform_tiles(rows)
        shared = rows.sparkSession.sparkContext.broadcast((self.kernel, self.map))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kernel, t = shared.value
            for b in sliced(batches, len(kernel.anchors)):
                yield pa.RecordBatch.from_arrays([b.column(0), listed(kernel.normalized(kernel.raw(matrix(b.column(1), kernel.anchors.shape[1]))) @ t)], names=["id", "ev"])

        return rows.select("id", "v").mapInArrow(run, "id bigint, ev array<double>")

    def _transform_tiles(self, rows: DataFrame) -> DataFrame:
        good, table, w, scale = self.full
        inverse = F.array(*(F.lit(float(1 / e) if abs(e) > 1e-12 else 0.0) for e in w))
        both = good.join(table, "id").select("id", "v", F.concat(F.zip_with(F.transform("x", lambda e: e * F.col("s")), inverse, lambda a, b: a * b), F.array(F.lit(1.0))).alias("a"))
        got = tiles.product(rows.select("id", "v").where(vec.finite("v")), both, self.kind, self.gamma, scale)
        c = len(w)
        ev = F.transform(F.slice("y", 1, c), lambda e: e / F.sqrt(F.element_at("y", -1)))
        missing = F.array_repeat(F.lit(float("nan")), c)
        return rows.select("id").join(got.select("id", ev.alias("ev")), "id", "left").select("id", F.coalesce("ev", missing).alias("ev"))

    def fit_transform(self, df: DataFrame, sample_ids: DataFrame | None = None, most: int = FULL) -> DataFrame:
        self.fit(df, sample_ids, most)
        if self.full is not None:
            missing = F.array_repeat(F.lit(float("nan")), len(self.eigenvalues_))
            return df.select("id").join(self.full[1].withColumnRenamed("x", "ev"), "id", "left").select("id", F.coalesce("ev", missing).alias("ev"))
        spark = df.sparkSession
        anchors = spark.createDataFrame(pa.table({"id": pa.array(self.ids, pa.int64())}))
        rest = complement(df.select("id", "v"), anchors)
        whole = self.config.method == "full" and sample_ids is None
        new = None if whole or rest.isEmpty() else self.update(rest)
        own = spark.createDataFrame(pa.table({"id": pa.array(self.ids, pa.int64()), "ev": listed(self.transform_anchors())}))
        return own if new is None else reassembled(own, new)


def exact_cut(df: DataFrame, k: int, kind: str = "cosine", gamma: float = 1.0, rounds: int = 60, solver: str = "lobpcg", held: int = tiles.HELD) -> tuple[DataFrame, np.ndarray]:
    """Full-graph cut of any number of rows: ``(id, ev)`` and the eigenvalues; "lobpcg" takes a product a step, the others three.

    The affinity is formed in tiles for each product and never stored, bases are tables: no task holds more than a piece of ``held`` rows, the driver
    matrices of the basis' width. Missing rows get NaN and leave the others unaffected.
    """
    good, table, w, _ = tiled_spectrum(df, k, kind, gamma, rounds, solver, held)
    remove(good)
    missing = F.array_repeat(F.lit(float("nan")), len(w))
    return df.select("id").join(table.withColumnRenamed("x", "ev"), "id", "left").select("id", F.coalesce("ev", missing).alias("ev")), w


def tiled_spectrum(df: DataFrame, k: int, kind: str, gamma: float, rounds: int = 30, solver: str = "svd_lowrank", held: int = tiles.HELD) -> tuple[DataFrame, DataFrame, np.ndarray, float | None]:
    """Of the finite rows: ``(id, v, s)`` with s one over the degree's root, ``(id, x)`` of eigenvectors, both written; the values; the scale of "rbf"."""
    if solver not in linalg.SOLVERS:
        raise ValueError(f"unknown solver: {solver}")
    good, apply, _, scale = tiled_operator(df, kind, gamma, held)
    find = tall.lobpcg if solver == "lobpcg" else tall.krylov
    w, x, off = find(apply, good.select("id"), k, rounds=rounds, begin=beginning(good, k, kind, gamma, scale))
    if off > 1e-6:
        warnings.warn(f"eigenvectors have a residual of {off:.1e}", stacklevel=3)
    flip = tall.signs(x)
    table = written(x.select("id", F.zip_with("x", F.array(*(F.lit(float(f)) for f in flip)), lambda a, b: a * b).alias("x")), "spectrum")
    remove(x)
    return good, table, w, scale


def tiled_operator(df: DataFrame, kind: str, gamma: float, held: int = tiles.HELD) -> tuple[DataFrame, tall.Apply, Callable[[], float], float | None]:
    """Of the finite rows: ``(id, v, s)`` with s one over the degree's root, written; the product of the normalised affinity with a basis, and its sum of squares; the scale of "rbf"."""
    rows = written(df.select("id", "v").where(vec.finite("v")), "cut")
    scale = scale_factor(rows).first()[0] if kind == "rbf" else None
    ones = rows.withColumn("a", F.array(F.lit(1.0)))
    n = rows.count()
    degree = tiles.symmetric(ones, n, kind, gamma, scale, held).select("id", (1 / F.sqrt(F.col("y")[0])).alias("s"))
    good = written(rows.join(degree, "id"), "degrees")
    remove(rows)

    def apply(basis: DataFrame) -> DataFrame:
        columns = good.join(basis, "id").select("id", "v", "s", F.transform("x", lambda e: e * F.col("s")).alias("a"))
        return tiles.symmetric(columns, n, kind, gamma, scale, held)

    def squares() -> float:
        s = F.col("s") * F.col("s")  # the square of an affinity is that of half of gamma
        return tiles.symmetric(good.select("id", "v", s.alias("s"), F.array(s).alias("a")), n, kind, gamma / 2, scale, held).agg(F.sum(F.col("y")[0])).first()[0]

    return good, apply, squares, scale


def beginning(good: DataFrame, k: int, kind: str, gamma: float, scale: float | None, seed: int = 0) -> DataFrame:
    """``(id, x)``: the trivial eigenvector, which is the degrees' root, and the leading ones of a sample of the rows, continued to all of them by one product with the sample."""
    marks = good.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(max(1, min(MARKS, good.count() // 4))).toArrow()
    v, s = matrix(marks.column("v")), np.asarray(marks.column("s"))[:, None]
    u, w = linalg.solve_eig(block(v, v, kind, gamma, scale) * s * s.T, k + 5)
    use = np.abs(w) > 1e-10 * np.abs(w).max(initial=0)
    columns = good.sparkSession.createDataFrame(pa.table({"id": marks.column("id"), "v": marks.column("v"), "a": listed(u[:, use] / w[use] * s)}))
    near = tiles.product(good, columns, kind, gamma, scale)
    return good.join(near, "id").select("id", F.concat(F.array(1 / F.col("s")), "y").alias("x"))


def solver_errors(df: DataFrame, k: int, kind: str = "cosine", gamma: float = 1.0, held: int = tiles.HELD) -> list[tuple[str, float, float, float]]:
    """(solver, departure from orthonormal, residual, error of the values) of the k leading pairs by every solver, for any number of rows.

    The error is a bound, for no full decomposition is made: k orthonormal vectors of a small residual have k eigenvalues within it, and the squares of all
    others sum up to what the matrix' sum of squares is more than theirs. If that leaves none as large as the k-th, these are the leading ones.
    """
    good, apply, squares, scale = tiled_operator(df, kind, gamma, held)
    found = {s: tall.solved(apply, good.select("id"), k, s, lambda seed: beginning(good, k, kind, gamma, scale, seed)) for s in linalg.SOLVERS}
    basis = written(tall.beside(*(x for _, x in found.values())), "solvers")
    both = written(basis.join(apply(basis), "id"), "solvers")
    shared = df.sparkSession.sparkContext.broadcast(np.concatenate([w for w, _ in found.values()]))

    def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate([x.T @ x, ((y - x * shared.value) ** 2).sum(0)[None]])

    total = linalg.summed(both, ["x", "y"], kernel).reshape(-1, len(shared.value))
    whole, out, at = squares(), [], 0
    for solver, (w, _) in found.items():
        own = slice(at, at := at + len(w))
        departure, residual = float(np.abs(total[own, own] - np.eye(len(w))).max()), float(np.sqrt(total[-1, own].sum()))
        rest = float(np.sqrt(max(0.0, whole - (w**2).sum())))
        out.append((solver, departure, residual, max(residual, rest - float(np.abs(w).min()))))
    for t in (good, basis, both, *(x for _, x in found.values())):
        remove(t)
    return out
