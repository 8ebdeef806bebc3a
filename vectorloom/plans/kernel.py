"""Normalised cut by random Fourier features: sums and one small Gram matrix, linear in the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions import vec
from ..operators import linalg
from ..operators.affinity import CELLS, DISTANCE_OF, sliced, unit
from ..operators.knn import listed
from ..operators.sampling import SampleConfig, subsample
from ..operators.stats import scale_factor
from ..sources.shared import written
from ..sources.tables import complement, matrix
from ..streaming.online import Online


def frequencies(dim: int, size: int, kind: str, gamma: float, scale: float | None, seed: int = 0) -> np.ndarray:
    """d x D normal draws, of the width that makes the features' products the affinity."""
    w = np.random.default_rng(seed).standard_normal((dim, size)) / np.sqrt(gamma)
    return w if kind == "cosine" else w / scale


def features(x: np.ndarray, w: np.ndarray, kind: str) -> np.ndarray:
    """``[cos(xW), sin(xW)] / sqrt(D)``; missing rows NaN."""
    p = (unit(x) if kind == "cosine" else x) @ w
    z = np.concatenate([np.cos(p), np.sin(p)], 1) / np.sqrt(w.shape[1])
    z[~np.isfinite(x).all(1)] = np.nan
    return z


class KernelNCut(Online):
    """``fit_transform`` gives ``(id, ev)``. State: the frequencies, the feature sum r and the row count."""

    def __init__(self, n_components: int, kernel_dim: int = 1024, affinity_type: str = "cosine", affinity_focal_gamma: float = 1.0, sample_config: SampleConfig = SampleConfig(), seed: int = 0, weights: np.ndarray | None = None):
        if affinity_type not in DISTANCE_OF:
            raise ValueError(f"unknown affinity: {affinity_type}")
        self.n_components, self.kernel_dim, self.kind, self.gamma, self.config, self.seed, self.w = n_components, kernel_dim, affinity_type, affinity_focal_gamma, sample_config, seed, weights

    def _sums(self, rows: DataFrame) -> tuple[np.ndarray, float]:
        shared = rows.sparkSession.sparkContext.broadcast((self.w, self.kind))

        def kernel(x: np.ndarray) -> np.ndarray:
            w, kind = shared.value
            z = np.nan_to_num(features(x, w, kind))
            return np.append(z.sum(0), len(x))

        got = linalg.summed(rows, ["v"], kernel, self._rows())
        return (np.zeros(2 * self.w.shape[1]), 0.0) if got is None else (got[:-1], float(got[-1]))

    def _rows(self) -> int:
        """Rows whose features are formed at once."""
        return max(1, CELLS // (2 * self.w.shape[1]))

    def _anchors(self, spark: SparkSession) -> DataFrame:
        """The landmarks as they were written when the model was fitted, which may have been elsewhere."""
        return spark.read.schema("id bigint, v array<double>").parquet(self.anchor_path)

    @property
    def anchors(self) -> DataFrame:
        return self._anchors(SparkSession.active())

    def _solve(self, spark: SparkSession) -> None:
        """The spectrum of the landmarks' degree-normalised features, scaled to all rows."""
        shared = spark.sparkContext.broadcast((self.w, self.kind, self.r))

        def kernel(x: np.ndarray) -> np.ndarray:
            w, kind, r = shared.value
            z = features(x, w, kind)
            z = np.nan_to_num(z / np.sqrt(np.where(z @ r > 0, z @ r, np.nan))[:, None])
            return z.T @ z

        g = linalg.summed(self._anchors(spark), ["v"], kernel, self._rows())
        size = int(round(len(g) ** 0.5))
        lam, v = linalg.solve_eig(g.reshape(size, size), self.n_components, "eigh")[::-1]
        s = np.sqrt(np.maximum(lam, 1e-300)) * np.sqrt(self.total / self.anchor_count)
        self.eigenvalues_, self.map = s**2, v / s

    def fit(self, df: DataFrame, sample_ids: DataFrame | None = None) -> KernelNCut:
        ids = subsample(df, DISTANCE_OF[self.kind], self.config) if sample_ids is None else sample_ids
        whole = self.config.method == "full" and sample_ids is None
        rows = df.select("id", "v") if whole else df.select("id", "v").join(ids.select("id"), "id", "left_semi")
        anchors = written(rows, "anchors")
        self.anchor_path = anchors.written_path
        if self.w is None:
            dim = anchors.selectExpr("size(v) as d").first()[0]
            scale = None
            if self.kind == "rbf":
                scale = scale_factor(anchors).first()[0]
            self.w = frequencies(dim, self.kernel_dim, self.kind, self.gamma, scale, self.seed)
        self.r, self.total = self._sums(anchors)
        self.anchor_count = self.total
        self._solve(df.sparkSession)
        return self

    def update(self, rows: DataFrame) -> DataFrame:
        """New rows join the sums; the spectrum is solved again; gives their embeddings."""
        r, n = self._sums(rows)
        self.r, self.total = self.r + r, self.total + n
        self._solve(rows.sparkSession)
        return self.transform(rows)

    def transform(self, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.w, self.kind, self.r, self.map))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, kind, r, t = shared.value
            for b in sliced(batches, 2 * w.shape[1]):
                z = features(matrix(b.column(1), w.shape[0]), w, kind)
                d = z @ r
                yield pa.RecordBatch.from_arrays([b.column(0), listed((z / np.sqrt(np.where(d > 0, d, np.nan))[:, None]) @ t)], names=["id", "ev"])

        return rows.select("id", "v").mapInArrow(run, "id bigint, ev array<double>")

    def transform_anchors(self) -> DataFrame:
        return self.transform(self.anchors)

    def fit_transform(self, df: DataFrame, sample_ids: DataFrame | None = None) -> DataFrame:
        self.fit(df, sample_ids)
        if self.config.method != "full" or sample_ids is not None:
            rest = complement(df.select("id", "v"), self._anchors(df.sparkSession))
            r, n = self._sums(rest)
            if n:
                self.r, self.total = self.r + r, self.total + n
                self._solve(df.sparkSession)
        return self.transform(df)


def fourier_native(df: DataFrame, w: np.ndarray, kind: str = "cosine") -> DataFrame:
    """``(id, z)`` by column expressions, for few frequencies."""
    v = vec.normalized("v") if kind == "cosine" else df["v"]
    return df.select("id", v.alias("v")).select("id", vec.fourier("v", w.T.tolist()).alias("z"))
