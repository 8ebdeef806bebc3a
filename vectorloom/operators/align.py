"""Rotation of an embedding to cluster axes (discretisation): alternate assignment and Procrustes steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import remove, written
from ..sources.tables import matrix
from . import groups, linalg

SORTS = ("count", "norm", "marginal_norm")
TOLERANCE = 1.19e-7
#: Bytes allowed for the axes of a group when groups are dealt to passes.
_MODEL = 1 << 16


def initial_axes(df: DataFrame, vector: str = "ev", seed: int = 42) -> np.ndarray:
    """d rows: one by a hash of its id, then again and again the row least correlated with those chosen.

    A small aggregate per axis; ties go to the smaller id. Rows are L2-normalised, non-finite ones left out.
    """
    rows = df.select("id", vec.normalized(vector).alias("x")).where(vec.finite("x"))
    first = rows.agg(F.min(F.struct(_order(seed).alias("h"), "id", "x"))).first()[0]
    if first is None:
        raise ValueError("no finite rows")
    axes = [np.array(first.x)]
    d = len(first.x)
    while len(axes) < d:
        near: Column = F.lit(0.0)
        for a in axes:
            near = near + F.abs(vec.dot("x", F.array(*(F.lit(float(v)) for v in a))))
        axes.append(np.array(rows.agg(F.min(F.struct(near.alias("c"), "id", "x"))).first()[0].x))
    return np.stack(axes)


def _order(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")))


def _sums(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Per axis the sum of the normalised rows assigned to it."""
    x = _ready(x)
    out = np.zeros_like(r)
    np.add.at(out, np.argmax(x @ r.T, 1), x)
    return out


def _significance(x: np.ndarray, r: np.ndarray, method: str) -> np.ndarray:
    """Per axis: its rows, the squared length of its column of raw rotated rows, or that of its own rows in it."""
    x = x[np.isfinite(x).all(1)]
    y = x @ r.T
    own = np.zeros_like(y)
    own[np.arange(len(y)), np.argmax(_ready(x) @ r.T, 1)] = 1
    return own.sum(0) if method == "count" else (y * y).sum(0) if method == "norm" else (own * y * y).sum(0)


def significance(df: DataFrame, r: np.ndarray, method: str = "norm", vector: str = "ev") -> np.ndarray:
    """Per axis (row of r): the number of its rows, or a squared length as ``sort_method`` says."""
    if method not in SORTS:
        raise ValueError(f"unknown sort method: {method}")
    now = df.sparkSession.sparkContext.broadcast(r)
    got = linalg.summed(df, [vector], lambda x: _significance(x, now.value, method))
    return np.zeros(len(r)) if got is None else got


class AxisAlign:
    """``fit`` finds an orthogonal R whose rows are cluster axes, in the order of ``sort_method`` (largest first).

    Axes are found on L2-normalised rows; their order is that of counts or of lengths of the rows as they are.
    """

    def __init__(self, sort_method: str = "norm", max_iter: int = 100, seed: int = 42):
        if sort_method not in SORTS:
            raise ValueError(f"unknown sort method: {sort_method}")
        self.sort_method, self.max_iter, self.seed = sort_method, max_iter, seed

    def fit(self, df: DataFrame, vector: str = "ev") -> AxisAlign:
        """Every pass reads the rows as they were written once to the shared folder."""
        held = written(df.select("id", F.col(vector).alias("ev")), "align")
        try:
            self._fit(held)
        finally:
            remove(held)
        return self

    def _fit(self, rows: DataFrame) -> None:
        context, r, last = rows.sparkSession.sparkContext, initial_axes(rows, "ev", self.seed), 0.0
        for _ in range(self.max_iter):
            now = context.broadcast(r)
            m = linalg.summed(rows, ["ev"], lambda x, now=now: _sums(x, now.value)).reshape(r.shape)
            size = float(np.linalg.norm(m))
            if abs(size - last) < TOLERANCE:
                break
            last, r = size, linalg.procrustes(m)
        self.significance = significance(rows, r, self.sort_method)
        order = np.argsort(-self.significance, kind="stable")
        self.r, self.significance = r[order], self.significance[order]

    def transform(self, df: DataFrame, vector: str = "ev", normalize: bool = True, hard: bool = False) -> DataFrame:
        """``df`` with the vector rotated, or with ``cluster`` (first of equal maxima; missing rows NULL) if ``hard``."""
        y = vec.project(vec.normalized(vector) if normalize else vector, self.r)
        if hard:
            return df.withColumn("__y", y).withColumn("cluster", F.when(vec.finite("__y"), vec.argmax("__y"))).drop("__y")
        return df.withColumn(vector, y)

    def fit_transform(self, df: DataFrame, vector: str = "ev", normalize: bool = True, hard: bool = False) -> DataFrame:
        held = written(df, "rows")
        self._fit(held.select("id", F.col(vector).alias("ev")))
        return self.transform(held, vector, normalize, hard)


def grouped_align(df: DataFrame, group: str, sort_method: str = "norm", max_iter: int = 100, seed: int = 42, vector: str = "ev", most: int = 1_000_000, large: int = groups.LARGE) -> DataFrame:
    """``(group, id, cluster)``: ``AxisAlign`` for each value of a group column by itself.

    Groups of up to ``large`` rows are a call each (checked against ``most``); the passes over larger ones are shared by all of them.
    """
    if sort_method not in SORTS:
        raise ValueError(f"unknown sort method: {sort_method}")
    small, many = groups.parted(df.select(group, "id", vector), group, vector, large, seed)
    own = _aligned_at_once(small, group, sort_method, max_iter, seed, vector, most)
    return own if many is None else own.unionByName(_aligned_in_passes(many, sort_method, max_iter))


def _aligned_in_passes(many: groups.Large, sort_method: str, max_iter: int) -> DataFrame:
    out = None
    for ks, rows in many.runs(_MODEL):
        first = rows.where(vec.finite("v")).groupBy("k").agg(F.min(F.struct("o", "id", "v")).alias("b")).collect()  # a row for each group of the run
        axes = {r.k: _ready(np.array(r.b.v)[None]) for r in first}
        d = max((a.shape[1] for a in axes.values()), default=0)
        for _ in range(1, d):
            # Again and again the row least correlated with those chosen.
            more = groups.least(rows, axes, lambda a, ids, x: sum(np.abs(x @ row) for row in a) / np.maximum(np.linalg.norm(x, axis=1), vec.EPS))
            axes = {k: np.concatenate([a, _ready(more[k][None])]) for k, a in axes.items()}
        r, last, open_ = dict(axes), dict.fromkeys(axes, 0.0), set(axes)
        for _ in range(max_iter):
            if not open_:
                break
            for k, m in groups.sums(rows, {k: r[k] for k in open_}, lambda a, ids, x: _sums(x, a)).items():
                m = m.reshape(r[k].shape)
                size = float(np.linalg.norm(m))
                if abs(size - last[k]) < TOLERANCE:
                    open_.discard(k)
                else:
                    last[k], r[k] = size, linalg.procrustes(m)
        worth = groups.sums(rows, r, lambda a, ids, x: _significance(x, a, sort_method))
        r = {k: a[np.argsort(-worth[k], kind="stable")] for k, a in r.items()}
        r |= {k: None for k in ks if k not in r}  # no finite row
        got = many.named(groups.mapped(rows, r, _cluster), "id", F.when(F.col("y")[0] >= 0, F.col("y")[0].cast("bigint")).alias("cluster"))
        out = got if out is None else out.unionByName(got)
    return out


def _cluster(r: np.ndarray | None, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The cluster of each row, -1 for missing ones."""
    out = np.full((len(x), 1), -1.0)
    good = np.isfinite(x).all(1)
    if good.any():
        out[good, 0] = np.argmax(_ready(x) @ r.T, 1)
    return out


def _aligned_at_once(df: DataFrame, group: str, sort_method: str, max_iter: int, seed: int, vector: str, most: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        if table.num_rows > most:
            raise ValueError(f"a group has more than {most} rows")
        table = table.take(pa.array(np.lexsort((np.asarray(table.column("id")), table.column("o").to_pylist()))))
        x = matrix(table.column(vector))
        good = np.isfinite(x).all(1)
        cluster = np.full(len(x), -1)
        if good.any():
            u = _ready(x)
            least = np.argsort(np.asarray(table.column("id"))[good], kind="stable")
            axes, near = [u[0]], np.zeros(len(u))
            while len(axes) < u.shape[1]:
                near = near + np.abs(u @ axes[-1])
                axes.append(u[least[int(np.argmin(near[least]))]])
            r, last = np.stack(axes), 0.0
            for _ in range(max_iter):
                m = _sums(x, r)
                size = float(np.linalg.norm(m))
                if abs(size - last) < TOLERANCE:
                    break
                last, r = size, linalg.procrustes(m)
            r = r[np.argsort(-_significance(x, r, sort_method), kind="stable")]
            cluster[good] = np.argmax(u @ r.T, 1)
        return pa.table({group: table.column(group), "id": table.column("id"), "cluster": pa.array(cluster, pa.int64(), mask=~good)})

    kind = dict(df.dtypes)[group]
    return df.select(group, "id", vector, _order(seed).alias("o")).groupBy(group).applyInArrow(run, f"{group} {kind}, id bigint, cluster bigint")


def _ready(x: np.ndarray) -> np.ndarray:
    x = x[np.isfinite(x).all(1)]
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), vec.EPS)


def canonical(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """``(id, rep)``: clusters named by their smallest id, whatever the order of axes."""
    reps = df.groupBy(cluster).agg(F.min("id").alias("rep"))
    return df.join(F.broadcast(reps), cluster).select("id", "rep")


__all__ = ["AxisAlign", "canonical", "grouped_align", "initial_axes"]
