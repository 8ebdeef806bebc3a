"""Vector tables: scans with one contract ``(id bigint, v array<double>)``, row lookup, grids and sinks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import NAN

#: Rows of a block handed to array kernels.
CHUNK = 8192


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int | None = None, keep: Iterable[str] = ()) -> DataFrame:
    """``(id, v, *keep)``. With ``dim`` a NULL vector, or one of another length, becomes a row of NaN; NULL elements NaN."""
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: F.coalesce(x, F.lit(NAN)))
    if dim is not None:
        v = F.when(F.size(vector) == dim, v).otherwise(F.array_repeat(F.lit(NAN), dim))
    return df.select(F.col(key).cast("long").alias("id"), v.alias("v"), *keep)


def read_vectors(spark: SparkSession, path: str, **options) -> DataFrame:
    return vectors(spark.read.parquet(path), **options)


def from_numpy(spark: SparkSession, x: np.ndarray) -> DataFrame:
    """Rows of a matrix, ids by position."""
    x = np.asarray(x, float)
    table = pa.table({"id": np.arange(len(x)), "v": pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))})
    return spark.createDataFrame(table)


def to_numpy(df: DataFrame, most: int, vector: str = "v", key: str = "id") -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) sorted by id; raises if there are more than ``most`` rows."""
    table = df.select(key, vector).limit(most + 1).toArrow()
    if table.num_rows > most:
        raise ValueError(f"more than {most} rows for the driver")
    ids = np.asarray(table.column(0).combine_chunks()) if table.num_rows else np.zeros(0, np.int64)
    x = matrix(table.column(1).combine_chunks())
    order = np.argsort(ids, kind="stable")
    return ids[order], x[order]


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a matrix; NULL rows and NULL elements are NaN."""
    n = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten().cast(pa.float64()).fill_null(NAN))
    valid = np.asarray(column.is_valid())
    held = int(valid.sum())
    d = dim or (len(flat) // held if held else 0)
    out = np.full((n, d), NAN)
    if held:
        out[valid] = flat.reshape(held, d)
    return out


def lookup(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def complement(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not among ``ids``."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


def reassembled(*parts: DataFrame) -> DataFrame:
    """Results of disjoint parts as one table, by id and name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grid(df: DataFrame, height: int = 10, width: int = 10, key: str = "id") -> DataFrame:
    """Ids read as pixels: ``(img, y, x)`` beside the other columns."""
    i: Column = F.col(key)
    return df.select("*", F.floor(i / (height * width)).cast("int").alias("img"), F.pmod(F.floor(i / width), F.lit(height)).cast("int").alias("y"), F.pmod(i, F.lit(width)).cast("int").alias("x"))


def chunked(df: DataFrame, key: str = "id", rows: int = CHUNK) -> DataFrame:
    """Rows with the number of their block of ``rows`` consecutive ids."""
    return df.withColumn("chunk", F.floor(F.col(key) / rows).cast("long"))


def write(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    df.write.mode(mode).options(**options).parquet(path)
