"""What the operators of this subpackage share: the shared folder, lineage cuts and block exchange."""

from __future__ import annotations

import contextlib
import ctypes
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark writes array literals of this type into plans; wider constants are kept out of expressions.
SPACES = " \t\n\x0b\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A single machine without the setting (tests) gets a temporary one; a cluster an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="vectorloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: ends lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/vectorloom-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``cut`` wrote and nothing reads any more."""
    for df in tables:
        if df is not None:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_path)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def clear(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that carry a result's name (in any case): the result takes their place."""
    taken = {n.lower() for n in names}
    return df.select([c for c in df.columns if c.lower() not in taken])


def shuffle_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions: it follows the input, so blocks keep their size."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_count(docs: DataFrame, text: str, most: int = 16 << 20) -> tuple[int, int]:
    """(blocks of at most about ``most`` bytes of text, buckets): the shuffle partitions, or more where these would be too few.

    A bucket serves what four blocks ask for, so that there are fewer messages than pairs of blocks.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = shuffle_parts(docs.sparkSession)
    return max(parts, -(-total // most)), max(parts, -(-total // (4 * most)))


def freed(f: Callable) -> Callable:
    """``f`` of one table or two, after which a worker's memory goes back to the machine."""
    if len(inspect.signature(f).parameters) == 1:

        def one(table: pa.Table) -> pa.Table:
            try:
                return f(table)
            finally:
                release()

        return one

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return f(left, right)
        finally:
            release()

    return two


def release() -> None:
    """Give memory that a worker no longer uses back to the machine: workers are kept between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: int, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs whose texts have about ``most`` bytes: bounds what a worker holds."""
    for batch in batches:
        if not batch.num_rows:
            continue
        upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64))
        cuts = [0, *(np.nonzero(np.diff(upto // most))[0] + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(lo, hi - lo)
    release()
