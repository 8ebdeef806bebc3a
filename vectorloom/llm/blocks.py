"""Exchange between blocks of documents and buckets of keys, in packed form.

Documents go once to blocks by a hash; each block asks the buckets of its distinct keys and gets answers in
the order it asked. All that moves is compressed column blobs, a few rows per task, so a key that a third
of the documents hold costs one entry per block, and no task holds more than a block or a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "block int, blob binary"
REQUESTS = "bucket int, block int, blob binary"


def squeeze(data: bytes) -> bytes:
    return zstandard.compress(data, 1)


def loosen(data: bytes) -> bytes:
    return zstandard.decompress(data)


def put(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def take(blobs: list[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(pa.py_buffer(b)).read_all() for b in blobs])


def blocked(docs: DataFrame, key: str, text: str, blocks: int) -> DataFrame:
    """``(block, blob)``: documents by the hash of key and text; both in the blob, null text as empty."""
    keyed = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(blocks)).cast("int").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = np.asarray(batch.column(2))
            order = np.argsort(b, kind="stable")
            body = batch.select(["k", "t"]).take(pa.array(order))
            at, first = np.unique(b[order], return_index=True)
            ends = np.append(first[1:], len(b))[: len(first)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([put(body.slice(s, e - s)) for s, e in zip(first, ends, strict=True)], pa.binary())], names=["block", "blob"])

    return keyed.mapInArrow(run, BLOCKS)
