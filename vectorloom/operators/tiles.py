"""Products with an affinity matrix of any size that is never stored: tiles of it are formed where a piece of its columns meets rows.

Columns are dealt to pieces of ``HELD`` rows by a hash of the id, rows to stripes of ``STREAM``; each row meets each piece once. What moves is the rows, once for
each piece, and a sum for each row and piece; no task holds more than a piece of the columns and a tile. Smaller pieces are made as long as they are
few (``_few``), so that all cores have one; then they grow with the table up to ``HELD`` rows, and copies of a row stay that few.

Where rows and columns are the same vectors the matrix is symmetric: a tile serves its rows and its columns, so half of the tiles are formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import matrix
from .affinity import exponents, tile
from .knn import listed
from .paired import Side, added, paired

#: Rows of the side that a task holds; rows that stream past it in one task.
HELD, STREAM = 1 << 16, 1 << 18
#: Rows and columns of a tile, which is to stay in a core's cache; pairs of pieces for each core.
HIGH, WIDE, EACH = 128, 1024, 3
#: Rows for which a piece of their own is worth a task: 16 million pairs with another.
LEAST = 4096


def _few(df: DataFrame, symmetric: bool = False) -> int:
    """Pieces of a side that give every core ``EACH`` pairs of pieces."""
    pairs = EACH * df.sparkSession.sparkContext.defaultParallelism
    return max(2, int(np.ceil((2 * pairs if symmetric else pairs) ** 0.5)))


def pieces(df: DataFrame, n: int, asked: int, most: int, symmetric: bool = False) -> int:
    """Pieces of n rows: of ``asked`` rows, or of ``LEAST`` if that is less, while these are at most ``_few``; else as many as that, of ``most`` rows at most."""
    return max(1, -(-n // max(most, asked)), min(-(-n // min(asked, LEAST)), _few(df, symmetric)))


def dealt(n: int):
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("bigint")


def each(n: int):
    return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))


def summed_tiles(x: np.ndarray, y: np.ndarray, a: np.ndarray, kind: str, gamma: float, scale: float | None, b: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """(affinities of x with y, times a; the transposed ones, times b)."""
    left, right = exponents(x, kind, gamma, scale, True), exponents(y, kind, gamma, scale, False)
    out, back = np.zeros((len(x), a.shape[1])), None if b is None else np.zeros((len(y), b.shape[1]))
    for c in range(0, len(y), WIDE):
        part, ac = right[c : c + WIDE], a[c : c + WIDE]
        for r in range(0, len(x), HIGH):
            w = tile(left[r : r + HIGH], part, kind)
            out[r : r + HIGH] += w @ ac
            if back is not None:
                back[c : c + WIDE] += w.T @ b[r : r + HIGH]
    return out, back


def product(rows: DataFrame, columns: DataFrame, kind: str = "cosine", gamma: float = 1.0, scale: float | None = None, held: int = HELD, stream: int = STREAM, sizes: tuple[int, int] | None = None) -> DataFrame:
    """``(id, y)`` of every row: the sum over ``columns (id, v, a)`` of its affinity with v, times a. All vectors are finite.

    Where ``rows`` have a column ``s``, y is multiplied by it. ``sizes``: the numbers of rows and columns, if they are known.
    """
    high, wide = sizes or (rows.count(), columns.count())
    many = pieces(rows, wide, held, HELD)
    stripes = max(-(-high // stream), min(-(-high // HIGH), _few(rows)), 1)
    s = F.col("s") if "s" in rows.columns else F.lit(1.0)
    right = columns.select(each(stripes).alias("p"), dealt(many).alias("q"), "id", "v", "a")
    left = rows.select(dealt(stripes).alias("p"), each(many).alias("q"), "id", "v", F.array(s).alias("a"))

    def meet(p: int, q: int, there: Side, here: Side) -> pa.RecordBatch:
        y = here[2] * summed_tiles(here[1], there[1], there[2], kind, gamma, scale)[0]
        return pa.RecordBatch.from_arrays([pa.array([q] * len(y), pa.int64()), pa.array(here[0]), listed(y)], names=["q", "id", "y"])

    return added(paired(right, left, meet, "q bigint, id bigint, y array<double>", many * stripes, (F.col("p") * many + F.col("q")).cast("int"), 1 << 30))


def symmetric(columns: DataFrame, n: int, kind: str = "cosine", gamma: float = 1.0, scale: float | None = None, held: int = HELD) -> DataFrame:
    """``product`` of n rows ``(id, v, a)`` with themselves; with a column ``s``, y is multiplied by it. Every pair of pieces meets once, in one task."""
    many = pieces(columns, n, held, HELD, True)
    s = F.col("s") if "s" in columns.columns else F.lit(1.0)
    own = columns.withColumn("own", dealt(many)).select("own", each(many).alias("other"), "id", "v", F.concat("a", F.array(s)).alias("a"))
    # Of two pieces the one of the smaller number streams past the other; a piece also meets itself, held and streamed.
    p, q = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") < F.col("other"), F.array(F.lit(1))).when(F.col("own") > F.col("other"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    task = (q * (q + 1) / 2).cast("int") + p.cast("int")
    both = own.select(task.alias("task"), p.alias("p"), q.alias("q"), F.explode(side).alias("side"), "id", "v", "a")
    met = both.repartitionById(many * (many + 1) // 2, F.col("task")).sortWithinPartitions("p", "q", "side", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, there, back = None, [], None, None

        def given(at: int, ids: np.ndarray, y: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), at, np.int64)), pa.array(ids), listed(y * s)], names=["q", "id", "y"])

        def closed() -> Iterator[pa.RecordBatch]:
            if back is not None:
                yield given(now[0], there[0], back, there[2][:, -1:])

        for batch in batches:
            keys = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)])
            cuts = np.nonzero((np.diff(keys, axis=1) != 0).any(0))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if lo == hi:
                    continue
                key = tuple(keys[:2, lo].tolist())
                if key != now:
                    yield from closed()
                    now, parts, there, back = key, [], None, None
                part = batch.slice(lo, hi - lo)
                if keys[2, lo] == 0:
                    parts.append(part)
                    continue
                if there is None and parts:
                    whole, parts = pa.Table.from_batches(parts), []
                    there = np.asarray(whole.column(3)), matrix(whole.column(4)), matrix(whole.column(5))
                if there is None:
                    continue
                ids, x, a = np.asarray(part.column(3)), matrix(part.column(4)), matrix(part.column(5))
                y, more = summed_tiles(x, there[1], there[2][:, :-1], kind, gamma, scale, a[:, :-1] if key[0] != key[1] else None)
                if more is not None:
                    back = more if back is None else back + more
                yield given(key[1], ids, y, a[:, -1:])
        yield from closed()

    return added(met.select("p", "q", "side", "id", "v", "a").mapInArrow(run, "q bigint, id bigint, y array<double>"))
