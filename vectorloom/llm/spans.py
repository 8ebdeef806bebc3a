"""Positions of all matches of a pattern as plain column expressions (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Matches are placed in blocks of this many, so that running sums stay linear for long texts.
BLOCK = 256

SPAN = "struct<s:bigint,e:bigint,m:string>"


def gaps(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def placed(gap: Column, match: Column) -> Column:
    """``array<struct<s,e,m>>`` from the pieces between matches and the matches, in code points.

    ``split`` and ``regexp_extract_all`` walk the same leftmost matches, so piece i stands before
    match i. A running sum within blocks of ``BLOCK`` matches, and one over the blocks, gives offsets.
    """
    items = F.zip_with(F.slice(gap, 1, F.size(match)), match, lambda g, m: F.struct(F.length(g).cast("bigint").alias("g"), m.alias("m")))
    count = F.ceil(F.size(match) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))
    sums = F.transform(blocks, lambda k: F.aggregate(k, F.lit(0).cast("bigint"), lambda a, x: a + x.g + F.length(x.m)))
    starts = F.aggregate(sums, F.array(F.lit(0).cast("bigint")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))
    state = F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(None).cast(f"array<{SPAN}>").alias("o"))

    def step(a: Column, x: Column, off: Column) -> Column:
        s = a.p + x.g
        e = s + F.length(x.m)
        one = F.array(F.struct((off + s).alias("s"), (off + e).alias("e"), x.m.alias("m")))
        return F.struct(e.alias("p"), F.when(a.o.isNull(), one).otherwise(F.concat(a.o, one)).alias("o"))

    spans = F.zip_with(blocks, F.slice(starts, 1, count), lambda k, off: F.aggregate(k, state, lambda a, x: step(a, x, off)).o)
    return F.when(F.size(match) > 0, F.flatten(spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(d: Column) -> Column:
    """True if the digit string passes the check-digit rule: every second digit from the right doubled."""

    def add(a: Column, i: Column) -> Column:
        c = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        two = c * 2
        return a + F.when(i % 2 == 1, c).when(two > 9, two - 9).otherwise(two)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d) == 0, F.lit(False)).otherwise(total % 10 == 0)


def written(kind: str, spans: Column) -> Column:
    """``kind:start:end`` of each span."""
    return F.transform(spans, lambda x: F.concat(F.lit(f"{kind}:"), x.s.cast("string"), F.lit(":"), x.e.cast("string")))
