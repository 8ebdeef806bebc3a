"""Secrets: base patterns plus a battery of randomness tests with length-aware control of false discoveries.

Every token of ``LONG`` characters gets an inferred encoding (but for plain numbers); its symbol values take a chi-squared
test of uniformity, a runs test and a test of serial correlation. Fisher's combination must not speak against
randomness, and the chi-squared value must be too small for ordinary text written in that encoding: chi-squared of text
is noncentral, and how far off it is follows from the counts of the encoding's symbols in *all* texts (outside such tokens). The second is a
p-value of the hypothesis "text"; over *all* candidates of the corpus, per class of length, the
Benjamini-Hochberg procedure bounds the share of false discoveries. Both need only a bounded number of counts on the driver.

Defined results: null text is empty and has no spans; empty tables give empty tables; repeated rows are
scanned each; other columns pass through (one of a result's name gives way); whole texts are scanned by patterns linear in their length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear, cut, pieces

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LONG = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

#: Encodings in the order they are tried: name, test, symbols in the order of their values.
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ENCODINGS = (
    ("hex", re.compile(r"[0-9a-f]+\Z"), DIGITS + "abcdef"),
    ("HEX", re.compile(r"[0-9A-F]+\Z"), DIGITS + "ABCDEF"),
    ("base32", re.compile(r"[A-Z2-7]+=*\Z"), UPPER + "234567"),
    ("base62", re.compile(r"[A-Za-z0-9]+\Z"), UPPER + LOWER + DIGITS),
    ("base64", re.compile(r"[A-Za-z0-9+/]+=*\Z"), UPPER + LOWER + DIGITS + "+/"),
    ("base64url", re.compile(r"[A-Za-z0-9_-]+=*\Z"), UPPER + LOWER + DIGITS + "-_"),
    ("mixed", re.compile(r"[A-Za-z0-9+/_=-]+\Z"), UPPER + LOWER + DIGITS + "+/-_="),
)
VALUES = {name: {c: i for i, c in enumerate(symbols)} for name, _, symbols in ENCODINGS}
#: Least chi-squared per symbol that text is taken to leave in an encoding (also where there is no text to count).
LEAST_SHIFT = 0.3
#: Tokens whose combined test is below are not random.
RANDOM_LEAST = 1e-3
FALSE_SHARE = 0.01
STRATA = (32, 64)  # lengths below, between and from
BIN = 0.1  # of -log10 p
LAST = 300

FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("s", T.LongType()), T.StructField("e", T.LongType())]))
TESTED = T.ArrayType(T.StructType([T.StructField("s", T.LongType()), T.StructField("e", T.LongType()), T.StructField("encoding", T.StringType()), T.StructField("stratum", T.IntegerType()), T.StructField("p_random", T.DoubleType()), T.StructField("bin", T.IntegerType())]))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int64()), ("e", pa.int64())]))
_TESTED = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64()), ("encoding", pa.string()), ("stratum", pa.int32()), ("p_random", pa.float64()), ("bin", pa.int32())]))


def encoding(token: str) -> str | None:
    """The first encoding whose symbols the token keeps to; none for numbers."""
    if not any(c.isalpha() for c in token):
        return None
    return next((name for name, test, _ in ENCODINGS if test.match(token)), None)


def _above(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def bins_of(n: int) -> int:
    """Bins of a token of n symbols."""
    return max(4, min(16, n // 3))


def text_shifts(counts: list[int]) -> dict[tuple[str, int], float]:
    """{(encoding, bins): chi-squared per symbol of text} from how often each of the first 128 characters stands in all texts."""
    out = {}
    for name, _, symbols in ENCODINGS:
        seen, k = [counts[ord(c)] for c in symbols], len(symbols)
        for bins in range(4, 17):
            total, shift = sum(seen), LEAST_SHIFT
            if total:
                held, size = [0] * bins, [0] * bins
                for v in range(k):
                    held[v * bins // k] += seen[v]
                    size[v * bins // k] += 1
                shift = max(shift, sum((h / total - s / k) ** 2 / (s / k) for h, s in zip(held, size, strict=True)))
            out[name, bins] = shift
    return out


def battery(token: str, kind: str, shifts: dict[tuple[str, int], float] | None = None) -> tuple[float, float]:
    """(p of randomness by Fisher's combination of the three tests, p of the hypothesis "text")."""
    symbols = VALUES[kind]
    x = [symbols[c] for c in token if c in symbols]
    n, k = len(x), len(symbols)
    bins = bins_of(n)
    shift = shifts[kind, bins] if shifts else LEAST_SHIFT
    count = [0] * bins
    for v in x:
        count[v * bins // k] += 1
    # Bins take whole symbols: their share is what they hold of the alphabet.
    share = [0] * bins
    for v in range(k):
        share[v * bins // k] += 1
    chi = sum((c - n * s / k) ** 2 / (n * s / k) for c, s in zip(count, share, strict=True))
    free = bins - 1
    # Wilson and Hilferty: the cube root of chi-squared over its degrees is nearly normal.
    p_chi = _above(((chi / free) ** (1 / 3) - 1 + 2 / (9 * free)) / math.sqrt(2 / (9 * free)))
    high = [v >= k // 2 for v in x]
    a = sum(high)
    b = n - a
    if a and b and a * b * 2 > n:
        runs = 1 + sum(p != q for p, q in zip(high, high[1:], strict=False))
        mean = 1 + 2 * a * b / n
        spread = math.sqrt(max(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
        p_runs = 2 * _above(abs(runs - mean) / spread)
    else:
        p_runs = 1e-12
    m = sum(x) / n
    var = sum((v - m) ** 2 for v in x)
    p_serial = 2 * _above(abs(sum((p - m) * (q - m) for p, q in zip(x, x[1:], strict=False)) / var + 1 / n) * math.sqrt(n)) if var else 1e-12
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    p_random = math.exp(-half) * (1 + half + half * half / 2) if half < 600 else 0.0
    p_text = _above((free + n * shift - chi) / math.sqrt(2 * free + 4 * n * shift))
    return p_random, p_text


def scan(text: str, shifts: dict[tuple[str, int], float]) -> tuple[list[tuple[str, int, int]], list[tuple]]:
    """Base spans sorted by start, then kind as listed; tested tokens that overlap none of them included."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    base.sort(key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
    tested = []
    for m in LONG.finditer(text):
        if kind := encoding(m[0]):
            p_random, p_text = battery(m[0], kind, shifts)
            n = m.end() - m.start()
            tested.append((m.start(), m.end(), kind, sum(n >= s for s in STRATA), p_random, min(LAST, int(-math.log10(max(p_text, 1e-300)) / BIN))))
    return base, tested


def characters(docs: DataFrame, text: str = "text") -> list[int]:
    """How often each of the first 128 characters stands in all texts, long tokens left out: they may be random."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for batch in pieces(batches, 0):
            total += np.bincount(np.frombuffer(LONG.sub("", " ".join(batch.column(0).drop_null().to_pylist())).encode(), np.uint8), minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(range(128), pa.int32()), pa.array(total[:128])], names=["c", "n"])

    out = [0] * 128
    for r in docs.select(text).mapInArrow(run, "c int, n bigint").groupBy("c").agg(F.sum("n").alias("n")).collect():  # 128 rows
        out[r.c] = r.n
    return out


def tested(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_tested`` (all candidates with their p-values)."""
    shifts = text_shifts(characters(docs, text))
    docs = clear(docs, "secret_base", "secret_tested", "secret_more")
    at = docs.columns.index(text)
    schema = T.StructType([*docs.schema.fields, T.StructField("secret_base", FOUND), T.StructField("secret_tested", TESTED)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            got = [scan(t or "", shifts) for t in batch.column(at).to_pylist()]
            base = pa.array([[{"kind": k, "s": s, "e": e} for k, s, e in b] for b, _ in got], _FOUND)
            more = pa.array([[dict(zip(("s", "e", "encoding", "stratum", "p_random", "bin"), x, strict=True)) for x in t] for _, t in got], _TESTED)
            yield pa.RecordBatch.from_arrays([*batch.columns, base, more], names=names)

    return docs.mapInArrow(run, schema)


def limits(found: DataFrame, false_share: float = FALSE_SHARE) -> list[int]:
    """Per length class the least bin of -log10 p(text) that the procedure accepts, over all candidates."""
    counts = found.select(F.explode("secret_tested").alias("c")).groupBy("c.stratum", "c.bin").count().collect()  # at most 3 x 301 rows
    out = []
    for stratum in range(len(STRATA) + 1):
        rows = {r.bin: r["count"] for r in counts if r.stratum == stratum}
        m, k, best = sum(rows.values()), 0, LAST + 1
        for b in sorted(rows, reverse=True):
            k += rows[b]
            if 10 ** (-b * BIN) <= false_share * k / m:
                best = b
        out.append(best)
    return out


def find(docs: DataFrame, text: str = "text", carry_text: bool = True) -> DataFrame:
    """``docs`` with ``secret_base`` (kind, s, e) and ``secret_more``: accepted tokens clear of base spans.

    Texts are scanned once; what was found is written to the shared folder, then filtered by the limits
    that all candidates of the corpus give.
    """
    got = tested(docs, text)
    got = cut(got if carry_text else got.drop(text), "secrets")
    cuts = F.array(*(F.lit(b) for b in limits(got)))
    own = [c for c in got.columns if c != "secret_tested"]
    more = F.filter("secret_tested", lambda c: (c.p_random >= RANDOM_LEAST) & (c.bin >= F.get(cuts, c.stratum)) & ~F.exists("secret_base", lambda b: (b.s < c.e) & (c.s < b.e)))
    return got.select(*own, F.transform(more, lambda c: F.struct(F.lit("random").alias("kind"), c.s.alias("s"), c.e.alias("e"))).alias("secret_more"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by ``<secret>``; overlapping spans by one mark; null stays null."""
    docs = clear(docs, "secret_base", "secret_tested", "secret_more")
    got = find(docs, text)
    own = docs.columns
    at = own.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, base, more in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist(), strict=True):
                spans = sorted((x["s"], x["e"]) for x in [*base, *more])
                parts, p = [], 0
                for s, e in spans:
                    if s >= p:
                        parts += [t[p:s], "<secret>"]
                    p = max(p, e)
                out.append(None if t is None else t if not spans else "".join([*parts, t[p:]]))
            columns = list(batch.columns[: len(own)])
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=own)

    return got.select(*own, "secret_base", "secret_more").mapInArrow(run, docs.schema)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, the hash of the base spans and all spans, by start, then kind as listed."""
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x.kind, x.s.cast("string"), x.e.cast("string"))), ",")
    rank = F.create_map(*(F.lit(v) for i, k in enumerate((*KINDS, "random")) for v in (k, i)))
    every = F.sort_array(F.transform(F.concat("secret_base", "secret_more"), lambda x: F.struct(x.s.alias("s"), rank[x.kind].alias("r"), x.e.alias("e"), x.kind.alias("kind"))))
    count = lambda k: F.size(F.filter("secret_base", lambda x: x.kind == k)).cast("long").alias(f"n_{k}")
    return found.select(key, *(count(k) for k in KINDS), F.sha2(line(F.col("secret_base")), 256).alias("base_sha256"), line(every).alias("spans"), F.size("secret_more").cast("long").alias("n_more"))
