"""Media columns: chroma fingerprints of recordings and their alignment.

A recording (WAV bytes, PCM of 8 to 32 bits, any rate) is brought to ``RATE`` and becomes pitch-class frames; differences of
rectangle sums over an integral image of the frames (filters that see height, time and centre contrasts) are quantised to two
bits each and packed into 32-bit integers, one per frame. The quantiser's margins say which ``DOUBTS`` bits of a frame are the least
certain. Recordings align by the histogram of offsets at which an integer of the query, with any of its doubtful bits turned, equals one of
the other recording; it counts where the integers around it (``AROUND`` frames away) differ in no more than a share ``NEAR`` of
their bits. Every offset with ``VOTES`` of them and ``GAP + VOTES`` frames of overlap (fewer for shorter
recordings) is checked by the share of differing bits, at most ``ERROR``, and the best of those that pass is the match.

Recordings with equal fingerprints are one class; only class representatives are matched. Integers and
positions are joined and counted by (query, recording, offset), so no pair is made without an equal integer. A run of one integer (a held tone)
is one row: two runs of L and M frames give L + M offsets with their votes, not L * M rows, and their neighbours aren't compared. An integer that very many
recordings share is a skewed key of a sort-merge join, which adaptive execution splits. The integer of no contrast (``FLAT``: silence, noise without pitch) gives no vote.
The offsets of a pair are checked together, so its fingerprints are sent once. Long recordings are read, resampled and transformed in blocks.

Defined results: null, empty, too short or undecodable audio (compressed or floating-point formats too) has an empty fingerprint, is a class of its own and
matches nothing; empty tables give empty tables; rows that repeat an id are matched each by their audio;
other columns pass through ``fingerprints``.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import clear, cut

RATE = 4000  # samples a second
FRAME, HOP, BLOCK = 512, 128, 1 << 18
LOW, HIGH = 200.0, 1900.0
FILTERS, SPAN = 16, 16
GAP = 8
AROUND = (8, 16)  # frames, to either side
STEP = 0.3  # of log contrast between two levels
FLAT = 0x55555555  # no filter sees a contrast
VOTES = 3
DOUBTS = 6
#: Largest share of differing bits of a match, and of the integers around a vote: recall falls beyond the first (README).
ERROR, NEAR = 0.16, 0.30
ROWS = 64  # recordings worked on together


def filters() -> list[tuple[int, int, int, int]]:
    """(kind, lowest pitch class, height, width) by rule: kinds turn, heights 2 to 6, widths 4 to ``SPAN``."""
    return [(k % 4, (5 * k) % 12, 2 + 2 * (k % 3), (4, 8, 12, SPAN)[(k // 4) % 4]) for k in range(FILTERS)]


def _samples(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples, -1 to 1, of little-endian PCM."""
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        x = np.zeros((len(raw) // 3, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = x.view("<i4").ravel().astype(np.float32) / 2**31
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1)


def resampled(x: np.ndarray, rate: int, start: int, first: int, upto: int) -> np.ndarray:
    """Samples ``first`` to ``upto`` at ``RATE`` from x, whose first sample is number ``start`` at ``rate``."""
    half = 8 * max(1, -(-rate // RATE))
    t = np.arange(-half, half + 1)
    band = 0.9 * min(1.0, RATE / rate)
    kernel = np.sinc(band * t) * np.hanning(2 * half + 3)[1:-1]
    smooth = np.convolve(x, kernel / kernel.sum(), "same")
    return np.interp(np.arange(first, upto) * (rate / RATE) - start, np.arange(len(x)), smooth).astype(np.float32)


def read(data: bytes | None) -> tuple[np.ndarray, int]:
    """Samples (mono, -1 to 1) at ``RATE``, and it; empty if they can't be decoded."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            n, rate, form = w.getnframes(), w.getframerate(), (w.getsampwidth(), w.getnchannels())
            if rate == RATE:
                return _samples(w.readframes(n), *form).astype(float), RATE
            out, total, edge = [], n * RATE // rate, 16 * max(1, -(-rate // RATE))
            for first in range(0, total, BLOCK):
                upto = min(total, first + BLOCK)
                lo, hi = max(0, first * rate // RATE - edge), min(n, upto * rate // RATE + edge)
                w.setpos(lo)
                out.append(resampled(_samples(w.readframes(hi - lo), *form), rate, lo, first, upto))
            return np.concatenate(out or [np.zeros(0)]).astype(float), RATE
    except (wave.Error, EOFError, ValueError, ZeroDivisionError):
        return np.zeros(0), RATE


def chroma(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames x 12 pitch classes, each frame of unit sum (silence: zeros)."""
    if rate != RATE:
        x = resampled(x, rate, 0, 0, len(x) * RATE // rate)
    if len(x) < FRAME:
        return np.zeros((0, 12))
    f = np.fft.rfftfreq(FRAME, 1 / RATE)
    use = (f >= LOW) & (f <= HIGH)
    to = np.zeros((len(f), 12))
    to[np.nonzero(use)[0], np.round(12 * np.log2(f[use] / 440)).astype(int) % 12] = 1
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, some = np.hanning(FRAME), BLOCK // FRAME
    c = np.concatenate([np.abs(np.fft.rfft(frames[i : i + some] * window, axis=1)) ** 2 @ to for i in range(0, len(frames), some)])
    return c / np.maximum(c.sum(1, keepdims=True), 1e-9)


def fingerprint(c: np.ndarray) -> np.ndarray:
    """One packed integer per frame from which ``SPAN`` frames on are there."""
    return fingerprint_and_doubts(c)[0]


def fingerprint_and_doubts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprint, and for each of its integers a mask of the ``DOUBTS`` bits that the least change of a contrast turns."""
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 25))  # pitch classes twice: rectangles wrap around the octave
    image[1:, 1:] = np.tile(c, 2).cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t: int, w: int, y: int, h: int) -> np.ndarray:
        return image[at + t + w, y + h] - image[at + t, y + h] - image[at + t + w, y] + image[at + t, y]

    out, margins = np.zeros(n, np.uint32), np.zeros((n, FILTERS), np.float32)
    turns = np.zeros((n, FILTERS), np.uint32)
    for k, (kind, y, h, w) in enumerate(filters()):
        whole = area(0, w, y, h)
        if kind == 0:  # band against the rest of the octave
            part, rest = whole, area(0, w, y + h, 12 - h)
        elif kind == 1:  # lower against upper half
            part, rest = area(0, w, y, h // 2), area(0, w, y + h // 2, h - h // 2)
        elif kind == 2:  # earlier against later half
            part, rest = area(0, w // 2, y, h), area(w // 2, w - w // 2, y, h)
        else:  # middle against both sides
            part = area(w // 4, w // 2, y, h)
            rest = whole - part
        level = np.log((0.05 * w + part) / (0.05 * w + rest))
        grade = (level > -STEP).astype(np.uint32) + (level > 0) + (level > STEP)
        out |= (grade ^ (grade >> np.uint32(1))).astype(np.uint32) << np.uint32(2 * k)  # neighbours differ in one bit
        middle = np.abs(level) < STEP / 2  # the nearest edge is that in the middle, between 01 and 11
        margins[:, k] = np.where(middle, np.abs(level), np.abs(np.abs(level) - STEP))
        turns[:, k] = np.uint32(1) << (2 * k + middle).astype(np.uint32)
    least = np.argsort(margins, axis=1, kind="stable")[:, :DOUBTS]
    return out, np.bitwise_or.reduce(np.take_along_axis(turns, least, 1), axis=1)


def fingerprints(recordings: DataFrame, column: str = "audio", to_wav: Callable[[object], bytes] | None = None) -> DataFrame:
    """``recordings`` with ``fp`` and ``doubt``, both array<int>. ``to_wav`` turns the column's values into WAV bytes first."""
    recordings = clear(recordings, *({"fp", "doubt"} - {column}))
    at = recordings.columns.index(column)
    ints = T.ArrayType(T.IntegerType())
    schema = T.StructType([*(f for i, f in enumerate(recordings.schema.fields) if i != at), T.StructField("fp", ints), T.StructField("doubt", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, ROWS):
                batch = whole.slice(lo, ROWS)
                prints = []
                for v in batch.column(at).to_pylist():
                    data = v if to_wav is None or v is None else to_wav(v)
                    prints.append([x.view(np.int32) for x in fingerprint_and_doubts(chroma(*read(data)))])
                rest = [c for i, c in enumerate(batch.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*rest, *(pa.array(x, pa.list_(pa.int32())) for x in zip(*prints, strict=True))], names=schema.names)

    return recordings.mapInArrow(run, schema)


def probes(prints: np.ndarray, doubts: np.ndarray) -> np.ndarray:
    """Each integer with every choice of its doubtful bits turned: a row for each."""
    out = prints[:, None]
    left = doubts.copy()
    for _ in range(DOUBTS):
        lowest = left & (~left + np.uint32(1))
        out = np.concatenate([out, out ^ lowest[:, None]], axis=1)
        left ^= lowest
    return out


def around(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The integers before and those after each frame, each two in one of 64 bits, and whether they are missing."""
    n, wide = len(prints), prints.astype(np.uint64)
    one, two = AROUND
    back, ahead = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    back[two:] = wide[two - one : n - one] << np.uint64(32) | wide[: max(0, n - two)]
    ahead[: max(0, n - two)] = wide[one : n - two + one] << np.uint64(32) | wide[two:]
    at = np.arange(n)
    return back.view(np.int64), ahead.view(np.int64), at < two, at >= n - two


def posts(reps: DataFrame, name: str, probe: bool) -> DataFrame:
    """A row for each run of an integer that may vote (``probe``: for each integer near it): where it starts, its length and the integers around."""
    kind = dict(reps.dtypes)["class_id"]
    schema = f"{name} {kind}, {name}_n int, {name}_at int, {name}_run int, {name}_print int, {name}_back bigint, {name}_ahead bigint"
    names, some = [c.split()[0] for c in schema.split(", ")], BLOCK >> (DOUBTS if probe else 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, (fp, doubt) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                prints = np.asarray(fp.values).astype(np.int32).view(np.uint32)
                doubts = np.asarray(doubt.values).astype(np.int32).view(np.uint32) if probe else None
                differs = (prints[1:] != prints[:-1]) | (False if doubts is None else doubts[1:] != doubts[:-1])
                starts = np.concatenate([[0], np.nonzero(differs)[0] + 1])
                length = np.diff(np.append(starts, len(prints)))
                votes = prints[starts] != FLAT
                starts, length = starts[votes], length[votes]
                back, ahead, no_back, no_ahead = around(prints)
                for lo in range(0, len(starts), some):
                    at, long = starts[lo : lo + some], length[lo : lo + some]
                    keys = prints[at][:, None] if doubts is None else probes(prints[at], doubts[at])
                    each = keys.shape[1]
                    side = [pa.array(np.repeat(x[at], each), mask=np.repeat(no[at] | (long > 1), each)) for x, no in ((back, no_back), (ahead, no_ahead))]
                    own = pa.repeat(batch.column(0)[row], keys.size)
                    ints = [np.full(keys.size, len(prints), np.int32), np.repeat(at, each).astype(np.int32), np.repeat(long, each).astype(np.int32), keys.ravel().view(np.int32)]
                    yield pa.RecordBatch.from_arrays([own, *map(pa.array, ints), *side], names=names)

    return reps.select("class_id", "fp", "doubt").mapInArrow(run, schema)


def errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[int, float]:
    """(frames that overlap, share of differing bits) with b moved by offset against a."""
    lo, hi = max(0, offset), min(len(a), len(b) + offset)
    if hi <= lo:
        return 0, 1.0
    return hi - lo, float(np.bitwise_count(a[lo:hi] ^ b[lo - offset : hi - offset]).mean() / 32)


def align(prints: DataFrame, key: str, is_query) -> DataFrame:
    """Matches of every query among all: ``(key, class_id, is_query, match_class, offset, votes, bit_error)``.

    One row per recording that is no query or matches nothing (nulls), else one per matched class; class_id
    and match_class are the smallest id of the recordings with that fingerprint.
    """
    some, asks = F.size("fp") > 0, F.coalesce(is_query, F.lit(False))
    table = cut(prints.select(F.col(key), "fp", F.when(asks, F.col("doubt")).alias("doubt"), F.when(some, F.xxhash64("fp")).alias("h1"), F.when(some, F.hash("fp")).alias("h2"), asks.alias("is_query")), "prints")
    first = F.min(F.when(F.col("is_query"), F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "doubt")))  # those of the query with the smallest id
    sets = table.where("h1 is not null").groupBy("h1", "h2").agg(F.min(key).alias("class_id"), F.max("is_query").alias("asks"), F.first("fp").alias("fp"), first["doubt"].alias("doubt"))
    reps = cut(sets, "classes")

    sides = [(F.col(f"q_{s}"), F.col(f"r_{s}")) for s in ("back", "ahead")]
    bits = sum((F.coalesce(F.bit_count(q.bitwiseXOR(r)), F.lit(0)) for q, r in sides), F.lit(0))
    there = sum((F.when(q.isNotNull() & r.isNotNull(), 64).otherwise(0) for q, r in sides), F.lit(0))
    met = posts(reps.where("asks"), "q", True).join(posts(reps, "r", False), (F.col("q_print") == F.col("r_print")) & (bits <= NEAR * there))
    # Two runs agree at every offset at which they overlap, in as many frames as do.
    least = F.col("q_at") - F.col("r_at") - F.col("r_run") + 1
    met = met.select("q", "r", "q_n", "r_n", "q_at", "r_at", "q_run", "r_run", F.explode(F.sequence(least, least + F.col("q_run") + F.col("r_run") - 2)).alias("offset"))
    start = F.col("r_at") + F.col("offset")
    agree = F.least(F.col("q_at") + F.col("q_run"), start + F.col("r_run")) - F.greatest("q_at", start)
    votes = met.groupBy("q", "r", "q_n", "r_n", "offset").agg(F.sum(agree).alias("votes"))
    # A short recording needs no more votes or frames than it has.
    overlap = F.least("q_n", F.col("r_n") + F.col("offset")) - F.greatest("offset", F.lit(0))
    able = votes.where((F.col("votes") >= F.least(F.lit(VOTES), "q_n", "r_n")) & (overlap >= F.least(F.lit(GAP + VOTES), "q_n", "r_n")))
    # At most as many offsets as the two recordings have frames; the best come first.
    tried = able.groupBy("q", "r").agg(F.sort_array(F.collect_list(F.struct("votes", (-F.abs("offset")).alias("near"), "offset")), asc=False).alias("offsets"))
    fp = reps.select("class_id", "fp")
    both = tried.join(fp.select(F.col("class_id").alias("q"), F.col("fp").alias("qf")), "q").join(fp.select(F.col("class_id").alias("r"), F.col("fp").alias("rf")), "r").select("q", "r", "offsets.votes", "offsets.offset", "qf", "rf")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first offset of each pair at which no more than ``ERROR`` of the bits differ."""
        for batch in batches:
            rows, got = [], []
            for row, (votes, offsets, a, b) in enumerate(zip(*batch.columns[2:], strict=True)):
                a, b = (np.asarray(x.values).astype(np.int32).view(np.uint32) for x in (a, b))
                for n, o in zip(np.asarray(votes.values).tolist(), np.asarray(offsets.values).tolist(), strict=True):
                    if (e := errors(a, b, o)[1]) <= ERROR:
                        rows.append(row)
                        got.append((n, o, e))
                        break
            n, o, e = zip(*got, strict=True) if got else ((), (), ())
            own = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(o, pa.int32()), pa.array(e, pa.float64())], names=["q", "r", "votes", "offset", "bit_error"])

    kind = dict(reps.dtypes)["class_id"]
    best = both.mapInArrow(confirm, f"q {kind}, r {kind}, votes bigint, offset int, bit_error double")
    matches = best.select(F.col("q").alias("class_id"), F.lit(True).alias("is_query"), F.col("r").alias("match_class"), "offset", "votes", "bit_error")
    rows = table.join(reps.select("h1", "h2", "class_id"), ["h1", "h2"], "left").select(key, F.coalesce("class_id", key).alias("class_id"), "is_query")
    return rows.join(matches, ["class_id", "is_query"], "left").select(key, "class_id", "is_query", "match_class", "offset", "votes", "bit_error")


NOTE = 256


def sounded(vector: list[float]) -> bytes:
    """A vector as a recording: each coordinate a short tone, its value the pitch."""
    v = np.nan_to_num(np.array([0.0 if x is None else x for x in vector], float), posinf=0, neginf=0)
    pitch = 220 * 2 ** ((np.round(np.clip(v, -50, 50) * 48) % 24) / 12)
    t = np.arange(NOTE) / RATE
    tone = np.sin(2 * np.pi * pitch[:, None] * t) * np.hanning(NOTE) * 0.6
    sink = io.BytesIO()
    with wave.open(sink, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes((tone.reshape(-1) * 32767).astype("<i2").tobytes())
    return sink.getvalue()
