"""Exact removal of repeated byte strings by a prefix-free parse of the corpus.

Rolling hashes of ``TRIGGER`` bytes are taken over every document; in each window of ``WINDOW`` bytes the
least hash (leftmost on ties) is its trigger. The windows of one trigger occurrence are contiguous: the bytes
they cover are a *phrase*, and no phrase is a proper prefix of another with the same trigger and offset.
Equal windows have the same trigger at the same offset, so the corpus's suffix order, cut at ``WINDOW``
bytes, falls apart by trigger and is found in two levels:

* parse: equal phrases (trigger hash, phrase hash) meet; all but the first document's are covered whole;
* dictionary: phrases of one trigger that differ are sorted as a suffix array of their windows; neighbours
  with a common prefix of ``WINDOW`` bytes are equal, the least document stays (bytes are compared).

Phrases of a block of documents are distinct before they are shuffled and answers are a few bits a phrase,
so a passage that a third of all documents hold costs one entry per block. The dictionary gets bytes only
of phrases whose trigger has several; their windows are sorted in slices by a hash, so that many phrases cost their
bytes and no arrays over all their windows. A trigger of more than ``HOT`` phrases is dealt on by what stands beside it: windows that reach
``CONTEXT`` bytes beyond the trigger meet by these bytes, the others, which reach as far before it, by those before. Equal windows agree in both, so a
phrase goes to two places at most, and a trigger that a third of the text shares is many tasks. Documents reach their block once, compressed;
what they keep is put together in runs of ``PIECE`` bytes.

Defined results: null text is empty; null ids are neither removed nor cause removals; rows that repeat an
id don't remove each other; texts below ``WINDOW`` bytes stay; empty tables give empty tables; other columns
don't take part; whole texts of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .common import block_count, freed
from .sigtree_join import mix

WINDOW = 50
TRIGGER = 20
REACH = WINDOW - TRIGGER + 1
PIECE = 1 << 19  # bytes parsed, or put together, at a time
SLICE = 1 << 16  # windows sorted at a time
PICKS = 16  # parts in which windows are dealt to slices
HOT = 1 << 14  # phrases of a trigger that meet in one place
CONTEXT = 10  # bytes beside a trigger that part its phrases
RIGHT, LEFT = 3, 4  # kinds of messages: windows with the context after the trigger, or before it

_B = 0xD6E8FEB86659FD93
_INV = pow(_B, -1, 1 << 64)
_TABLE = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64)
MESSAGE = "bucket int, block int, kind int, blob binary"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class Parse:
    """Phrases of one document group: arrays by occurrence, in text order.

    first, last: least and largest window start; trigger: its place; key, hash: trigger and phrase; doc: index.
    """

    def __init__(self, texts: list[bytes]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])
        self.bytes = np.frombuffer(b"".join([*texts, bytes(8)]), np.uint8)
        parts = [self._piece(lo, hi) for lo, hi in self.runs()]
        self.first, self.last, self.trigger, self.key, self.hash, self.doc = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 6

    def runs(self) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``PIECE`` bytes, a longer document alone."""
        lo = 0
        while lo < len(self.size):
            hi = lo + 1
            while hi < len(self.size) and self.start[hi + 1] - self.start[lo] <= PIECE:
                hi += 1
            yield lo, hi
            lo = hi

    def _piece(self, lo: int, hi: int):
        a, n = int(self.start[lo]), int(self.start[hi] - self.start[lo])
        none = np.zeros(0, np.int64)
        if n < WINDOW:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
        b = self.bytes[a : a + n]
        with np.errstate(over="ignore"):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(_TABLE[b] * _powers(_B, n), out=total[1:])
            back = _powers(_INV, n)
            gram = (total[TRIGGER:] - total[: n + 1 - TRIGGER]) * back[: n + 1 - TRIGGER]
            # 58 bits of hash above 6 bits of offset: a minimum is the least hash, the leftmost on ties.
            least = (mix(gram) >> np.uint64(6)) << np.uint64(6)
            span = 1
            while span < REACH:
                step = min(span, REACH - span)
                least = np.minimum(least[: len(least) - step], least[step:] + np.uint64(step))
                span += step
        # Windows that lie within one document.
        ends = self.start[lo + 1 : hi + 1] - a
        doc = np.repeat(np.arange(lo, hi), self.size[lo:hi])[: len(least)]
        p = np.nonzero(np.arange(len(least)) + WINDOW <= ends[doc - lo])[0]
        if not len(p):
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
        t, d = p + (least[p] & np.uint64(63)).astype(np.int64), doc[p]
        new = np.ones(len(p), bool)
        new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
        at = np.nonzero(new)[0]
        first, last, t, d = p[at], p[np.append(at[1:], len(p)) - 1], t[at], d[at]
        with np.errstate(over="ignore"):
            body = (total[last + WINDOW] - total[first]) * back[first]
            shape = ((t - first) * 128 + (last - first)).astype(np.uint64)
            place = np.int32 if self.start[-1] < 1 << 31 else np.int64
            return (first + a).astype(place), (last + a).astype(place), (t + a).astype(place), least[first] >> np.uint64(6), mix(body + shape * np.uint64(_B)), d.astype(place)


def _planes(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplane(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width).reshape(width, n).T
    return out.reshape(-1).view("<u8")


class Block:
    """The phrases of a block with what it asks: distinct (key, hash) by bucket, each with its least document."""

    def __init__(self, blobs: list[bytes], parts: int):
        self.parts = parts
        table = blocks.take(blobs)
        self.ids = table.column("k")
        self.texts = table.column("t").cast(pa.binary()).to_pylist()
        del table
        known = np.asarray(self.ids.combine_chunks().is_valid())
        self.parse = x = Parse([t if k else b"" for t, k in zip(self.texts, known, strict=True)])
        self.id = np.asarray(self.ids.combine_chunks().fill_null(0)).astype(np.int64)
        bucket = (x.key % np.uint64(parts)).astype(np.int32)
        short = (x.key // np.uint64(parts)) & np.uint64((1 << 48) - 1)
        code = x.hash & np.uint64((1 << 48) - 1)
        doc = self.id[x.doc]
        order = np.lexsort((doc, code, short, bucket)).astype(np.int32 if len(doc) < 1 << 31 else np.int64)
        new = np.ones(len(order), bool)
        o = order
        new[1:] = (code[o[1:]] != code[o[:-1]]) | (short[o[1:]] != short[o[:-1]]) | (bucket[o[1:]] != bucket[o[:-1]])
        self.head = order[new]  # an occurrence in the least document of each distinct phrase
        self.of = np.empty(len(order), order.dtype)
        self.of[order] = np.cumsum(new) - 1
        self.bucket, self.short, self.code, self.doc = bucket[self.head], short[self.head], code[self.head], doc[self.head]
        self.later = doc > self.doc[self.of]  # a smaller document of the block has the phrase
        self.buckets, first = np.unique(self.bucket, return_index=True)
        self.slices = [slice(s, e) for s, e in zip(first, np.append(first[1:], len(self.bucket))[: len(first)], strict=True)]

    def beside(self, use: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(bucket, kind, which of them) for phrases of hot triggers: where the windows of each side meet."""
        x = self.parse
        t, first, last = (a[use].astype(np.int64) for a in (x.trigger, x.first, x.last))
        for kind, has, at in ((RIGHT, t - last <= REACH - 1 - CONTEXT, t + TRIGGER), (LEFT, t - first > REACH - 1 - CONTEXT, t - CONTEXT)):
            own = np.nonzero(has)[0]
            if not len(own):
                continue
            h = x.key[use[own]] + np.uint64(kind)
            with np.errstate(over="ignore"):
                for i in range(CONTEXT):
                    h = mix(h * np.uint64(_B) + x.bytes[at[own] + i].astype(np.uint64))
            bucket = (h % np.uint64(self.parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            to, start = np.unique(bucket[order], return_index=True)
            for b, rows in zip(to.tolist(), np.split(own[order], start[1:]), strict=True):
                yield b, kind, rows

    def asked(self, use: np.ndarray, places: bool = False) -> bytes:
        """What the dictionary needs of phrases: their number, sizes, their triggers' places if asked for, documents and bytes."""
        x = self.parse
        size = x.last[use].astype(np.int64) - x.first[use] + WINDOW
        text = x.bytes[np.repeat(x.first[use] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        place = (x.trigger[use] - x.first[use]).astype(np.uint8).tobytes() if places else b""
        return len(use).to_bytes(8, "little") + size.astype(np.uint8).tobytes() + place + self.id[x.doc[use]].astype("<i8").tobytes() + text.tobytes()

    def covered(self, whole: np.ndarray, mask: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each document and which of its bytes go. Per distinct phrase, ``whole``: an earlier block has it; ``mask``: the windows that go, as bits."""
        x = self.parse
        for lo, hi in x.runs():
            s, p = x.start[lo], slice(*np.searchsorted(x.doc, np.array([lo, hi], x.doc.dtype)))
            first, last, of = x.first[p] - s, x.last[p] - s, self.of[p]
            full = whole[of] | self.later[p]
            # Starts of covered windows: +1 and -1 at the ends of the bytes they cover.
            step = np.zeros(x.start[hi] - s + 1, np.int32)
            np.add.at(step, first[full], 1)
            np.add.at(step, last[full] + WINDOW, -1)
            some = np.nonzero(~full & (mask[of] > 0))[0]
            m = mask[of[some]]
            for k in range(REACH):
                at = first[some[(m >> np.uint64(k)) & np.uint64(1) > 0]] + k
                np.add.at(step, at, 1)
                np.add.at(step, at + WINDOW, -1)
            goes = np.cumsum(step[:-1], dtype=np.int32) > 0
            for i in range(lo, hi):
                yield i, goes[x.start[i] - s : x.start[i + 1] - s]


def _message(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int32()), "kind": pa.array([r[2] for r in rows], pa.int32()), "blob": pa.array([blocks.squeeze(r[3]) for r in rows], pa.binary())})


def _answer_parse(table: pa.Table, hot: int = HOT) -> pa.Table:
    """A byte a phrase: 1 if a smaller document has it; if it is the first, 2 where its trigger has others, 4 where it has very many."""
    sizes, key, code, doc = [], [], [], []
    for blob in table.column("blob").to_pylist():
        data = blocks.loosen(blob)
        n = int.from_bytes(data[:8], "little")
        key.append(np.cumsum(_unplane(data[8:], n, 6), dtype=np.uint64))
        code.append(_unplane(data[8 + 6 * n :], n, 6))
        doc.append(_unplane(data[8 + 12 * n :], n, 8).view(np.int64))
        sizes.append(n)
    key, code, doc = np.concatenate(key), np.concatenate(code), np.concatenate(doc)
    order = np.lexsort((doc, code, key))
    key, code, doc = key[order], code[order], doc[order]
    other_key, other = np.ones(len(key), bool), np.ones(len(key), bool)
    other_key[1:] = key[1:] != key[:-1]
    other[1:] = other_key[1:] | (code[1:] != code[:-1])
    least = doc[other][np.cumsum(other) - 1]
    group = np.cumsum(other_key) - 1
    phrases = np.bincount(group, other)[group]
    bits = np.empty(len(key), np.uint8)
    bits[order] = np.where(least < doc, 1, np.where(phrases > hot, 4, np.where(phrases > 1, 2, 0)))
    cuts = np.cumsum(sizes)[:-1]
    return _message([(b, k, 1, x.tobytes()) for b, k, x in zip(table.column("bucket").to_pylist(), table.column("block").to_pylist(), np.split(bits, cuts), strict=True)])


def _suffix_order(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order of the windows with these words, whether each equals the one before in that order)."""
    order = np.lexsort(words[::-1])
    same = np.ones(len(order), bool)
    for c in words:
        same[1:] &= c[order[1:]] == c[order[:-1]]
    same[:1] = False
    return order, same


def _words(data: bytes, at: np.ndarray) -> list[np.ndarray]:
    """The bytes of the windows that start at ``at``, as big-endian words."""
    word = np.ndarray(len(data) - 7, ">u8", data, strides=(1,))
    whole, rest = divmod(WINDOW, 8)
    out = [word[at + 8 * k].astype(np.uint64) for k in range(whole)]
    if rest:
        out.append(word[at + 8 * whole].astype(np.uint64) >> np.uint64(64 - 8 * rest))
    return out


def _windows(size: np.ndarray, lo: int, hi: int, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, place in it, start of its bytes) of the windows of the phrases from lo to hi."""
    n = size[lo:hi] - (WINDOW - 1)
    owner = np.repeat(np.arange(lo, hi), n)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    return owner, place, start[owner] + place


def _masks(size: np.ndarray, doc: np.ndarray, data: bytes) -> np.ndarray:
    """Per phrase the windows that a smaller document's phrase holds, as bits; phrases of ``size`` bytes follow each other in ``data``.

    Equal windows have the same hash, so windows fall into slices of about ``SLICE`` by it, and each is sorted by itself.
    """
    start = np.cumsum(size) - size
    upto = np.cumsum(size - (WINDOW - 1))
    total = int(upto[-1]) if len(upto) else 0
    slices = max(1, -(-total // SLICE))
    cuts = [0, *(np.nonzero(np.diff(upto // SLICE))[0] + 1).tolist(), len(size)]
    of = np.zeros(total, np.uint16 if slices < 1 << 16 else np.uint32)
    if slices > 1:
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            *_, at = _windows(size, lo, hi, start)
            h = np.zeros(len(at), np.uint64)
            with np.errstate(over="ignore"):
                for c in _words(data, at):
                    h = mix(h * np.uint64(_B) + c)
            of[upto[hi - 1] - len(at) : upto[hi - 1]] = h % np.uint64(slices)
    out = np.zeros(len(size), np.uint64)
    for part in range(min(PICKS, slices)):
        # The windows of every PICKS-th slice, in the order of slices: all are picked once, whatever their number.
        picked = np.nonzero(of % PICKS == part)[0]
        picked = picked[np.argsort(of[picked], kind="stable")]
        edges = np.nonzero(np.diff(of[picked]))[0] + 1
        for pick in np.split(picked, edges):
            if not len(pick):
                continue
            owner = np.searchsorted(upto, pick, "right")
            place = pick - upto[owner] + size[owner] - (WINDOW - 1)
            order, same = _suffix_order(_words(data, start[owner] + place))
            heads = np.nonzero(~same)[0]
            of_order = doc[owner[order]]
            least = np.minimum.reduceat(of_order, heads)[np.cumsum(~same) - 1]
            goes = order[least < of_order]
            np.bitwise_or.at(out, owner[goes], np.uint64(1) << place[goes].astype(np.uint64))
    return out


def _answer_dictionary(table: pa.Table) -> pa.Table:
    """Forwarded messages as they are; for phrases, the windows that a smaller document holds, as bits."""
    rows, asks = [], []
    for bucket, block, kind, blob in zip(*(table.column(c).to_pylist() for c in ("bucket", "block", "kind", "blob")), strict=True):
        data = blocks.loosen(blob)
        if kind == 1:
            rows.append((bucket, block, 1, data))
            continue
        n = int.from_bytes(data[:8], "little")
        rest = 8 + n if kind == 2 else 8 + 2 * n
        asks.append((bucket, block, n, np.frombuffer(data, np.uint8, n, 8), np.frombuffer(data, "<i8", n, rest), data[rest + 8 * n :], kind, data[8 + n : rest]))
    if asks:
        size = np.concatenate([a[3] for a in asks]).astype(np.int64)
        mask = _masks(size, np.concatenate([a[4] for a in asks]), b"".join(a[5] for a in asks) + bytes(16))
        for (bucket, block, *_, kind, place), m in zip(asks, np.split(mask, np.cumsum([a[2] for a in asks])[:-1]), strict=True):
            if kind != 2:
                # Windows from this one on reach the context after the trigger; the others are the other side's.
                right = np.maximum(0, np.frombuffer(place, np.uint8).astype(np.int64) - (REACH - 1 - CONTEXT)).astype(np.uint64)
                after = (m >> right) << right
                m = after if kind == RIGHT else m ^ after
            rows.append((bucket, block, kind, m.astype("<u4").tobytes()))
    return _message(rows)


def _hot(b: Block, bits: dict[int, bytes]) -> np.ndarray:
    """The block's distinct phrases that are first in a trigger of very many."""
    return np.concatenate([np.zeros(0, np.int64), *(s.start + np.nonzero(np.frombuffer(bits[k], np.uint8) & 4)[0] for k, s in zip(b.buckets.tolist(), b.slices, strict=True))])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", output: str = "digest", hot: int = HOT) -> DataFrame:
    """Per document what is removed. ``output``: "digest" (counts and a hash) or "kept" (the remaining bytes). ``hot``: phrases of a trigger that meet in one place."""
    count, parts = block_count(docs, text)
    kind = dict(docs.dtypes)[key]
    packed = blocks.blocked(docs, key, text, count)

    def ask_parse(table: pa.Table) -> pa.Table:
        b = Block(table.column("blob").to_pylist(), parts)
        block = table.column("block")[0].as_py()
        rows = []
        for bucket, s in zip(b.buckets.tolist(), b.slices, strict=True):
            short = b.short[s]
            body = _planes(np.diff(short, prepend=np.uint64(0)), 6) + _planes(b.code[s], 6) + _planes(b.doc[s], 8)
            rows.append((bucket, block, 0, len(short).to_bytes(8, "little") + body))
        return _message(rows)

    def ask_dictionary(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(bodies.column("blob").to_pylist(), parts)
        block = bodies.column("block")[0].as_py()
        bits = {k: blocks.loosen(x) for k, x in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)}
        rows = []
        for bucket, s in zip(b.buckets.tolist(), b.slices, strict=True):
            rows.append((bucket, block, 1, bits[bucket]))
            use = b.head[s][np.frombuffer(bits[bucket], np.uint8) & 2 > 0]
            if len(use):
                rows.append((bucket, block, 2, b.asked(use)))
        hot = _hot(b, bits)
        for bucket, side, own in b.beside(b.head[hot]):
            rows.append((bucket, block, side, b.asked(b.head[hot[own]], True)))
        return _message(rows)

    def build(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(bodies.column("blob").to_pylist(), parts)
        x, got = b.parse, {}
        for bucket, which, blob in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True):
            got[bucket, which] = blocks.loosen(blob)
        whole = np.zeros(len(b.head), bool)
        mask = np.zeros(len(b.head), np.uint64)
        for bucket, s in zip(b.buckets.tolist(), b.slices, strict=True):
            bits = np.frombuffer(got[bucket, 1], np.uint8)
            whole[s] = bits & 1 > 0
            if (bucket, 2) in got:
                part = np.zeros(len(bits), np.uint64)
                part[bits & 2 > 0] = np.frombuffer(got[bucket, 2], "<u4")
                mask[s] = part
        hot = _hot(b, {k: v for (k, which), v in got.items() if which == 1})
        for bucket, side, own in b.beside(b.head[hot]):
            mask[hot[own]] |= np.frombuffer(got[bucket, side], "<u4").astype(np.uint64)
        removed, runs, kept = [], [], []
        for i, c in b.covered(whole, mask):
            n = int(c.sum())
            removed.append(n)
            runs.append(int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if n else 0)
            kept.append(x.bytes[x.start[i] : x.start[i + 1]][~c].tobytes() if n else b.texts[i])
        if output == "kept":
            return pa.table({key: b.ids, "kept": pa.array(kept, pa.binary())})
        return pa.table({key: b.ids, "n_bytes": pa.array([len(t) for t in b.texts], pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]})

    first = packed.groupBy("block").applyInArrow(freed(ask_parse), MESSAGE).groupBy("bucket").applyInArrow(freed(lambda table: _answer_parse(table, hot)), MESSAGE)
    second = packed.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(freed(ask_dictionary), MESSAGE).groupBy("bucket").applyInArrow(freed(_answer_dictionary), MESSAGE)
    schema = f"{key} {kind}, " + ("kept binary" if output == "kept" else "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    return packed.groupBy("block").cogroup(second.groupBy("block")).applyInArrow(freed(build), schema)
