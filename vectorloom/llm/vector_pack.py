"""Packing as vector bin packing: simultaneous limits on tokens, segments and loss-bearing tokens.

A sequence is filled item by item: of the waiting examples that fit in every dimension, the one whose
demand has the largest weighted dot product with what the sequence has left comes next (weights: one over
the mean demand of the dimension). If none fits and cutting is allowed, one is cut to what is left.

Examples are packed within pools of at most ``POOL`` neighbours of one task, so the work grows in
proportion to the input, no row is shuffled, and a lost task is simply run again with the same result.
What a pool leaves is cut into sequences whose lengths are powers of two, so that nothing is padded.

``pack_conversations`` has three limits that differ: tokens, runs of turns and the tokens of the answers, which alone bear
loss. A conversation that fits is one run; a longer one is split between turns, and a turn is cut only where it
exceeds a limit by itself, so that every piece bears loss throughout or not at all.

Defined results: null text is empty text (one id, the end mark); empty tables give empty tables; repeated
rows are packed each; texts of any length are cut; other columns don't take part.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

TOKENS, SEGMENTS, LOSS = 2048, 512, 2048
END = 1
POOL = 4096

Piece = tuple[int, int, int, int, int]  # example, start, length, sequence, offset


def pack(tokens: Sequence[int], loss: Sequence[float] | None = None, limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS), cut: bool = True, powers: bool = True) -> list[Piece]:
    """Pieces of one pool. ``loss``: the loss-bearing share of each example's tokens (1 if not given).

    With ``cut`` an example may be split at any token; without, one over the limits raises ValueError.
    With ``powers`` the last, partly filled sequence is split into lengths that are powers of two.
    """
    most, segments, bearing = limits
    share = np.ones(len(tokens)) if loss is None else np.asarray(loss, float)
    left = np.asarray(tokens, np.int64).copy()
    start = np.zeros(len(left), np.int64)
    out: list[Piece] = []
    sequence = 0
    # The longest piece of each example that a sequence of its own takes.
    room = np.minimum(most, np.floor(bearing / np.maximum(share, 1e-9))).astype(np.int64)
    if not cut and (left > room).any():
        raise ValueError("an example exceeds the limits of a sequence")
    for i in np.nonzero(left >= room)[0] if cut else ():
        while left[i] >= room[i] > 0:
            out.append((int(i), int(start[i]), int(room[i]), sequence, 0))
            start[i] += room[i]
            left[i] -= room[i]
            sequence += 1
    live = np.nonzero(left > 0)[0]
    weight = np.array([1 / most, 1 / segments, 1 / bearing])
    if len(live):
        weight = 1 / np.maximum(1e-9, [left[live].mean(), 1.0, (left[live] * share[live]).mean()])
    fill: list[Piece] = []
    rest, slots, loss_left, offset = most, segments, float(bearing), 0

    def close() -> None:
        nonlocal fill, rest, slots, loss_left, offset, sequence
        out.extend(fill)
        sequence += bool(fill)
        fill, rest, slots, loss_left, offset = [], most, segments, float(bearing), 0

    # Waiting examples by length; equal demand keeps the given order.
    live = live[np.argsort(-left[live], kind="stable")]
    while len(live):
        demand = left[live]
        fits = (demand <= rest) & (demand * share[live] <= loss_left + 1e-9) if slots else np.zeros(len(live), bool)
        if fits.any():
            dot = demand * (rest * weight[0] ** 2) + slots * weight[1] ** 2 + demand * share[live] * (loss_left * weight[2] ** 2)
            k = int(np.argmax(np.where(fits, dot, -1.0)))
            size = int(demand[k])
        else:
            k = 0
            size = int(min(rest, loss_left // max(share[live[0]], 1e-9))) if cut and slots else 0
            if size <= 0:
                close()
                continue
        i = int(live[k])
        fill.append((i, int(start[i]), size, sequence, offset))
        rest, slots, loss_left, offset = rest - size, slots - 1, loss_left - size * share[i], offset + size
        start[i] += size
        left[i] -= size
        if left[i] == 0:
            live = np.delete(live, k)
        elif k + 1 < len(live):  # a cut example keeps its place by length
            rest_of = np.delete(live, k)
            live = np.insert(rest_of, np.searchsorted(-left[rest_of], -left[i], side="right"), i)
        if rest == 0 or slots == 0 or loss_left < 1e-9:
            close()
    if fill and cut and powers and offset < most:
        last, fill = fill, []
        sizes = [1 << b for b in reversed(range(offset.bit_length())) if offset >> b & 1]
        room_left, at = sizes.pop(0), 0
        for i, s, n, _, _ in last:
            while n:
                take = min(n, room_left)
                out.append((i, s, take, sequence, at))
                s, n, at, room_left = s + take, n - take, at + take, room_left - take
                if not room_left:
                    sequence += 1
                    room_left, at = (sizes.pop(0) if sizes else 0), 0
    else:
        close()
    return out


def ranks_of(model: dict) -> dict[bytes, int] | None:
    """Token bytes to rank of a vocabulary file's content, if it is plain byte-level BPE whose merges are in the order of their ids."""
    own, before = model["model"], model["pre_tokenizer"] or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
    if own.get("type") != "BPE" or not plain or model["normalizer"] or own.get("continuing_subword_prefix") or own.get("end_of_word_suffix"):
        return None
    # Bytes that print stand for themselves, the others for code points from 256 on.
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in prints)}
    if any(x not in byte for token in own["vocab"] for x in token):
        return None
    ranks = {bytes(byte[x] for x in token): i for token, i in own["vocab"].items()}
    ids = [own["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in own["merges"]]
    return ranks if None not in ids and ids == sorted(ids) and len(ids) + 256 == len(ranks) else None


def encoder(path: str):
    """``text -> ids`` as the tokenizers library gives for the vocabulary file at ``path``.

    Plain byte-level BPE (by the file's content) is encoded by its ranks, which is faster; the strings of special tokens in a
    text are their ids, as the library reads them.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    if ranks := ranks_of(model):
        import public_tokenizers
        import tiktoken

        special = {x["content"]: x["id"] for x in model["added_tokens"]}
        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: own.encode(text, allowed_special="all") if any(x in text for x in special) else own.encode_ordinary(text)
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(path)
    return lambda text: other.encode(text, add_special_tokens=False).ids


SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", limits: tuple[int, int, int] = (TOKENS, SEGMENTS, LOSS)) -> DataFrame:
    """Pieces of all documents: ids of the text, then the end mark; every token bears loss.

    ``sequence_id`` holds the task in its upper half, so sequences of different tasks never meet.
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        task, used = TaskContext.get().partitionId(), 0
        for whole in pieces(batches, 1, 16 << 20):
            for lo in range(0, whole.num_rows, POOL):
                batch = whole.slice(lo, POOL)
                keys = batch.column(0).to_pylist()
                ids = [np.append(np.asarray(encode(t or ""), "<u4"), np.uint32(END)) for t in batch.column(1).to_pylist()]
                rows = pack([len(x) for x in ids], limits=limits)
                columns = [
                    [keys[i] for i, *_ in rows], [s for _, s, *_ in rows], [n for _, _, n, *_ in rows],
                    [zlib.crc32(ids[i][s : s + n].tobytes()) for i, s, n, *_ in rows], [len(ids[i]) for i, *_ in rows],
                    [(task << 32) + used + q for *_, q, _ in rows], [o for *_, o in rows],
                ]
                used += 1 + max((q for *_, q, _ in rows), default=-1)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    return docs.select(key, text).mapInArrow(run, SCHEMA)


def pack_examples(examples: DataFrame, key: str, tokens: str, loss: str, limits: tuple[int, int, int]) -> DataFrame:
    """Placement of whole instruction examples ``(key, tokens, loss-bearing tokens)``; none is cut."""
    kind = dict(examples.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, used = TaskContext.get().partitionId(), 0
        for whole in batches:
            for lo in range(0, whole.num_rows, POOL):
                b = whole.slice(lo, POOL)
                n = np.asarray(b.column(1).fill_null(0), np.int64)
                share = np.divide(np.asarray(b.column(2).fill_null(0), float), n, out=np.zeros(len(n)), where=n > 0)
                rows = pack(n, share, limits, cut=False, powers=False)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array(c, pa.int64()) for c in ([r[2] for r in rows], [(task << 32) + used + r[3] for r in rows], [r[4] for r in rows]))], names=[key, "length", "sequence_id", "offset"])
                used += 1 + max((r[3] for r in rows), default=-1)

    return examples.select(key, tokens, loss).mapInArrow(run, f"{key} {kind}, length bigint, sequence_id bigint, offset bigint")


#: Limits of instruction data: tokens, runs of turns and loss-bearing tokens of a sequence; turns of a conversation that may share a run.
CHAT, BEARS, TOGETHER = (2048, 6, 1024), "assistant", 64
CHAT_SCHEMA = "turn bigint, start bigint, length bigint, bears boolean, run bigint, sequence_id bigint, offset bigint"

Turn = tuple[object, int, int, int, bool]  # conversation, turn, start, length, bears loss


def runs(turns: Iterator[tuple[object, object, int, int, bool]], limits: tuple[int, int, int]) -> Iterator[list[Turn]]:
    """Runs within the limits from (conversation, group, turn, tokens, bears) in order."""
    most, _, bearing = limits
    run: list[Turn] = []
    size, loss, last = 0, 0, None
    for key, group, turn, n, bears in turns:
        start, now = 0, (key, group)
        while n:
            fits = now == last and n <= most - size and (not bears or n <= bearing - loss)
            if run and not fits:
                yield run
                run, size, loss = [], 0, 0
            last = now
            take = min(n, most - size, bearing - loss if bears else n)
            run.append((key, turn, start, take, bears))
            size, loss, start, n = size + take, loss + take * bears, start + take, n - take
    if run:
        yield run


def pack_conversations(turns: DataFrame, path: str, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", limits: tuple[int, int, int] = CHAT) -> DataFrame:
    """Pieces of all turns: ids of each turn's text and the end mark; those of answers bear loss. ``run`` counts within a sequence.

    Turns come together by conversation and groups of ``TOGETHER`` turns: a conversation of any length is no task by itself.
    """
    kind = dict(turns.dtypes)[key]
    rows = turns.select(F.col(key).alias("k"), F.col(turn).cast("bigint").alias("t"), F.coalesce(F.col(role) == BEARS, F.lit(False)).alias("b"), F.col(text).alias("x")).withColumn("g", F.floor(F.col("t") / TOGETHER))
    dealt = rows.repartition("k", "g").sortWithinPartitions("k", "g", "t", "b", "x")
    names = [key, *(x.split()[0] for x in CHAT_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, used = encoder(path), TaskContext.get().partitionId(), 0

        def measured() -> Iterator[tuple[object, object, int, int, bool]]:
            for batch in pieces(batches, 3):
                for k, t, b, x, g in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    yield k, g, t, len(encode(x or "")) + 1, b

        def placed(pool: list[list[Turn]]) -> pa.RecordBatch:
            nonlocal used
            size = [sum(p[3] for p in r) for r in pool]
            share = [sum(p[3] for p in r if p[4]) / n for r, n in zip(pool, size, strict=True)]
            out: list[list] = [[] for _ in names]
            count: dict[int, int] = {}
            for i, _, _, q, at in pack(size, share, limits, cut=False, powers=False):
                number = count[q] = count.get(q, -1) + 1
                for k, t, s, n, b in pool[i]:
                    for column, value in zip(out, (k, t, s, n, b, number, (task << 32) + used + q, at), strict=True):
                        column.append(value)
                    at += n
            used += 1 + max(count, default=-1)
            types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 3
            return pa.RecordBatch.from_arrays([pa.array(out[0], of), *(pa.array(c, x) for c, x in zip(out[1:], types, strict=True))], names=names)

        of, pool = pa.int64() if kind == "bigint" else None, []
        for r in runs(measured(), limits):
            pool.append(r)
            if len(pool) == POOL:
                yield placed(pool)
                pool = []
        if pool:
            yield placed(pool)

    return dealt.mapInArrow(run, f"{key} {kind}, {CHAT_SCHEMA}")
