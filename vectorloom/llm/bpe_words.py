"""Byte-level BPE by a global shuffle of distinct words.

Pre-tokens keep their positions inside blocks of documents. Each block sends its distinct pre-tokens to
the buckets of their hash; a bucket encodes every distinct pre-token once, whatever the number of blocks
and occurrences, and sends ids back in the order asked; the block puts them together by position. Decoding
looks each id up in the token-byte table, whose size is that of the vocabulary file.

Defined results: null text is empty text (no tokens); empty tables give empty tables; repeated rows and
tied ids are encoded each; whole texts are taken, of any length; other columns don't take part.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import itertools
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks
from .common import block_count, freed

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file; the path must exist on every executor."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}


_PIECES: dict[str, object] = {}


def _single(path: str):
    """``bytes of one pre-token -> ids`` (kept per Python worker)."""
    if path not in _PIECES:
        import public_tokenizers
        import tiktoken

        own = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        _PIECES[path] = own._core_bpe.encode_single_piece
    return _PIECES[path]


def _pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def _split(words: bytes) -> list[bytes]:
    n = int.from_bytes(words[:4], "little")
    sizes = np.frombuffer(words, "<u4", n, 4)
    ends = np.cumsum(sizes, dtype=np.int64) + 4 + 4 * n
    return [words[e - s : e] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _join(words: list[bytes]) -> bytes:
    return len(words).to_bytes(4, "little") + np.array([len(w) for w in words], "<u4").tobytes() + b"".join(words)


def _placed(parts: list[bytes], unit: str) -> Callable[[np.ndarray], bytes]:
    """Numbers of parts to the parts one after the other, moved in whole items of type ``unit``."""
    data = np.frombuffer(b"".join(parts), unit)
    size = np.array([len(x) for x in parts], np.int64) // data.itemsize
    start = np.cumsum(size) - size

    def put(at: np.ndarray) -> bytes:
        n = size[at]
        return data[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()

    return put


def encoded(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids binary)``: little-endian 32-bit ids of every text; see ``digest`` for the query's columns."""
    return _run(docs, path, key, text, digest=False)


def digest(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the number of ids, their hash, and the hash of the decoded bytes."""
    return _run(docs, path, key, text, digest=True)


def _run(docs: DataFrame, path: str, key: str, text: str, digest: bool) -> DataFrame:
    count, parts = block_count(docs, text)
    kind = dict(docs.dtypes)[key]
    packed = blocks.blocked(docs, key, text, count)

    def ask(table: pa.Table) -> pa.Table:
        find = _pattern().findall
        words: set[str] = set()
        for t in blocks.take(table.column("blob").to_pylist()).column("t").to_pylist():
            words.update(find(t))
        by: list[list[bytes]] = [[] for _ in range(parts)]
        for w in map(str.encode, words):
            by[zlib.crc32(w) % parts].append(w)
        block = table.column("block")[0].as_py()
        got = [(i, blocks.squeeze(_join(sorted(w)))) for i, w in enumerate(by) if w]
        return pa.table({"bucket": pa.array([i for i, _ in got], pa.int32()), "block": pa.array([block] * len(got), pa.int32()), "blob": pa.array([b for _, b in got], pa.binary())})

    def encode(table: pa.Table) -> pa.Table:
        single, known, out = _single(path), {}, []
        for blob in table.column("blob").to_pylist():
            words = _split(blocks.loosen(blob))
            ids = []
            for w in words:
                if (x := known.get(w)) is None:
                    x = known[w] = np.array(single(w), "<u4").tobytes()
                ids.append(x)
            out.append(blocks.squeeze(_join(ids)))
        return pa.table({"bucket": table.column("bucket"), "block": table.column("block"), "blob": pa.array(out, pa.binary())})

    def build(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        find = _pattern().findall
        replies = {b: r for b, r in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)}
        whole = blocks.take(bodies.column("blob").to_pylist())
        # Pre-tokens by number: each text is split once, positions are kept as arrays.
        number: dict[str, int] = collections.defaultdict(itertools.count().__next__)
        get = number.__getitem__
        texts = [np.fromiter(map(get, find(t)), np.uint32) for t in whole.column("t").to_pylist()]
        # The same distinct pre-tokens in the same order as asked, so that answers need no words.
        by: dict[int, list[tuple[bytes, int]]] = {}
        for w, i in number.items():
            w = w.encode()
            by.setdefault(zlib.crc32(w) % parts, []).append((w, i))
        ids: list[bytes] = [b""] * len(number)
        for bucket, asked in by.items():
            for (_, i), x in zip(sorted(asked), _split(blocks.loosen(replies[bucket])), strict=True):
                ids[i] = x
        del number, by, replies
        keys, forward = whole.column("k"), _placed(ids, "<u4")
        if not digest:
            return pa.table({key: keys, "ids": pa.array([forward(t) for t in texts], pa.binary())})
        # Ids are decoded through the token-byte table, those of each distinct pre-token once.
        table = {r: t for t, r in read_ranks(path).items()}.__getitem__
        back = _placed([b"".join(map(table, np.frombuffer(x, "<u4").tolist())) for x in ids], "u1")
        rows = ((forward(t), back(t)) for t in texts)
        got = [(len(a) // 4, hashlib.sha256(a).hexdigest(), hashlib.sha256(b).hexdigest()) for a, b in rows]
        n, one, two = zip(*got, strict=True) if got else ((), (), ())
        return pa.table({key: keys, "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(one, pa.string()), "decoded_sha256": pa.array(two, pa.string())})

    requests = packed.groupBy("block").applyInArrow(freed(ask), blocks.REQUESTS)
    replies = requests.groupBy("bucket").applyInArrow(freed(encode), blocks.REQUESTS)
    schema = f"{key} {kind}, " + ("n_tokens bigint, ids_sha256 string, decoded_sha256 string" if digest else "ids binary")
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(freed(build), schema)


def decoded(ids: DataFrame, path: str, column: str = "ids") -> DataFrame:
    """``ids`` with ``decoded``: the bytes of its id lists, through the token-byte table."""
    from collections.abc import Iterator

    from pyspark.sql import types as T

    schema = T.StructType([*ids.schema.fields, T.StructField("decoded", T.BinaryType())])
    at = ids.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {r: t for t, r in read_ranks(path).items()}.__getitem__
        for batch in batches:
            back = [None if r is None else b"".join(map(table, np.frombuffer(r, "<u4").tolist())) for r in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary())], names=schema.names)

    return ids.mapInArrow(run, schema)
