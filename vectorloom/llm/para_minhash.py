"""Repeated passages by paragraph MinHash banding.

Paragraphs are the lines of a text with at least ``MIN_WORDS`` words. Equal paragraphs are one node (a hash
of their words in order). Band keys of MinHash values connect colliding nodes; within what they connect,
exact Jaccard similarity of whole shingle sets decides (a signature tree walks the group); components of
the surviving links are classes. Of each class the first occurrence, by document and position, stays; all
others are removed.

Lines say nothing of a passage inside a longer line or wrapped over short ones. There the paragraphs are all windows
of ``RUN`` words, whatever the line breaks: a window's single band key is the MinHash of its shorter windows (of half
as many words), so equal windows collide; only windows whose key stands in two documents are sent, and equality
decides. ``dedup_runs`` removes every word of a window that a document of a smaller id holds.

``tuned`` picks the number of bands from the recall asked for at the threshold. Only keys and hashes are
shuffled, a node of a task once a band; a paragraph that a third of all documents hold is one node.

Defined results: null text has no paragraphs; null ids take no part and are kept as they are; rows that
repeat an id count as one document; empty tables give empty tables; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import clear, cut, pieces, shuffle_parts
from .components import components
from .sigtree_join import CHUNK, mix, of_words, verified

WORDS = 5
PERCENT = 80
MIN_WORDS = 30
RUN = 50
RECALL = 0.999
SEED = 7
RUN_COLUMNS = ("stay", "n_gone", "from")
#: Names of our own columns, which the caller's may carry too.
OURS = {*RUN_COLUMNS, "places", "first", "__kept", "__gone", "__lo", "__k"}

_K = np.uint64(0x9E3779B97F4A7C15)


def tuned(percent: int = PERCENT, recall: float = RECALL, stray: float = 0.3, share: float = 0.25) -> tuple[int, int]:
    """(bands, rows): the fewest rows a band with which pairs of similarity ``stray`` collide at most ``share`` often."""
    for rows in range(1, 20):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - (percent / 100) ** rows))
        if 1 - (1 - stray**rows) ** bands <= share:
            return bands, rows
    raise ValueError("no bands reach this recall")


def paragraphs(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, position, node, word hashes, paragraph of each word, text) of the paragraphs with enough words."""
    lists = pc.split_pattern(texts.fill_null(""), "\n")
    row = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    lines = pc.list_flatten(lists)
    first = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(row)) - first[row] if len(row) else row
    words = pc.ascii_split_whitespace(pc.ascii_lower(lines))
    flat = pc.list_flatten(words).dictionary_encode()
    of = np.asarray(pc.list_parent_indices(words)).astype(np.int64)
    known = flat.dictionary.cast(pa.binary()).to_pylist()
    index = np.asarray(flat.indices)
    if not len(index):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, lines.slice(0, 0)
    full = np.array([len(w) > 0 for w in known], bool)[index]
    h, of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))[index[full]], of[full]
    count = np.bincount(of, minlength=len(row))
    use = count >= least
    keep = use[of]
    h, of = h[keep], of[keep]
    at = np.nonzero(use)[0]
    new = np.cumsum(use) - 1
    of = new[of]
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64), none, lines.slice(0, 0)
    starts = np.concatenate([[0], np.cumsum(count[at])[:-1]])
    with np.errstate(over="ignore"):
        order = np.arange(len(h), dtype=np.uint64) - starts[of].astype(np.uint64)
        node = np.add.reduceat(mix(h + order * _K), starts)
        node = mix(node + count[at].astype(np.uint64)) >> np.uint64(1)
    return row[at], place[at], node.astype(np.int64), h, of, lines.take(pa.array(at))


def minhash(h: np.ndarray, of: np.ndarray, n: int, bands: int, rows: int, words: int = WORDS) -> np.ndarray:
    """Band keys, n x bands, of the shingle sets of n paragraphs given by word hashes."""
    s, at = of_words(h, of, n, words)
    order = np.argsort(at, kind="stable")
    s, at = s[order], at[order]
    starts = np.searchsorted(at, np.arange(n))
    draw = np.random.default_rng(SEED)
    a, b = draw.integers(1, 2**63, bands * rows, dtype=np.uint64) | np.uint64(1), draw.integers(0, 2**63, bands * rows, dtype=np.uint64)
    keys = np.zeros((n, bands), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(bands * rows):
            x = s * a[k] + b[k]
            least = np.minimum.reduceat((x ^ (x >> np.uint64(32))) * _K, starts)
            keys[:, k // rows] = mix(keys[:, k // rows] * _K + least + np.uint64(k // rows))
    return keys


def stars(rows: DataFrame, parts: int) -> DataFrame:
    """``(a, b)``: edges that connect all nodes with an equal key. ``rows``: (node bigint, keys binary of 64-bit values).

    Nodes of a task that equal keys connect are one from there on: one edge each to their least node, which
    alone goes on, once per key. A bucket connects what its keys join in the same way.
    """
    asks = "bucket int, keys binary, nodes binary"

    def local(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct nodes, the least node each is connected to)."""
        names, at = np.unique(nodes, return_inverse=True)
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        first = np.ones(len(keys), bool)
        first[1:] = keys[1:] != keys[:-1]
        hub = at[first][np.cumsum(first) - 1]
        far = hub != at
        return names, names[roots(len(names), hub[far], at[far])]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = batch.column(1).to_pylist()
            size = np.array([len(b) // 8 if b else 0 for b in blobs])
            keys = np.frombuffer(b"".join(b for b in blobs if b), np.uint64)
            names, root = local(keys, nodes := np.repeat(np.asarray(batch.column(0)), size))
            nodes = root[np.searchsorted(names, nodes)]
            order = np.lexsort((nodes, keys))
            keys, nodes = keys[order], nodes[order]
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
            keys, nodes = keys[new], nodes[new]
            bucket = (mix(keys) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            at, first = np.unique(bucket[order], return_index=True)
            pieces = [(int(k), keys[i].tobytes(), nodes[i].tobytes()) for k, i in zip(at, np.split(order, first[1:]), strict=True)] if len(order) else []
            # Edges found here travel as messages too, spread by their root.
            far = root != names
            for k in np.unique(root[far] % parts):
                use = far & (root % parts == k)
                pieces.append((int(k), root[use].tobytes(), b"e" + names[use].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pieces], pa.int32()), pa.array([blocks.squeeze(p[1]) for p in pieces], pa.binary()), pa.array([blocks.squeeze(p[2]) for p in pieces], pa.binary())], names=["bucket", "keys", "nodes"])

    def meet(table: pa.Table) -> pa.Table:
        keys, nodes, edges = [], [], []
        for k, n in zip(table.column("keys").to_pylist(), table.column("nodes").to_pylist(), strict=True):
            k, n = blocks.loosen(k), blocks.loosen(n)
            if len(n) == len(k):
                keys.append(np.frombuffer(k, np.uint64))
                nodes.append(np.frombuffer(n, np.int64))
            else:
                edges.append((np.frombuffer(k, np.int64), np.frombuffer(n, np.int64, offset=1)))
        if keys:
            names, root = local(np.concatenate(keys), np.concatenate(nodes))
            edges.append((root[root != names], names[root != names]))
        return pa.table({"a": pa.array(np.concatenate([e[0] for e in edges]), pa.int64()), "b": pa.array(np.concatenate([e[1] for e in edges]), pa.int64())})

    return rows.mapInArrow(send, asks).groupBy("bucket").applyInArrow(meet, "a bigint, b bigint")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node each of n nodes is connected to by edges a-b."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least: int = MIN_WORDS, words: int = WORDS, recall: float = RECALL) -> DataFrame:
    """``(key, place, node, cls)`` of every paragraph with enough words; cls is the smallest node of its class."""
    parts = shuffle_parts(docs.sparkSession)
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    bands, deep = tuned(percent, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            _, _, node, h, of, _ = paragraphs(batch.column(1), least)
            only, first = np.unique(node, return_index=True)
            use = np.isin(of, first)
            rank = np.full(len(node), -1)
            rank[np.sort(first)] = np.arange(len(first))
            keys = minhash(h[use], rank[of[use]], len(first), bands, deep, words) if len(first) else np.zeros((0, bands), np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(node[np.sort(first)], pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary())], names=["node", "keys"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row, place, node, *_ = paragraphs(batch.column(1), least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place, pa.int32()), pa.array(node, pa.int64())], names=["k", "place", "node"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            _, _, node, _, _, line = paragraphs(batch.column(1), least)
            only, first = np.unique(node, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(only, pa.int64()), line.take(pa.array(first))], names=["node", "line"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 3):
            row, _, _, h, of, _ = paragraphs(batch.column(3), 0)
            s, at = of_words(h, row[of], batch.num_rows, words)
            items = [np.unique(x).tobytes() for x in np.split(s[np.argsort(at, kind="stable")], np.searchsorted(np.sort(at), np.arange(1, batch.num_rows)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(items, pa.binary())], names=["node", "cluster", "chunks", "items"])

    found = components(stars(rows.mapInArrow(keyed, "node bigint, keys binary"), parts))
    size = found.groupBy("label").agg(F.count("*").alias("count"))
    groups = cut(found.join(size, "label").select("node", F.col("label").alias("cluster"), F.ceil(F.col("count") / CHUNK).alias("chunks")), "groups")
    texts = rows.mapInArrow(lines, "node bigint, line string").join(groups.hint("merge"), "node").groupBy("node", "cluster", "chunks").agg(F.min("line").alias("line"))
    links = cut(verified(texts.mapInArrow(measure, "node bigint, cluster bigint, chunks bigint, items binary"), percent), "verified")
    final = components(links)
    return rows.mapInArrow(placed, "k bigint, place int, node bigint").join(final.hint("merge"), "node", "left").select(F.col("k").alias(key), "place", "node", F.coalesce("label", "node").alias("cls"))


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``(key, places, first)``: the paragraphs to remove of each document, and the least document that keeps one of them."""
    found = cut(classes(docs, key, text, **options), "paragraphs")
    firsts = found.groupBy("cls").agg(F.min(F.struct(F.col(key).alias("d"), F.col("place").alias("p"))).alias("first"), F.count("*").alias("count")).where("count > 1").select("cls", "first")
    gone = found.join(firsts.hint("merge"), "cls").where((F.col(key) != F.col("first.d")) | (F.col("place") != F.col("first.p")))
    return gone.groupBy(key).agg(F.collect_set("place").alias("places"), F.min("first.d").alias("first"))


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with ``places`` (null if nothing goes) and ``first``."""
    docs = clear(docs, "places", "first")
    gone = cut(removals(docs, key, text, **options), "removals")
    return docs.join(gone.hint("merge"), key, "left").select(*docs.columns, "places", "first")


def without(found: DataFrame, text: str = "text"):
    """The text of ``marked`` rows without the removed paragraphs."""
    stay = F.filter(F.split(F.col(text), "\n", -1), lambda x, i: ~F.array_contains("places", i))
    return F.when(F.col("places").isNull(), F.col(text)).otherwise(F.array_join(stay, "\n"))


def _aside(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, list]:
    """``docs`` with other names for columns that are called as ours are, and the columns under their own names again."""
    names = [f"__own{i}" if c not in (key, text) and (c.lower() in OURS or c.startswith("__own")) else c for i, c in enumerate(docs.columns)]
    back = [F.col(f"`{n}`").alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return (docs if names == docs.columns else docs.toDF(*names)), back


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` without repeated paragraphs; documents of which no word is left go."""
    docs, back = _aside(docs, key, text)
    found = marked(docs, key, text, **options)
    kept = found.withColumn("__kept", without(found, text))
    return kept.where(F.col("places").isNull() | F.col("__kept").rlike(r"[^\x20\x09-\x0D]")).withColumn(text, F.col("__kept")).select(back)


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: paragraphs, how many go, the characters they hold, the class and the hash of what stays."""
    found = marked(docs, key, text, **options)
    kept = found.withColumn("__kept", F.coalesce(without(found, text), F.lit("")))
    whole = F.coalesce(F.col(text), F.lit(""))
    return kept.select(key, F.size(F.split(whole, "\n", -1)).cast("long").alias("n_paragraphs"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), (F.length(whole) - F.length("__kept")).cast("long").alias("removed_chars"), F.coalesce("first", key).alias("class_id"), F.sha2("__kept", 256).alias("kept_sha256"))


def _windows(texts: pa.Array, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each word, first word, hash, anchor of each window of ``run`` words), windows within one text only."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = pc.list_flatten(lists).dictionary_encode()
    row = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    known = flat.dictionary.cast(pa.binary()).to_pylist()
    index = np.asarray(flat.indices)
    full = np.array([len(w) > 0 for w in known], bool)[index] if len(index) else np.zeros(0, bool)
    row = row[full]
    if len(row) < run:
        return row, np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = mix(np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known)))[index[full]]
    short = (run + 1) // 2

    def hashed(n: int) -> np.ndarray:
        # The words' hashes as digits: doubling builds windows of powers of two, whose sums make up n.
        out, size, part, base = np.zeros(len(h) - n + 1, np.uint64), 1, h, _K
        done = 0
        while size <= n:
            if n & size:
                out = out * base + part[done : done + len(out)]
                done += size
            part, base, size = part[:-size] * base + part[size:] if len(part) > size else part[:0], base * base, 2 * size
        return mix(out)

    with np.errstate(over="ignore"):
        whole, least, width = hashed(run), hashed(short), 1
    want = run - short + 1
    while width < want:  # sliding minimum by doubling
        step = min(width, want - width)
        least, width = np.minimum(least[:-step], least[step:]), width + step
    at = np.nonzero(row[: len(whole)] == row[run - 1 :])[0]
    return row, at, whole[at], least[at]


def _pairs(a: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, row) pairs."""
    order = np.lexsort((a, row))
    a, row = a[order], row[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (row[1:] != row[:-1])
    return a[new], row[new]


def _cut_runs(text: str, gone: np.ndarray) -> str:
    """``text`` without the marked words; of the white space around them that with a line break stays."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    out, upto, i = [], 0, 0
    while i < len(spans):
        if not gone[i]:
            i += 1
            continue
        j = i
        while j + 1 < len(spans) and gone[j + 1]:
            j += 1
        before = spans[i - 1][1] if i else 0
        after = spans[j + 1][0] if j + 1 < len(spans) else len(data)
        left, right = data[before : spans[i][0]], data[spans[j][1] : after]
        out += [data[upto:before], right if b"\n" in right else left]
        upto, i = after, j + 1
    return b"".join([*out, data[upto:]]).decode()


def marked_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` with ``stay``, ``n_gone`` and ``from``: the text without runs of ``run`` words that documents of smaller ids hold, the number of words that go and the least of these documents (null if nothing goes)."""
    docs = clear(docs, *RUN_COLUMNS, "__gone", "__lo")
    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row, at, _, least = _windows(batch.column(1), run)
            a, r = _pairs(least, row[at])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), batch.column(0).take(pa.array(r))], names=["a", "k"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 1):
            row, at, whole, least = _windows(batch.column(1), run)
            blobs = batch.column(2).to_pylist()
            first = np.searchsorted(row[at], np.arange(batch.num_rows + 1))
            use = np.concatenate([np.zeros(0, bool), *(np.isin(least[s:e], np.array(x, np.int64).view(np.uint64)) for s, e, x in zip(first, first[1:], blobs, strict=False))])
            w, r = _pairs(whole[use], row[at[use]])
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), batch.column(0).take(pa.array(r))], names=["w", "k"])

    anchors = cut(rows.mapInArrow(anchored, "a bigint, k bigint"), "anchors")
    shared = anchors.groupBy("a").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("a")
    asked = anchors.join(shared.hint("merge"), "a").groupBy("k").agg(F.collect_set("a").alias("shared"))
    windows = cut(rows.join(cut(asked, "shared").hint("merge"), "k").select("k", "t", "shared").mapInArrow(sent, "w bigint, k bigint"), "windows")
    least = windows.groupBy("w").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("w", "lo")
    gone = cut(windows.join(least.hint("merge"), "w").where("k > lo").groupBy("k").agg(F.collect_set("w").alias("__gone"), F.min("lo").alias("__lo")).withColumnRenamed("k", "__k"), "gone")
    found = docs.join(gone.hint("merge"), F.col(key).cast("long") == F.col("__k"), "left").select(*docs.columns, "__gone", "__lo")
    at_text, at_gone = found.columns.index(text), len(docs.columns)
    schema = docs.select("*", F.col(text).cast("string").alias("stay"), F.lit(None).cast("long").alias("n_gone"), F.lit(None).cast("long").alias("from")).schema

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at_text):
            texts, lists = batch.column(at_text), batch.column(at_gone)
            ask = np.nonzero(np.asarray(pc.and_(pc.is_valid(lists), pc.is_valid(texts))))[0]
            stay: list[str | None] = [None] * batch.num_rows
            count: list[int | None] = [None] * batch.num_rows
            if len(ask):
                some = texts.take(pa.array(ask))
                row, at, whole, _ = _windows(some, run)
                words, first = np.searchsorted(row, np.arange(len(ask) + 1)), np.searchsorted(row[at], np.arange(len(ask) + 1))
                for n, (t, x) in enumerate(zip(some.to_pylist(), lists.take(pa.array(ask)).to_pylist(), strict=True)):
                    s, e = first[n], first[n + 1]
                    hit = at[s:e][np.isin(whole[s:e], np.array(x, np.int64).view(np.uint64))] - words[n]
                    if len(hit):
                        edge = np.zeros(words[n + 1] - words[n] + 1, np.int64)
                        edge[hit] += 1
                        edge[hit + run] -= 1
                        goes = np.cumsum(edge)[:-1] > 0
                        stay[ask[n]], count[ask[n]] = _cut_runs(t, goes), int(goes.sum())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at_gone], pa.array(stay, pa.string()), pa.array(count, pa.int64()), batch.column(at_gone + 1)], names=schema.names)

    return found.mapInArrow(removed, schema)


def dedup_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` without runs of words that an earlier document holds; documents of which no word is left go."""
    docs, back = _aside(docs, key, text)
    found = marked_runs(docs, key, text, run)
    return found.where(F.col("stay").isNull() | F.col("stay").rlike(r"[^\x20\x09-\x0D]")).withColumn(text, F.coalesce("stay", text)).select(back)


def digest_all(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, **options) -> DataFrame:
    """``digest`` of ``dedup`` and then ``dedup_runs``: also the words that go in runs; ``class_id`` is the least document that holds a passage of this one."""
    found = marked(docs.select(key, text), key, text, **options)
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = cut(found.select(key, F.size(F.split(whole, "\n", -1)).cast("long").alias("n_paragraphs"), F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_removed"), F.length(whole).cast("long").alias("chars"), "first", F.coalesce(without(found, text), F.lit("")).alias("kept")), "lines")
    got = marked_runs(lines, key, "kept", run)
    kept = F.coalesce("stay", "kept")
    return got.select(key, "n_paragraphs", "n_removed", F.coalesce("n_gone", F.lit(0)).cast("long").alias("n_run_words"), (F.col("chars") - F.length(kept)).alias("removed_chars"), F.coalesce(F.least("first", "from"), F.col(key)).alias("class_id"), F.sha2(kept, 256).alias("kept_sha256"))
