"""Self-join of shingle sets by exact Jaccard similarity, with signature trees.

A set that links with another has at least ``percent`` hundredths of its tokens in it, so the two share one of
their rarest tokens: of n tokens those that remain without the commonest ``percent`` hundredths, and one more.
These tokens route sets to signature trees. A tree's hierarchical nodes hold the OR and the AND of token bitmaps and
a range of sizes; a dual traversal prunes node pairs whose largest possible overlap is below what the smallest
union needs, and pairs that are connected already.

Rare means a low count in a table of ``SLOTS`` hashed frequencies of all documents, a fixed size; any order that
all tasks share gives the same links, so chance neighbours in the table cost time only.

A token is the first that two sets share, so neither can have more tokens after it than it takes: sets of a token
that fit no other set of it by size and by the token's rank are dropped from it at once.

1. Sets that share at least a ``SHARE``-th of a set's routing tokens with the least set that has them (its hub)
   form a tree of whole sets with that hub; rounds with other hubs follow while a token has more than ``CHUNK`` sets in
   different components.
2. For each routing token whose sets still lie in different components, a tree of their bitmaps connects all pairs that
   may link, by a forest of them; tokens with the same sets make one tree, tokens with more than ``LIST`` sets pairs of chunks.
3. Whole sets decide all pairs within what these forests connect. Nothing is left out: a pair is pruned by a bound or by a path of links.

Equal sets count once from the start. No task holds more than a chunk; a chunk of whole sets has about ``ELEMENTS`` tokens.

Defined results: null or wordless text has an empty set and no links; null ids never link (component null);
rows that repeat an id are each taken by their own text; empty tables give empty tables; whole texts of any length.
Sets are told apart by 64-bit hashes of their tokens, tokens by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks
from .common import cut, discard, pieces
from .components import components

WORDS = 3
PERCENT = 90
#: Sets and tokens of a chunk of a group.
CHUNK, ELEMENTS = 2000, 1_000_000
SLOTS, SLICES = 1 << 22, 64
SHARE, ROUNDS, LIST = 5, 3, 256
FAN = 32
#: Bits of the filter by which documents that take part are found before they are shuffled.
FILTER = 1 << 23

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * _A
        x = (x ^ (x >> np.uint64(29))) * _B
        return x ^ (x >> np.uint64(32))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each shingle, its row): A-Z lowered, ASCII white space splits; short texts whole."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat = pc.list_flatten(lists).dictionary_encode()
    row = np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    known = flat.dictionary.cast(pa.binary()).to_pylist()
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
    index = np.asarray(flat.indices)
    full = np.array([len(w) > 0 for w in known], bool)[index] if len(index) else np.zeros(0, bool)
    return of_words(values[index[full]], row[full], len(texts), words)


def of_words(h: np.ndarray, row: np.ndarray, rows: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(row, minlength=rows)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        acc = np.full(max(0, n - words + 1), words, np.uint64)
        for k in range(words):
            acc = mix(acc * _C + h[k : k + len(acc)])
        whole = row[: len(acc)] == row[words - 1 :] if len(acc) else np.zeros(0, bool)
        out, at = acc[whole], row[: len(acc)][whole]
        few = np.nonzero((count > 0) & (count < words))[0]
        if len(few):  # the whole sequence as one, told apart by its length
            first = np.concatenate([[0], np.cumsum(count)])
            extra = []
            for r in few:
                x = np.uint64(1000 + count[r])
                for w in h[first[r] : first[r + 1]]:
                    x = mix(np.array([x * _C + w], np.uint64))[0]
                extra.append(x)
            out, at = np.concatenate([out, np.array(extra, np.uint64)]), np.concatenate([at, few])
    return out, at


def distinct(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, sorted within a text; where each text's begin, and the end)."""
    h, row = shingles(texts, words)
    if len(row) and (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    for s, e in zip(first, first[1:], strict=False):
        h[s:e].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[first] if len(h) else first


def sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, first = distinct(texts, words)
    return [h[s:e] for s, e in zip(first, first[1:], strict=False)]


def names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ _C), dtype=np.uint64)])
        return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64) * _A).view(np.int64)


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def routes(n: int, percent: int) -> int:
    """How many of its rarest tokens route a set of n; none if no other set can link with it."""
    if needed(n, n, percent) == n and needed(n, n + 1, percent) > n and (n == 1 or needed(n - 1, n, percent) == n):
        return 0
    return n + percent * -n // 100 + 1


class Tree:
    """A signature tree over members sorted by size: nodes hold the OR and the AND of their token bitmaps and a range of sizes."""

    def __init__(self, size: np.ndarray, maps: np.ndarray, fan: int = FAN):
        self.levels = [(maps, maps, size, size, np.arange(len(size)), np.arange(1, len(size) + 1))]
        while len(self.levels[-1][2]) > 1:
            o, a, lo, hi, s, e = self.levels[-1]
            cuts = np.arange(0, len(lo), fan)
            self.levels.append((np.bitwise_or.reduceat(o, cuts), np.bitwise_and.reduceat(a, cuts), np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts), s[cuts], e[np.minimum(cuts + fan, len(e)) - 1]))
        self.fan = fan

    def children(self, level: int, k: int) -> range:
        return range(k * self.fan, min((k + 1) * self.fan, len(self.levels[level - 1][2])))

    def pairs(self, percent: int, *roots: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Dual traversal: member pairs that the largest possible overlap doesn't rule out and of which each of ``roots`` differs."""
        maps, _, size, *_ = self.levels[0]
        stack = [(len(self.levels) - 1, 0, 0)] if len(self.levels) > 1 else []
        while stack:
            level, x, y = stack.pop()
            ors, ands, lo, hi, s, e = self.levels[level]
            need = needed(int(lo[x]), int(lo[y]), percent)
            if hi[x] < need or hi[y] < need or 100 * hi[x] < percent * lo[y] or 100 * hi[y] < percent * lo[x]:
                continue
            # A member of x misses at least the bits that all of x share and none of y has.
            if hi[x] - np.bitwise_count(ands[x] & ~ors[y]).sum() < need or hi[y] - np.bitwise_count(ands[y] & ~ors[x]).sum() < need:
                continue
            nows = [root() for root in roots]
            if any((now[s[x] : e[x]] == now[s[x]]).all() and (now[s[y] : e[y]] == now[s[x]]).all() for now in nows):
                continue
            if level > 1:
                a, b = self.children(level, x), self.children(level, y)
                stack.extend((level - 1, i, j) for i in a for j in b if x != y or i <= j)
                continue
            i, j = (k.ravel() for k in np.meshgrid(np.arange(s[x], e[x]), np.arange(s[y], e[y]), indexing="ij"))
            use = np.logical_and.reduce([now[i] != now[j] for now in nows]) & ((i < j) if x == y else True)
            i, j = i[use], j[use]
            least = -(-percent * (size[i] + size[j]) // (100 + percent))
            use = (np.minimum(size[i], size[j]) >= least) & (size[i] - np.bitwise_count(maps[i] & ~maps[j]).sum(1) >= least) & (size[j] - np.bitwise_count(maps[j] & ~maps[i]).sum(1) >= least)
            if use.any():
                yield i[use], j[use]


def width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two, at least twice n."""
    return max(64, 1 << (2 * n - 1).bit_length())


def bitmap(s: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 64, np.uint64)
    b = (s >> np.uint64(24)) & np.uint64(bits - 1)
    np.bitwise_or.at(out, (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
    return out


def folded(m: np.ndarray, bits: int) -> np.ndarray:
    """A bitmap made shorter: halves are laid over each other."""
    return np.bitwise_or.reduce(m.reshape(-1, bits // 64), 0)


class Union:
    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.root[max(a, b)] = min(a, b)

    def flat(self) -> np.ndarray:
        while (self.root[self.root] != self.root).any():
            self.root = self.root[self.root]
        return self.root


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) < needed(len(a), len(b), percent):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def joined(members: list[np.ndarray], side: np.ndarray | None = None, percent: int = PERCENT) -> np.ndarray:
    """The smallest index connected to each set by links. ``side``: only pairs of different sides are tested.

    Pairs already connected aren't verified: the result keeps every link's effect, not its edge.
    """
    n = len(members)
    union = Union(n)
    order = sorted(range(n), key=lambda i: (len(members[i]), members[i][0] if len(members[i]) else 0, i))
    sorted_ = [members[i] for i in order]
    sides = np.arange(n) if side is None else np.asarray(side)[order]
    for i in range(n - 1):  # neighbours in order connect most of a group at once
        if sides[i] != sides[i + 1] and linked(sorted_[i], sorted_[i + 1], percent):
            union.join(i, i + 1)
    size = np.array([len(s) for s in sorted_], np.int64)
    bits = min(width(int(size[-1]) if n else 1), max(1024, 1 << ((1 << 29) // max(1, n)).bit_length() - 1))
    tree = Tree(size, np.stack([bitmap(s, bits) for s in sorted_]) if n else np.zeros((0, 1), np.uint64))
    for i, j in tree.pairs(percent, union.flat):
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            if sides[p] != sides[q] and union.find(p) != union.find(q) and linked(sorted_[p], sorted_[q], percent):
                union.join(p, q)
    root = union.flat()
    out = np.empty(n, np.int64)
    least: dict[int, int] = {}
    for k in np.argsort(order, kind="stable"):
        least.setdefault(int(root[k]), order[k])
    for k in range(n):
        out[order[k]] = least[int(root[k])]
    return out


def trees(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges of a forest over the real links within each group. ``members``: (node, side, cluster, i, j, items).

    A group is a task; if its ``i`` and ``j`` differ, pairs of one side are left out.
    """

    def run(table: pa.Table) -> pa.Table:
        node = np.asarray(table.column("node"))
        order = np.argsort(node, kind="stable")
        items = table.column("items").to_pylist()
        got = [np.frombuffer(items[k], np.uint64) for k in order]
        cross = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        root = joined(got, np.asarray(table.column("side"))[order] if cross else None, percent)
        node = node[order]
        far = root != np.arange(len(root))
        return pa.table({"a": pa.array(node[root[far]], pa.int64()), "b": pa.array(node[far], pa.int64())})

    return members.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def verified(members: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges of a forest with the components that real links give. ``members``: (node, cluster, chunks, items).

    A cluster of one chunk is a task; of more chunks every pair of chunks is one.
    """
    return trees(members.select("*", *_paired()).select("node", "side", "cluster", "items", "p.i", "p.j"), percent)


def _paired() -> tuple:
    """The chunk of a row's node, and every pair of chunks it belongs to."""
    side = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks").cast("int") - 1), lambda j: F.struct(F.least(j, side).alias("i"), F.greatest(j, side).alias("j")))
    return side.alias("side"), F.explode(pairs).alias("p")


def profile(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``(key, n, node, slot, part, counts)``: set size and hash of each document, and for each task its table of token counts in slices."""
    kind = dict(docs.dtypes)[key]
    schema = f"{key} {kind}, n bigint, node bigint, slot int, part int, counts binary"
    empty = pa.nulls(0, pa.int32()), pa.nulls(0, pa.int32()), pa.nulls(0, pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, of = np.zeros(SLOTS, np.int32), None  # a task has fewer tokens than that
        for batch in pieces(batches, 1):
            of = batch.schema.types[0]
            h, first = distinct(batch.column(1), words)
            np.add.at(total, (h & np.uint64(SLOTS - 1)).astype(np.int64), 1)
            n = np.diff(first)
            more = [pa.nulls(batch.num_rows, x.type) for x in empty]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(names(h, first), pa.int64(), mask=n == 0), *more], names=[key, "n", "node", "slot", "part", "counts"])
        if of is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(SLICES, of), pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array([TaskContext.get().partitionId()] * SLICES, pa.int32()), pa.array([blocks.squeeze(x.astype(np.int64).tobytes()) for x in np.split(total, SLICES)], pa.binary())], names=[key, "n", "node", "slot", "part", "counts"])

    return docs.select(key, text).mapInArrow(run, schema)


def rarity(slices: DataFrame) -> np.ndarray:
    """Per slot of hashed tokens a byte that grows with the logarithm of its count. ``slices``: (slot, part, counts)."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SLOTS // SLICES, np.int64)
        for blob in table.column("counts"):
            total += np.frombuffer(blocks.loosen(blob.as_py()), np.int64)
        return pa.table({"slot": table.column("slot").slice(0, 1), "part": pa.array([0], pa.int32()), "counts": pa.array([blocks.squeeze(total.tobytes())], pa.binary())})

    schema = "slot int, part int, counts binary"
    some = slices.groupBy("slot", (F.col("part") % SLICES).alias("by")).applyInArrow(add, schema)
    out = np.zeros((SLICES, SLOTS // SLICES))
    for r in some.groupBy("slot").applyInArrow(add, schema).collect():  # SLICES rows
        out[r.slot] = np.frombuffer(blocks.loosen(r.counts), np.int64)
    return np.minimum(255, 4 * np.log2(1 + out.ravel())).astype(np.uint8)


def routed(docs: DataFrame, key: str, text: str, words: int, percent: int, rare: np.ndarray) -> DataFrame:
    """``(k, node, n, rank)``: the routing tokens of every set of n, by rank."""
    shared = docs.sparkSession.sparkContext.broadcast(rare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = shared.value
        for batch in pieces(batches, 0):
            h, first = distinct(batch.column(0), words)
            node = names(h, first)
            _, once = np.unique(node, return_index=True)
            token = (order[h & np.uint64(SLOTS - 1)].astype(np.uint64) << np.uint64(56)) | (mix(h) >> np.uint64(8))
            out, n = [np.zeros(0, np.uint64)], np.diff(first)
            p = np.array([routes(int(x), percent) if x else 0 for x in n[once]], np.int64)
            for i, m in zip(once.tolist(), p.tolist(), strict=True):
                if m:
                    t = token[first[i] : first[i + 1]]
                    out.append(np.sort(np.partition(t, m - 1)[:m]))
            rank = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.repeat(node[once], p)), pa.array(np.repeat(n[once], p), pa.int32()), pa.array(rank, pa.int32())], names=["k", "node", "n", "rank"])

    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(text).mapInArrow(run, "k bigint, node bigint, n int, rank int")


def fitting(hits: DataFrame, percent: int) -> DataFrame:
    """``(k, node, p)`` of (k, node, n, rank): without the sets of a token that fit no other of its sets. ``p``: tokens that route the set.

    If the token is the first that two sets share, the tokens from it on must suffice for a link in either.
    """
    own = F.expr(f"cast(n - ceil({percent} * n / 100) + 1 as int)").alias("p")
    counted = hits.join(hits.groupBy("k").agg(F.count("*").alias("c")).hint("merge"), "k")
    few = counted.where((F.col("c") > 1) & (F.col("c") <= LIST)).groupBy("k").agg(F.collect_list(F.struct("node", "n", "rank")).alias("all"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column(1)))
            flat = pc.list_flatten(batch.column(1))
            node, n, rank = (np.asarray(flat.field(i)) for i in range(3))
            first, keep = np.cumsum(sizes) - sizes, np.zeros(len(node), bool)
            for m in np.unique(sizes):
                lists = np.nonzero(sizes == m)[0]
                for some in np.array_split(lists, -(-len(lists) * m * m // (1 << 19))):
                    at = first[some][:, None] + np.arange(m)
                    need = -(-percent * (n[at][:, :, None] + n[at][:, None, :]) // (100 + percent))
                    left = n[at] - rank[at]
                    fits = (left[:, :, None] >= need) & (left[:, None, :] >= need)
                    fits[:, np.arange(m), np.arange(m)] = False
                    keep[at] = fits.any(2)
            k = np.repeat(np.asarray(batch.column(0)), sizes)
            p = n - (percent * n + 99) // 100 + 1
            yield pa.RecordBatch.from_arrays([pa.array(k[keep]), pa.array(node[keep]), pa.array(p[keep], pa.int32())], names=["k", "node", "p"])

    return few.mapInArrow(run, "k bigint, node bigint, p int").unionByName(counted.where(F.col("c") > LIST).select("k", "node", own))


def fetched(docs: DataFrame, key: str, text: str, words: int, want: DataFrame, form: Callable[[np.ndarray], bytes]) -> DataFrame:
    """``want`` (rep, node and more) with ``items``: the sets of these documents, in ``form``.

    A filter of fixed size lets documents that nobody wants stay where they are.
    """
    bit = F.pmod(F.xxhash64(F.col("rep")), F.lit(FILTER)) + 1
    got = want.select("rep").distinct().groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()  # of FILTER bits together
    bits = np.zeros((FILTER // (1 << 15), 1 << 12), np.uint8)
    for r in got:
        bits[r.b - 1] = np.frombuffer(r.m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits.ravel())

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.asarray(batch.column(2)) - 1
            yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7)) & 1 == 1)).select(["rep", "t"])

    kind = [(c, t) for c, t in want.dtypes if c != "rep"]
    schema = ", ".join(f"{c} {t}" for c, t in kind) + ", items binary"
    where = [c for c, _ in kind].index("node")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, len(kind)):
            h, first = distinct(batch.column(len(kind)), words)
            own = pa.array(names(h, first) == np.asarray(batch.column(where)))  # an id may have several texts
            items = [form(h[s:e]) for s, e in zip(first, first[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(items, pa.binary())], names=[*(c for c, _ in kind), "items"]).filter(own)

    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rep"), F.col(text).alias("t"))
    some = texts.select("rep", "t", bit.alias("bit")).mapInArrow(wanted, "rep bigint, t string")
    return some.join(want.hint("merge"), "rep").select(*(c for c, _ in kind), "t").mapInArrow(measure, schema)


def _candidates(groups: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: edges of a forest over the pairs of different labels that trees of bitmaps let through.

    ``groups``: (cluster, i, j, side, node, label, items); items: size and bitmap. Only the components of the pairs count, so
    a group gives fewer edges than it has sets, and pairs that these edges connect already aren't looked at.
    """

    def run(table: pa.Table) -> pa.Table:
        items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
        node, label = np.asarray(table.column("node")), np.asarray(table.column("label"))
        side = np.asarray(table.column("side")) if table.column("i")[0].as_py() != table.column("j")[0].as_py() else np.arange(len(node))
        size, bits = np.array([x[0] for x in items], np.int64), np.array([64 * (len(x) - 1) for x in items])
        union, out = Union(len(node)), []
        # Sizes of a link differ by less than a factor of two, so widths by one step.
        for w in np.unique(bits):
            at = np.nonzero((bits == w) | (bits == 2 * w))[0]
            at = at[np.lexsort((node[at], [items[i][1] for i in at], size[at]))]
            tree = Tree(size[at], np.stack([folded(items[i][1:], w) for i in at]))
            for i, j in tree.pairs(percent, lambda l=label[at]: l, lambda at=at: union.flat()[at]):
                i, j = at[i], at[j]
                use = ((bits[i] == w) | (bits[j] == w)) & (side[i] != side[j])
                for x, y in zip(i[use].tolist(), j[use].tolist(), strict=True):
                    if union.find(x) != union.find(y):
                        union.join(x, y)
                        out.append((node[x], node[y]))
        found = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(found[:, 0], pa.int64()), "b": pa.array(found[:, 1], pa.int64())})

    return groups.groupBy("cluster", "i", "j").applyInArrow(run, "a bigint, b bigint")


def _open(hits: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``(k, node, p, label, c)``: of the tokens whose sets lie in different components."""
    named = hits.withColumn("label", F.col("node")) if labels is None else hits.join(labels.hint("merge"), "node", "left").select("k", "node", "p", F.coalesce("label", "node").alias("label"))
    named = named if labels is None else cut(named, "labelled")
    several = named.groupBy("k").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where("lo < hi")
    out = cut(named.join(several.select("k", "c").hint("merge"), "k").select("k", "node", "p", "label", "c"), "open")
    if labels is not None:
        discard(named)
    return out


def _chunks(n: Column) -> Column:
    """Chunks for sets of n tokens: about ``ELEMENTS`` tokens, and at most ``CHUNK`` sets, each."""
    return F.ceil(F.sum(n + F.lit(ELEMENTS / CHUNK)) / ELEMENTS)


def _hubs(open_: DataFrame, nodes: DataFrame, percent: int, turn: int) -> DataFrame:
    """``(rep, node, side, cluster, i, j)``: trees of a hub and sets that share a good part of their tokens with it."""
    first = F.min(F.struct((F.xxhash64("node", F.lit(turn)) if turn else F.col("node")).alias("o"), F.col("node").alias("hub"), F.col("label").alias("of"))).alias("h")
    hub = open_.groupBy("k").agg(first).select("k", "h.hub", "h.of")
    near = open_.join(hub.hint("merge"), "k").where("of <> label").groupBy("hub", "node").agg(F.count("*").alias("c"), F.min("p").alias("p")).where(F.col("c") * SHARE >= F.col("p"))
    best = cut(near.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("b"), F.min("p").alias("p")).select("node", F.col("b.hub").alias("cluster"), "p"), "hubs")
    size = best.groupBy("cluster").agg(_chunks(F.col("p") * F.lit(100.0 / (100 - percent))).cast("int").alias("chunks"))
    member = best.join(size.hint("merge"), "cluster").select("node", "cluster", F.pmod(F.xxhash64("node", F.lit(turn)), F.col("chunks")).cast("int").alias("i"))
    lead = size.select(F.col("cluster").alias("node"), "cluster", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"))
    return cut(member.unionByName(lead).join(nodes.select("node", "rep").hint("merge"), "node").select("rep", "node", F.lit(0).alias("side"), "cluster", "i", F.col("i").alias("j")), "groups")


def _lists(open_: DataFrame) -> DataFrame:
    """``(cluster, i, j, side, node, label)``: the sets of each open token; equal lists of sets once, long ones as pairs of chunks."""
    few = open_.where(F.col("c") <= LIST).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("node", "label"))).alias("all"))
    once = few.groupBy(F.xxhash64("all").alias("cluster")).agg(F.first("all").alias("all")).select("cluster", F.explode("all").alias("x"))
    one = once.select("cluster", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"), "x.node", "x.label")
    many = open_.where(F.col("c") > LIST).select("node", "label", F.col("k").alias("cluster"), F.ceil(F.col("c") / CHUNK).alias("chunks"))
    return one.unionByName(many.select("*", *_paired()).select("cluster", "p.i", "p.j", "side", "node", "label"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(key, n_shingles, component_id)``: the smallest id reachable by links of at least ``percent`` similarity."""
    docs = docs.select(key, text)
    table = cut(profile(docs, key, text, words), "sets")
    rows = table.where("slot is null").select(key, "n", "node")
    nodes = cut(rows.where(F.col(key).isNotNull() & (F.col("n") > 0)).groupBy("node").agg(F.min(F.col(key).cast("long")).alias("rep"), F.first("n").alias("n")), "nodes")
    routing = cut(routed(docs, key, text, words, percent, rarity(table.where("slot is not null").select("slot", "part", "counts"))), "routes")
    several = routing.groupBy("k").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("k")
    shared = cut(routing.join(several.hint("merge"), "k").repartition("k", "node").distinct(), "shared")
    hits = cut(fitting(shared, percent), "hits")
    discard(routing, shared)
    whole = lambda s: s.tobytes()
    labels, open_ = None, _open(hits, None)
    for turn in range(ROUNDS):
        if turn and open_.where(F.col("c") > CHUNK).isEmpty():
            break
        groups = _hubs(open_, nodes, percent, turn)
        links = trees(fetched(docs, key, text, words, groups, whole), percent)
        found = components(links if labels is None else links.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
        discard(groups, labels, open_)
        labels, open_ = found, _open(hits, found)
    discard(hits)
    lists = cut(_lists(open_), "lists")
    short = lambda s: np.concatenate([np.array([len(s)], np.uint64), bitmap(s, width(len(s)))]).tobytes()
    maps = cut(fetched(docs, key, text, words, cut(lists.select("node").distinct().join(nodes.hint("merge"), "node").select("rep", "node"), "asked"), short), "maps")
    pairs = cut(_candidates(lists.join(maps.hint("merge"), "node"), percent), "pairs")
    edges = pairs.distinct()
    near = components(edges)
    near = near.join(nodes.hint("merge"), "node")
    size = near.groupBy("label").agg(_chunks(F.col("n")).alias("chunks"))
    groups = cut(near.join(size.hint("merge"), "label").select("rep", "node", F.col("label").alias("cluster"), "chunks"), "groups")
    links = verified(fetched(docs, key, text, words, groups, whole), percent)
    found = components(links if labels is None else links.unionByName(labels.select(F.col("label").alias("a"), F.col("node").alias("b"))))
    discard(lists, maps, pairs, groups, open_, labels)
    named = nodes.join(found.hint("merge"), "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    final = cut(named.join(least.hint("merge"), "label").select("node", "least"), "classes")
    return rows.join(final.hint("merge"), "node", "left").select(key, F.col("n").alias("n_shingles"), F.when(F.col(key).isNotNull(), F.coalesce("least", F.col(key).cast("long"))).alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that link, directly or not, to one of smaller id; rows that repeat an id stay or go together."""
    gone = join(docs, key, text, words, percent).where(F.col("component_id") != F.col(key)).select(key).distinct()
    return docs.join(gone.hint("merge"), key, "left_anti").select(docs.columns)
