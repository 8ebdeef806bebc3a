"""Trie of conversation prefixes, rolled up by pointer jumping.

A conversation is a path from the root; two share a node where their first d turns are equal. Texts are read once: a
turn becomes the digest of its role and text, and only digests move. Places of turns come from one range partitioning of
all rows by conversation and turn, with the counts of the few conversations that lie across two partitions, so a
conversation of any length is many tasks. Prefixes get their keys in runs of ``RUN`` turns, each run by itself; the runs of longer conversations are
chained by doubling.

Each node has one edge, to its parent's key. In round r every node adds the sums of the nodes whose pointer, 2^r levels up, leads to it, and
jumps to its pointer's pointer; after log2(depth) rounds it holds the leaves and savings of its whole subtree.
Sums combine before they are shuffled. Pointers to the root, where a third or all of them may lead, are never looked up, since the root has none;
where many lead to another node (a common first turn), the lookup is a join with one row for each key, which Spark splits at hot keys.
Rounds are written to the shared folder and the last one deleted.

The digest of a node's conversations is a chain over their sorted ids; ids are sorted by range, packed into blobs, and each node's blobs
are read as a stream, so that no group is held.

Defined results: rows of a null key belong to no conversation; null role and text are empty; turns go by ``turn`` (null first), then
role, then the digest of role and text; repeated rows are turns of their own; an empty table gives an empty one, without a root;
texts of any length are only digested; other columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, discard, shuffle_parts

#: Turns of a run; ids of a blob.
RUN, IDS = 64, 4096
#: The key of the root: that of no turns.
ROOT = ""


def ordered(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, dig, chars)``, written: every turn's place in its conversation (0 first), digest and code points."""
    spark = turns.sparkSession
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    # The role's length keeps role and text apart.
    dig = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what))
    rows = turns.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"), who.alias("who"), dig.alias("dig"), F.length(what).cast("bigint").alias("chars"))
    dealt = cut(rows.repartitionByRange(shuffle_parts(spark), "conv", F.asc_nulls_first("turn"), "who", "dig").withColumn("part", F.spark_partition_id()), "turns")
    within = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "who", "dig")
    placed = dealt.select("conv", "part", "dig", "chars", (F.row_number().over(within) - 1).cast("bigint").alias("pos"))
    # A border between partitions lies in one conversation at most: as many rows as there are partitions.
    counts = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = counts.select("conv", "part", F.sum("n").over(before).alias("off")).where("off is not null")
    out = cut(placed.join(F.broadcast(later), ["conv", "part"], "left").select("conv", (F.col("pos") + F.coalesce("off", F.lit(0))).alias("pos"), "dig", "chars"), "placed")
    discard(dealt)
    return out


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations put together from two: ``(conv, depth, dig, chars)`` with the first turn at 1, ``(conv, depth)`` of all, turnless ones too, and the table both are read from.

    c gets the first h turns of c - c % 100, then its own after its first h; h is the CRC-32 of c in decimal, modulo 6.
    """
    h = (F.crc32(F.col("conv").cast("string")) % 6).cast("bigint")
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("base"))
    heads = sizes.where("conv % 100 = 0").select(F.col("conv").alias("base"), F.col("n").alias("m"))
    convs = cut(convs.join(heads, "base", "left").withColumn("b", F.least("h", F.coalesce("m", F.lit(0)))), "convs")
    first = turns.where("conv % 100 = 0 and pos < 5").select(F.col("conv").alias("base"), "pos", "dig", "chars")
    given = convs.where("b > 0").select("conv", "base", "b").join(first, "base").where("pos < b").select("conv", (F.col("pos") + 1).alias("depth"), "dig", "chars")
    own = turns.join(convs.select("conv", "h", "b"), "conv").where("pos >= h").select("conv", (F.col("b") + F.col("pos") - F.col("h") + 1).alias("depth"), "dig", "chars")
    return given.unionByName(own), convs.select("conv", (F.col("b") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("depth")), convs


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, key, parent, chars)``: every prefix of every conversation by its key and its parent's."""
    run = F.floor((F.col("depth") - 1) / RUN).cast("bigint")
    held = turns.groupBy("conv", run.alias("run")).agg(F.sort_array(F.collect_list(F.struct("depth", "dig", "chars"))).alias("t"))
    local = held.withColumn("l", F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.md5(F.array_join(F.slice(F.transform("t", lambda x: x["dig"]), F.lit(1), i), ""))))
    longest = turns.agg(F.max(run)).first()[0] or 0
    if longest:
        local = cut(local, "runs")
        heads = chained(local.where(F.size("t") == RUN).select("conv", "run", F.element_at("l", -1).alias("h")), longest)
        upto = heads.select("conv", (F.col("run") + 1).alias("run"), F.col("s").alias("head"))
        last = heads.join(local.select("conv", "run", F.element_at("l", -1).alias("tail")), ["conv", "run"]).join(upto.withColumnRenamed("head", "before"), ["conv", "run"], "left")
        above = last.select("conv", (F.col("run") + 1).alias("run"), _key(F.coalesce("before", F.lit("")), F.col("tail")).alias("above"))
        local = local.join(upto, ["conv", "run"], "left").join(above, ["conv", "run"], "left")
    else:
        local = local.select("*", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("above"))
    keys = local.withColumn("k", F.transform("l", lambda x: _key(F.coalesce("head", F.lit("")), x)))
    up = F.concat(F.array(F.coalesce("above", F.lit(ROOT))), F.slice("k", F.lit(1), F.size("k") - 1))
    each = keys.select("conv", F.explode(F.arrays_zip(F.col("t"), F.col("k"), up.alias("up"))).alias("x"))
    return each.select("conv", F.col("x.t.depth").alias("depth"), F.col("x.k").alias("key"), F.col("x.up").alias("parent"), F.col("x.t.chars").alias("chars"))


def _key(head: Column, tail: Column) -> Column:
    return F.md5(F.concat(head, F.lit("/"), tail))


def chained(runs: DataFrame, longest: int) -> DataFrame:
    """``(conv, run, s)``: a digest of all runs up to each one, by doubling: in round r a digest joins that of the 2^r runs before it."""
    now, old, step = runs.withColumnRenamed("h", "s"), None, 1
    while step < longest + 1:
        back = now.select("conv", (F.col("run") + step).alias("run"), F.col("s").alias("before"))
        now = cut(now.join(back, ["conv", "run"], "left").select("conv", "run", F.when(F.col("before").isNull(), F.col("s")).otherwise(F.md5(F.concat("before", "s"))).alias("s")), "chain")
        discard(old)
        old, step = now, 2 * step
    return now


def nodes(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """``(key, parent, depth, conv, n_convs, chars)``: nodes and the root; ``conv``: the smallest member."""
    below = paths.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.first("chars").alias("chars"))
    root = ends.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).where("n_convs > 0").select(F.lit(ROOT).alias("key"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("bigint").alias("depth"), "conv", "n_convs", F.lit(0).cast("bigint").alias("chars"))
    return below.unionByName(root)


def rollup(tree: DataFrame) -> DataFrame:
    """``tree`` with ``parent_conv``, ``n_children``, ``n_leaves`` and ``saved`` (of the subtree), by pointer jumping."""
    children = tree.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    # The root's own id is one value; the other parents are joined.
    top = tree.where("depth = 0").select(F.lit(ROOT).alias("parent"), F.col("conv").alias("parent_conv"))
    inner = tree.where("depth > 0").select(F.col("key").alias("parent"), F.col("conv").alias("parent_conv"))
    low = tree.where("depth > 1").join(inner, "parent")
    high = tree.where("depth <= 1").join(F.broadcast(top), "parent", "left")
    known = cut(low.unionByName(high).join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")
    deepest = known.agg(F.max("depth")).first()[0] or 0
    now = known.select("key", F.col("parent").alias("up"), F.col("depth").alias("at"), F.when(F.col("n_children") == 0, 1).otherwise(0).cast("bigint").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    step, old = 1, None
    while step <= deepest:
        # A pointer leads ``step`` levels up: nodes from ``step`` on have one, those from 2 * step on have one that has one.
        sums = now.where(F.col("at") >= step).groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("gain"))
        jumps = now.where((F.col("at") >= step)).select(F.col("key").alias("up"), F.col("up").alias("far"))
        far = now.where(F.col("at") >= 2 * step).join(jumps, "up").select("key", F.col("far").alias("up"), "at", "leaves", "saved")
        near = now.where(F.col("at") < 2 * step).withColumn("up", F.lit(None).cast("string"))
        now = cut(far.unionByName(near).join(sums, "key", "left").select("key", "up", "at", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("gain", F.lit(0))).alias("saved")), "jump")
        discard(old)
        old, step = now, 2 * step
    return known.join(now.select("key", F.col("leaves").alias("n_leaves"), "saved"), "key")


def ending(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of the nodes at which conversations end: the digest of their ids, ascending, joined by commas."""
    spark = ends.sparkSession
    stop = paths.join(ends, ["conv", "depth"]).select("key", "conv").unionByName(ends.where("depth = 0").select(F.lit(ROOT).alias("key"), "conv"))
    sorted_ids = stop.repartitionByRange(shuffle_parts(spark), "key", "conv").sortWithinPartitions("key", "conv")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours of one node as one blob."""
        last, ids = None, []

        def blob() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([last], pa.string()), "least": pa.array([ids[0]], pa.int64()), "ids": pa.array([",".join(map(str, ids))], pa.string())})

        for batch in batches:
            for key, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (key != last or len(ids) >= IDS):
                    yield blob()
                    ids = []
                last = key
                ids.append(conv)
        if ids:
            yield blob()

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha, keys, digests = None, None, [], []
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key != last:
                    if sha is not None:
                        keys.append(last)
                        digests.append(sha.hexdigest())
                    last, sha = key, hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            if keys:
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "ends_sha256": pa.array(digests, pa.string())})
                keys, digests = [], []
        if sha is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([last], pa.string()), "ends_sha256": pa.array([sha.hexdigest()], pa.string())})

    blobs = sorted_ids.mapInArrow(pack, "key string, least bigint, ids string")
    return blobs.repartition("key").sortWithinPartitions("key", "least").mapInArrow(chain, "key string, ends_sha256 string")


def trie(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each node: ``key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``paths``: ``prefixes``; ``ends``: ``(conv, depth)`` of every conversation.
    """
    tree = cut(nodes(paths, ends), "nodes")
    grown = rollup(tree)
    discard(tree)
    none = hashlib.sha256(b"").hexdigest()
    got = grown.join(ending(paths, ends), "key", "left")
    return got.select("key", "parent", F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def conversations(turns: DataFrame, mixed: bool = False, **columns: str) -> DataFrame:
    """The trie of a table of turns; with ``mixed`` its conversations are ``rebuilt`` first."""
    placed = ordered(turns, **columns)
    if mixed:
        steps, ends, convs = rebuilt(placed)
    else:
        steps, ends, convs = placed.select("conv", (F.col("pos") + 1).alias("depth"), "dig", "chars"), placed.groupBy("conv").agg(F.count("*").alias("depth")), None
    paths, ends = cut(prefixes(steps), "prefixes"), cut(ends, "ends")
    discard(placed, convs)
    return trie(paths, ends)
