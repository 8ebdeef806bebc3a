"""Connected components of an undirected graph given as edges, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, label)`` for every node of an edge; label: the smallest node of its component.

    Each round every node takes the least of itself and its neighbours as its label and edges are carried
    over to labels; loops and repeats go. At least the neighbours of local minima vanish, so the graph shrinks
    by a factor a round and all rounds together cost little more than the first. Labels are then composed
    from the last, smallest round back to the first. Aggregates combine before they shuffle, joins may be split at
    hot nodes, and rounds are written to the shared folder and deleted once the next is there. No edges give no rows; loops are harmless.
    """
    both = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null")
    links = cut(_both_ways(both), "links")
    rounds: list[DataFrame] = []
    while True:
        labels = cut(links.groupBy(F.col("u").alias("node")).agg(F.least(F.min("u"), F.min("v")).alias("label")), "labels")
        rounds.append(labels)
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))  # noqa: E731, B023
        carried = links.where("u < v").join(of("u"), "u").join(of("v"), "v").where("lu != lv").select(F.col("lu").alias("u"), F.col("lv").alias("v"))
        links, old = cut(_both_ways(carried), "links"), links
        discard(old)
        if links.isEmpty():
            break
    discard(links)
    made = list(rounds)
    found = rounds.pop()
    for labels in reversed(rounds):
        last = found.select(F.col("node").alias("label"), F.col("label").alias("far"))
        found = labels.join(last, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = cut(found, "components")
    discard(*made)
    return out


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
