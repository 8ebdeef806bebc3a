"""Connected components of a graph given as edges, in a logarithmic number of joins; nodes may be structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import remove, written


def components(edges: DataFrame) -> DataFrame:
    """``(u, label)``, written, for every node of ``edges (u, v)``: the least node that edges connect it to.

    In a round each node points at the least of itself and its neighbours; edges are then carried over to what their ends point at, and
    those within one node go. Pointers are followed back from the last round to the first.
    """
    both = written(edges.select("u", "v").unionByName(edges.selectExpr("v as u", "u as v")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not both.isEmpty():
        now = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")), "points")
        rounds.append(now)
        left, right = now.withColumnRenamed("label", "lu"), now.selectExpr("u as v", "label as lv")
        fresh = written(both.join(left, "u").join(right, "v").where("lu != lv").selectExpr("lu as u", "lv as v").distinct(), "edges")
        remove(both)
        both = fresh
    remove(both)
    if not rounds:
        return both.sparkSession.createDataFrame([], both.select("u", F.col("v").alias("label")).schema)
    out = rounds[-1]
    for now in reversed(rounds[:-1]):
        last = out.selectExpr("u as label", "label as far")
        out = now.join(last, "label", "left").select("u", F.coalesce("far", "label").alias("label"))
    out = written(out, "components")
    for now in rounds:
        remove(now)
    return out
