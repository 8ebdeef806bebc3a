"""Prompt masks: similarity to a prompt vector, contrast, threshold, removal of small connected areas."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..sources.shared import written
from .connect import components
from .stats import heatmap

#: Pixels of a tile's side.
TILE = 512


def prompt_distance(df: DataFrame, prompt: list[float], vector: str = "v") -> DataFrame:
    """``df`` with ``dist``: one minus the cosine to the prompt, a projection with a literal."""
    p = np.asarray(prompt, float)
    p = p / max(float(np.linalg.norm(p)), vec.EPS)
    return df.withColumn("dist", F.lit(1.0) - vec.dot(vec.normalized(vector), F.array(*(F.lit(float(x)) for x in p))))


def least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the n nodes that edges a-b connect each node to."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def areas(df: DataFrame, flag: str = "mask", tile: int = TILE) -> DataFrame:
    """``df (img, y, x, mask)`` with ``comp``: the smallest y * 1e6 + x of its 8-connected area; NULL where the mask is 0.

    Areas are found in tiles of ``tile`` x ``tile`` pixels, each by itself; where lit pixels of two tiles touch, their areas are one, and the
    areas that such borders connect get the least name. So an image of any size is many tasks.
    """
    part = [F.floor(F.col(c) / tile).cast("int").alias(f"t{c}") for c in "yx"]
    local = written(df.select("img", "y", "x", flag, *part).groupBy("img", "ty", "tx").applyInArrow(_tile(flag), f"img int, y int, x int, {flag} int, comp bigint"), "areas")
    edge = lambda c: F.pmod(F.col(c), F.lit(tile)).isin(0, tile - 1)
    border = local.where(F.col("comp").isNotNull() & (edge("y") | edge("x"))).select("img", "y", "x", "comp")
    steps = F.explode(F.array(*(F.struct(F.lit(b).alias("dy"), F.lit(a).alias("dx")) for b, a in ((0, 1), (1, -1), (1, 0), (1, 1))))).alias("s")
    near = border.select("img", F.col("comp").alias("a"), "y", "x", steps).select("img", "a", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"))
    touching = near.join(border, ["img", "y", "x"]).where("a != comp")
    joined = components(touching.select(F.struct("img", F.col("a").alias("comp")).alias("u"), F.struct("img", "comp").alias("v")))
    names = joined.select(F.col("u.img").alias("img"), F.col("u.comp").alias("comp"), F.col("label.comp").alias("whole"))
    return local.join(names, ["img", "comp"], "left").select("img", "y", "x", flag, F.coalesce("whole", "comp").alias("comp"))


def _tile(flag: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        y, x, m = (np.asarray(table.column(c)).astype(np.int64) for c in ("y", "x", flag))
        name = y * 1_000_000 + x
        lit = np.nonzero(m != 0)[0]
        lit = lit[np.argsort(name[lit], kind="stable")]
        known = name[lit]
        ends = []
        for step in (1, 999_999, 1_000_000, 1_000_001):  # right, and the three below
            at = np.searchsorted(known, known + step)
            met = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == known + step)
            ends.append(np.stack([np.nonzero(met)[0], at[met]]))
        comp = np.full(len(y), -1)
        comp[lit] = known[least(len(known), *np.concatenate(ends, 1))] if len(lit) else 0
        return pa.table({"img": table.column("img"), "y": table.column("y"), "x": table.column("x"), flag: table.column(flag), "comp": pa.array(comp, pa.int64(), mask=m == 0)})

    return run


def clean_mask(df: DataFrame, min_area: int = 500, flag: str = "mask") -> DataFrame:
    """The mask without connected areas below ``min_area`` pixels, as 0 and 255."""
    found = areas(df, flag)
    size = found.where("comp is not null").groupBy("img", "comp").agg(F.count("*").alias("area"))
    return found.join(size, ["img", "comp"], "left").select("img", "y", "x", F.when(F.col("area") >= min_area, 255).otherwise(0).alias(flag))


def area_table(df: DataFrame, flag: str = "mask", tile: int = TILE) -> DataFrame:
    """``(img, comp, area, y0, y1, x0, x1)`` of every connected area."""
    return areas(df, flag, tile).where("comp is not null").groupBy("img", "comp").agg(F.count("*").alias("area"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))


def get_mask(df: DataFrame, prompt: list[float], threshold: float = 0.5, gamma: float = 1.0, denoise: bool = True, denoise_area: int = 3, vector: str = "v") -> DataFrame:
    """``(img, y, x, mask)``: 0 and 1, or 0 and 255 if small areas are removed."""
    hot = heatmap(prompt_distance(df, prompt, vector), "dist", gamma)
    raw = hot.select("img", "y", "x", (F.col("heat") > threshold).cast("int").alias("mask"))
    return clean_mask(raw, denoise_area) if denoise else raw
