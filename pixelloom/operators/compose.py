"""Layers laid over each other, masks, groups, and image pyramids."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import luma, over
from pixelloom.functions.grid import ediv


@dataclass
class Layer:
    """A leaf with pixels (None: transparent) or a group of children from the bottom up."""

    pixels: DataFrame | None = None
    children: Sequence[Layer] = field(default_factory=tuple)
    mode: str = "normal"
    opacity: float = 1.0
    visible: bool = True
    mask: DataFrame | None = None


def apply_mask(pixels: DataFrame, mask: DataFrame, inverted: bool = False) -> DataFrame:
    """Alpha times the mask's brightness; where the mask has no pixel nothing changes."""
    m = mask.select("gx", "gy", luma((F.col("r"), F.col("g"), F.col("b"))).alias("__m"))
    share = F.coalesce(1.0 - F.col("__m") if inverted else F.col("__m"), F.lit(1.0))
    return pixels.join(m, ["gx", "gy"], "left").withColumn("a", F.col("a") * share).drop("__m")


def composite(layers: Sequence[Layer]) -> DataFrame:
    """The stack from the bottom up. A group is laid out apart and then laid over as one.

    All leaves of a stack go through one shuffle: their pixels are tagged with the layer's number, brought together by
    place and folded there in order, so that the number of layers does not add joins.
    """
    shown = [x for x in layers if x.visible]
    parts = []
    for n, layer in enumerate(shown):
        pixels = composite(layer.children) if layer.pixels is None and layer.children else layer.pixels
        if pixels is None:
            continue
        if layer.mask is not None:
            pixels = apply_mask(pixels, layer.mask)
        parts.append(pixels.select("gx", "gy", F.struct(F.lit(n).alias("n"), *"rgba").alias("s")))
    if not parts:
        raise ValueError("nothing visible to lay out")
    together = parts[0]
    for p in parts[1:]:
        together = together.unionByName(p)
    stacks = together.groupBy("gx", "gy").agg(F.array_sort(F.collect_list("s")).alias("s"))

    def lay(acc: Column, s: Column) -> Column:
        out = None
        for n, layer in enumerate(shown):
            laid = over([s[c] for c in "rgba"], [acc[c] for c in "rgba"], layer.mode, layer.opacity)
            this = F.struct(*(x.alias(c) for x, c in zip(laid, "rgba", strict=True)))
            out = F.when(s["n"] == n, this) if out is None else out.when(s["n"] == n, this)
        return out

    clear = F.struct(*(F.lit(0.0).alias(c) for c in "rgba"))
    return stacks.select("gx", "gy", F.aggregate("s", clear, lay).alias("v")).select("gx", "gy", "v.*")


def downsample(pixels: DataFrame, levels: int = 1) -> DataFrame:
    """Means of the pixels there are in squares of 2^levels; one level after the other, as a square may lack pixels."""
    for _ in range(levels):
        pixels = pixels.groupBy(ediv(F.col("gx"), 2).cast("int").alias("gx"), ediv(F.col("gy"), 2).cast("int").alias("gy")).agg(*(F.avg(c).alias(c) for c in "rgba"))
    return pixels


def max_level(width: int, height: int, tile: int = 256) -> int:
    return max(0, math.floor(math.log2(max(width, height) / tile)))


def grid_size(width: int, height: int, tile: int = 256) -> tuple[int, int]:
    return -(-width // tile), -(-height // tile)
