"""Tiles with a halo, and the stencils that see one tile only: windows keyed by tile, and gathers by equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp, luma
from pixelloom.functions.grid import HALO, TILE, away, ediv, xorshift_state, xorshift_step, xorshift_unit
from pixelloom.operators.point import RGB, columns, premultiplied, set_rgb, unpremultiplied

KEY = ("tx", "ty")


def decompose(pixels: DataFrame, width: int, height: int, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Every tile's full grid with halo: tx, ty, lx, ly, gx, gy, is_core, r, g, b, a; outside the image all is 0.

    A pixel is sent to the up to four tiles that hold it; the full grid is generated tile by tile, so that the one shuffle
    is of pixels by tile.
    """
    if width < 1 or height < 1:
        raise ValueError("an image has at least one pixel")
    spark = pixels.sparkSession
    nx, ny, side = -(-width // tile), -(-height // tile), tile + 2 * halo
    owners = lambda g: F.sequence(F.greatest(ediv(g - halo, tile), F.lit(0).cast("long")), ediv(g + halo, tile))
    sent = pixels.withColumn("tx", F.explode(owners(F.col("gx")))).withColumn("ty", F.explode(owners(F.col("gy"))))
    sent = sent.where((F.col("tx") < nx) & (F.col("ty") < ny)).select("tx", "ty", "gx", "gy", *"rgba")
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("tx"), F.floor(F.col("id") / nx).alias("ty"))
    grid = grid.withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("lx", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    grid = grid.withColumns({"gx": (F.col("tx") * tile + F.col("lx") - halo).cast("int"), "gy": (F.col("ty") * tile + F.col("ly") - halo).cast("int")})
    inside = lambda c: (F.col(c) >= halo) & (F.col(c) < tile + halo)
    full = grid.join(sent, ["tx", "ty", "gx", "gy"], "left")
    return full.select("tx", "ty", "lx", "ly", "gx", "gy", (inside("lx") & inside("ly")).alias("is_core"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in "rgba"))


def core(tiles: DataFrame, width: int, height: int) -> DataFrame:
    """The image's pixels out of its tiles."""
    return tiles.where(F.col("is_core") & (F.col("gx") < width) & (F.col("gy") < height)).select("gx", "gy", *"rgba")


def _blurred(tiles: DataFrame, names, radius: int, along: str, across: str, side: int) -> DataFrame:
    line = Window.partitionBy(*KEY, across).orderBy(along)
    near = line.rowsBetween(-radius, radius)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.greatest(F.lit(0), F.lit(radius) - F.col(along))
    after = F.greatest(F.lit(0), F.col(along) + radius - (side - 1))
    value = lambda c: (F.sum(c).over(near) + before * F.first(c).over(whole) + after * F.last(c).over(whole)) / float(2 * radius + 1)
    return tiles.withColumns({c: value(c) for c in names})


def box_blur(tiles: DataFrame, radius: int, names=("r", "g", "b", "a"), tile: int = TILE, halo: int = HALO) -> DataFrame:
    """A box of 2 radius + 1, first along rows, then along columns; beyond the tile its edge goes on."""
    side = tile + 2 * halo
    return _blurred(_blurred(tiles, names, radius, "lx", "ly", side), names, radius, "ly", "lx", side)


def blur_radius(amount: float) -> int:
    return min(max(int(amount * 12 + 0.5), 1), 24)


def blur(tiles: DataFrame, amount: float, tile: int = TILE) -> DataFrame:
    """Blur of colours weighted by alpha."""
    return unpremultiplied(box_blur(premultiplied(tiles), blur_radius(amount), tile=tile))


def unsharp(tiles: DataFrame, amount: float, radius: int = 2, tile: int = TILE) -> DataFrame:
    kept = tiles.withColumns({f"o_{c}": F.col(c) for c in RGB})
    low = box_blur(kept, max(radius, 2), RGB, tile)
    sharp = [clamp(F.col(f"o_{c}") + (F.col(f"o_{c}") - F.col(c)) * (1.5 * amount)) for c in RGB]
    return set_rgb(low, sharp).drop(*(f"o_{c}" for c in RGB))


def glow(tiles: DataFrame, threshold: float, radius: float, intensity: float, tile: int = TILE) -> DataFrame:
    """Light of the pixels that are bright enough, blurred and added."""
    bright = luma(columns(*RGB)) >= threshold
    lit = tiles.withColumns({f"m_{c}": F.when(bright, F.col(c)).otherwise(0.0) for c in RGB})
    r = min(max(int(radius + 0.5), 1), 2)
    lit = box_blur(lit, r, tuple(f"m_{c}" for c in RGB), tile)
    return set_rgb(lit, [clamp(F.col(c) + F.col(f"m_{c}") * intensity) for c in RGB]).drop(*(f"m_{c}" for c in RGB))


def _offset(unit: Column, intensity: float) -> Column:
    return F.least(F.greatest(away((unit - 0.5) * 2.0 * (2.0 * intensity)), F.lit(-2.0)), F.lit(2.0)).cast("int")


def glitch_shift(tiles: DataFrame, intensity: float, seed: int, level: int = 0, tile: int = TILE, halo: int = HALO) -> DataFrame:
    """Each channel from a place up to two pixels along the row, as three numbers drawn at the pixel say."""
    if intensity < 0.001:
        return tiles
    first = tiles.withColumn("__s1", xorshift_step(xorshift_state(F.col("gx"), F.col("gy"), seed, level)))
    drawn = first.withColumn("__s2", xorshift_step(F.col("__s1"))).withColumn("__s3", xorshift_step(F.col("__s2")))
    line, side = Window.partitionBy(*KEY, "ly").orderBy("lx"), tile + 2 * halo
    out = {}
    for c, s in zip(RGB, ("__s1", "__s2", "__s3"), strict=True):
        at = F.least(F.greatest(F.col("lx") + _offset(xorshift_unit(F.col(s)), intensity), F.lit(0)), F.lit(side - 1)) - F.col("lx")
        pick = F.when(at == 0, F.col(c))
        for d in (-2, -1, 1, 2):
            pick = pick.when(at == d, F.lead(c, d).over(line) if d > 0 else F.lag(c, -d).over(line))
        out[c] = pick
    return drawn.withColumns(out).drop("__s1", "__s2", "__s3")


def glitch_blocks(tiles: DataFrame, intensity: float, seed: int, level: int = 0, block: int = 16) -> DataFrame:
    """Blocks of the image move by two drawn numbers; of pixels that land on one place the last in row order stays."""
    if intensity < 0.001:
        return tiles
    bx, by = ediv(F.col("gx"), block) * block, ediv(F.col("gy"), block) * block
    drawn = tiles.withColumn("__s1", xorshift_step(xorshift_state(bx, by, seed, level)))
    drawn = drawn.withColumn("__s2", xorshift_step(F.col("__s1")))
    moved = drawn.select(
        *KEY,
        (F.col("lx") + _offset(xorshift_unit(F.col("__s1")), intensity)).alias("lx"),
        (F.col("ly") + _offset(xorshift_unit(F.col("__s2")), intensity)).alias("ly"),
        F.struct("ly", "lx").alias("__from"),
        F.struct(*"rgba").alias("__v"),
    )
    last = moved.groupBy(*KEY, "lx", "ly").agg(F.max_by("__v", "__from").alias("__v"))
    joined = tiles.join(last, [*KEY, "lx", "ly"], "left")
    return joined.withColumns({c: F.coalesce(F.col("__v")[c], F.col(c)) for c in "rgba"}).drop("__v").select(*tiles.columns)
