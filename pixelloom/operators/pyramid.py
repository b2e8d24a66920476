"""Image pyramids that are kept and brought up to date: of a change only the tiles above what it touched are made again.

A pyramid is a table of pixels by level and generation, and an index of the tiles that each generation holds. An update
writes the changed tiles of level 0 and, level by level, the parents of what it has written, from the newest pixels of
their children; a tile's newest generation wins. Settling which is newest reads the index alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.compose import downsample, max_level

AT = ["tx", "ty"]
_PIXELS = "tx long, ty long, gx int, gy int, r double, g double, b double, a double, level int, generation int"
_INDEX = "tx long, ty long, level int, generation int"


def in_tiles(pixels: DataFrame, tile: int) -> DataFrame:
    """pixels (gx, gy, r, g, b, a) with the tile that they lie in."""
    of = lambda g: F.floor(F.col(g) / tile)
    return pixels.select(of("gx").alias("tx"), of("gy").alias("ty"), F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), *"rgba")


def only(pixels: DataFrame, tiles: DataFrame, tile: int) -> DataFrame:
    """The pixels (gx, gy, r, g, b, a) that lie in tiles (tx, ty)."""
    return in_tiles(pixels, tile).join(tiles.select(*AT).distinct(), AT, "left_semi").drop(*AT)


def _write(path: str, level: int, generation: int, pixels: DataFrame, tile: int) -> DataFrame:
    """Writes a level's tiles; returns their places."""
    spark = pixels.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    to = f"{path}/pixels/level={level}/generation={generation}"
    # tiles lie together in files, so that reading some of them skips the rest by the files' statistics
    in_tiles(pixels, tile).repartitionByRange(parts, "ty", "tx", "gy", "gx").sortWithinPartitions("ty", "tx").write.mode("overwrite").parquet(to)
    index = f"{path}/index/level={level}/generation={generation}"
    spark.read.parquet(to).select(*AT).distinct().write.mode("overwrite").parquet(index)
    return spark.read.schema("tx long, ty long").parquet(index)


def newest(spark: SparkSession, path: str, level: int, tiles: DataFrame | None = None, before: int | None = None) -> DataFrame:
    """(gx, gy, r, g, b, a): a level as it is now, or some tiles of it; before: as it was before a generation."""
    index = spark.read.schema(_INDEX).parquet(f"{path}/index").where(F.col("level") == level)
    rows = spark.read.schema(_PIXELS).parquet(f"{path}/pixels").where(F.col("level") == level)
    if before is not None:
        index, rows = index.where(F.col("generation") < before), rows.where(F.col("generation") < before)
    if tiles is not None:
        index = index.join(tiles.select(*AT).distinct(), AT, "left_semi")
    now = index.groupBy(*AT).agg(F.max("generation").alias("generation"))
    return rows.join(now, [*AT, "generation"], "left_semi").select("gx", "gy", *"rgba")


def build(path: str, pixels: DataFrame, width: int, height: int, tile: int = 256) -> int:
    """Writes all levels of pixels as generation 0; returns the highest level."""
    spark, top = pixels.sparkSession, max_level(width, height, tile)
    _write(path, 0, 0, pixels, tile)
    for level in range(1, top + 1):
        _write(path, level, 0, downsample(newest(spark, path, level - 1, before=1)), tile)
    return top


def update(path: str, pixels: DataFrame, changed: DataFrame, generation: int, top: int, tile: int = 256) -> None:
    """Brings a pyramid up to date with changed tiles (tx, ty) of level 0, whose pixels are among pixels.

    pixels may be a plan over all of an image, such as a composite of layers each cut to these tiles by ``only``; of it
    only the changed tiles are kept. A generation that is written again takes the place of what it held. A pixel that is
    gone leaves its tile; a tile without any is written as such if its place is in the index.
    """
    spark = pixels.sparkSession
    changed = changed.select(*(F.col(c).cast("long").alias(c) for c in AT)).distinct()
    _write(path, 0, generation, only(pixels, changed, tile), tile)
    _index(path, 0, generation, changed)
    below = changed
    for level in range(1, top + 1):
        parents = below.select(*(F.floor(F.col(c) / 2).alias(c) for c in AT)).distinct()
        child = F.explode(F.array(*(F.struct((F.col("tx") * 2 + dx).alias("tx"), (F.col("ty") * 2 + dy).alias("ty")) for dx in (0, 1) for dy in (0, 1))))
        children = parents.select(child.alias("c")).select("c.*")
        _write(path, level, generation, downsample(newest(spark, path, level - 1, children, generation + 1)), tile)
        _index(path, level, generation, parents)
        below = spark.read.schema("tx long, ty long").parquet(f"{path}/index/level={level}/generation={generation}")


def _index(path: str, level: int, generation: int, tiles: DataFrame) -> None:
    """The generation holds these tiles, with pixels or without."""
    tiles.coalesce(1).write.mode("overwrite").parquet(f"{path}/index/level={level}/generation={generation}")
