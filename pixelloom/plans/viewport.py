"""Which tiles a view needs, in which order, and what is evicted: relational forms of tile scheduling."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.plans.running import running_sum

#: Lower is sooner.
PRIORITIES = {"immediate": 0, "center": 1, "edge": 2, "prefetch": 3}


def level_of(zoom: float, most: int) -> int:
    zoom = min(max(zoom, 0.01), 64.0)
    return 0 if zoom >= 1 else min(math.floor(math.log2(1 / zoom)), most)


def visible(spark: SparkSession, x: float, y: float, width: float, height: float, zoom: float, nx: int, ny: int, tile: int = 256, most: int = 8) -> DataFrame:
    """(level, tx, ty) of the tiles of a level that a view of width x height screen pixels shows."""
    level = level_of(zoom, most)
    side = tile * 2**level
    gx, gy = -(-nx // 2**level), -(-ny // 2**level)
    x0, y0 = max(0, math.floor(x / side)), max(0, math.floor(y / side))
    x1, y1 = min(gx, math.ceil((x + width / zoom) / side)), min(gy, math.ceil((y + height / zoom) / side))
    w, h = max(0, x1 - x0), max(0, y1 - y0)
    return spark.range(w * h).select(F.lit(level).alias("level"), (F.col("id") % max(w, 1) + x0).alias("tx"), (F.floor(F.col("id") / max(w, 1)) + y0).alias("ty"))


def prefetch_ring(tiles: DataFrame, nx: int, ny: int) -> DataFrame:
    """The tiles one step around the box of those given."""
    box = tiles.agg(*(f(c).alias(f"{n}{c}") for c in ("tx", "ty") for n, f in (("lo", F.min), ("hi", F.max))))
    span = lambda c, n: F.explode(F.sequence(F.greatest(F.col(f"lo{c}") - 1, F.lit(0)), F.least(F.col(f"hi{c}") + 1, F.lit(n - 1))))
    around = box.withColumn("tx", span("tx", nx)).withColumn("ty", span("ty", ny))
    return around.select("tx", "ty").join(tiles.select("tx", "ty"), ["tx", "ty"], "left_anti")


def center_out(tiles: DataFrame) -> DataFrame:
    """tiles with their rank by distance from the middle of their box, ties by row, then column."""
    box = tiles.agg(((F.min("tx") + F.max("tx")) / 2).alias("cx"), ((F.min("ty") + F.max("ty")) / 2).alias("cy"))
    away = F.abs(F.col("tx") - F.col("cx")) + F.abs(F.col("ty") - F.col("cy"))
    far = tiles.crossJoin(F.broadcast(box)).withColumn("distance", away)
    ranked = running_sum(far.select("tx", "ty", "distance"), ["distance", "ty", "tx"], F.lit(1), "rank")
    return ranked.select("tx", "ty", "distance", F.col("rank").cast("int").alias("rank"))


def with_priority(tiles: DataFrame) -> DataFrame:
    """center for the middle half of the box in both directions, else edge."""
    box = tiles.agg(*(f(c).cast("double").alias(f"{n}{c}") for c in ("tx", "ty") for n, f in (("lo", F.min), ("hi", F.max))))
    near = lambda c: F.abs(F.col(c) - (F.col(f"lo{c}") + F.col(f"hi{c}")) / 2) <= (F.col(f"hi{c}") - F.col(f"lo{c}") + 1) / 4
    return tiles.crossJoin(F.broadcast(box)).select("tx", "ty", F.when(near("tx") & near("ty"), "center").otherwise("edge").alias("priority"))


def pending(tasks: DataFrame) -> DataFrame:
    """One task a key out of (key, priority int, generation): the most urgent, of equals the newest."""
    order = Window.partitionBy("key").orderBy("priority", F.desc("generation"))
    return tasks.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def evicted(tiles: DataFrame, budget: int) -> DataFrame:
    """Tiles to drop so that a document's cache fits its budget of bytes: those beyond it when kept in order of worth.

    tiles: doc, key, stage (raw, processed, composite), active, visible, bytes. Kept first: raw tiles of open documents,
    then what is visible, then active documents; the running sum is a document's own.
    """
    worth = F.when(F.col("stage") == "raw", 0).when(F.col("visible"), 1).when(F.col("active"), 2).otherwise(3)
    stage = F.when(F.col("stage") == "processed", 0).otherwise(1)
    order = Window.partitionBy("doc").orderBy("worth", "late", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = tiles.withColumns({"worth": worth, "late": stage}).withColumn("sum", F.sum("bytes").over(order))
    return kept.where((F.col("sum") > budget) & (F.col("stage") != "raw")).select(*tiles.columns)


def last_versions(versions: DataFrame, depth: int = 50) -> DataFrame:
    """A document's newest versions, at most depth of them."""
    order = Window.partitionBy("doc").orderBy(F.desc("version"))
    return versions.withColumn("n", F.row_number().over(order)).where(F.col("n") <= depth).drop("n")
