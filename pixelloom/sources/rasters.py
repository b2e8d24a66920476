"""Rasters derived from tables, as pixel rows (gx, gy, r, g, b, a) with doubles in 0 to 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp

WIDTH = 300
#: The longest side of a canvas.
SIDE = 8192
#: A literal palette: black, white, red, blue, green.
PALETTE5 = [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (1.0, 0.0, 0.0), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_raster(spark: SparkSession, sf_dir: str, width: int = WIDTH) -> DataFrame:
    e = table(spark, sf_dir, "events")
    unit = lambda x: F.pmod(x, F.lit(256)).cast("double") / 255.0
    step = F.col("event_id") % 10
    return e.select(
        (F.col("event_id") % width).cast("int").alias("gx"),
        F.floor(F.col("event_id") / width).cast("int").alias("gy"),
        unit(F.floor(F.col("value") * 100.0 + 0.5)).alias("r"),
        unit(F.col("user_id") * 37).alias("g"),
        unit(F.col("event_id") * 11).alias("b"),
        F.when(step == 0, 0.0).when(step == 1, 0.5).otherwise(1.0).alias("a"),
    )


def vector_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector an 8 x 8 patch, 64 patches a row."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.posexplode("embedding").alias("i", "x"))
    at = lambda k: clamp(F.element_at("embedding", ((F.col("i") + k) % 64 + 1).cast("int")).cast("double") + 0.5)
    return v.select(
        ((F.col("vec_id") % 64) * 8 + F.col("i") % 8).cast("int").alias("gx"),
        (F.floor(F.col("vec_id") / 64) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("gy"),
        at(0).alias("r"),
        at(1).alias("g"),
        at(2).alias("b"),
        F.lit(1.0).alias("a"),
    )


def mirrored(pixels: DataFrame, width: int = WIDTH) -> DataFrame:
    """The same grid mirrored left to right, channels turned by one."""
    return pixels.select((F.lit(width - 1) - F.col("gx")).cast("int").alias("gx"), "gy", F.col("g").alias("r"), F.col("b").alias("g"), F.col("r").alias("b"), "a")


def blank(spark: SparkSession, width: int, height: int, fill: str = "transparent") -> DataFrame:
    if not (1 <= width <= SIDE and 1 <= height <= SIDE):
        raise ValueError(f"width and height are 1 to {SIDE}")
    v = {"transparent": 0.0, "white": 1.0}[fill]
    n = spark.range(width * height)
    return n.select((F.col("id") % width).cast("int").alias("gx"), F.floor(F.col("id") / width).cast("int").alias("gy"), *(F.lit(v).alias(c) for c in "rgba"))
