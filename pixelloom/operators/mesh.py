"""Rectangles of one colour, greedily: from each free pixel in the order of rows as wide as it goes, then as tall.

An image is worked on in bands of rows, one band after the other for all images at once. Rectangles that touch a band's
last row are carried into the next, where they grow before anything in it is begun, as they would in one piece: bands don't
cut rectangles, and the result is that of the whole image. A step is written to the shared store.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.store import Stages

_RECT = "image long, x int, y int, w int, h int, r int, g int, b int, a int"


def mesh_band(px: np.ndarray, y0: int, carried: list[tuple], tolerance: int, last: bool) -> tuple[list[tuple], list[tuple]]:
    """(finished, still growing) rectangles (x, y, w, h, r, g, b, a) of a band height x width x 4 that begins at row y0.

    A pixel matches a rectangle if no channel is further than the tolerance from that of its first pixel; pixels with
    alpha 0 begin none.
    """
    height, width, _ = px.shape
    free, px = np.ones((height, width), bool), px.astype(np.int16)
    matches = lambda some, colour: (np.abs(some - np.array(colour, np.int16)) <= tolerance).all(-1)

    def grown(x, y, w, h, colour, at):
        """The rectangle with what it takes of the rows from at on, and whether it may go on below the band."""
        while at < height:
            if not (free[at, x : x + w] & matches(px[at, x : x + w], colour)).all():
                return (x, y, w, h, *colour), False
            free[at, x : x + w] = False
            at, h = at + 1, h + 1
        return (x, y, w, h, *colour), not last

    done: list[tuple] = []
    open_: list[tuple] = []
    for x, y, w, h, *colour in carried:
        if x + w > width:
            done.append((x, y, w, h, *colour))
            continue
        rect, on = grown(x, y, w, h, tuple(colour), 0)
        (open_ if on else done).append(rect)
    for row in range(height):
        x = 0
        while x < width:
            colour = tuple(int(v) for v in px[row, x])
            if not free[row, x] or colour[3] == 0:
                x += 1
                continue
            same = free[row, x:] & matches(px[row, x:], colour)
            w = len(same) if same.all() else int(np.argmin(same))
            rect, on = grown(x, y0 + row, w, 0, colour, row)
            (open_ if on else done).append(rect)
            x += w
    return done, open_


def rectangles(pixels: DataFrame, tolerance: int = 0, band: int = 64) -> DataFrame:
    """(image, x, y, w, h, r, g, b, a) of pixels (image, gx, gy, r, g, b, a), channels 0 to 255.

    Missing pixels are clear; an image is as wide as its widest row. A group is a band of an image and the rectangles that
    reach it; there are as many steps as the tallest image has bands.
    """
    spark = pixels.sparkSession
    stages = Stages(spark)
    px = pixels.select(F.col("image").cast("long").alias("image"), *(F.col(c).cast("int").alias(c) for c in ("gx", "gy", "r", "g", "b", "a"))).where("a > 0")
    sizes = stages.put(px.groupBy("image").agg((F.max("gx") + 1).alias("width"), F.floor(F.max("gy") / band).cast("int").alias("bands")), "sizes")
    most = sizes.agg(F.max("bands")).first()[0]
    if most is None:
        stages.close()
        return spark.createDataFrame([], _RECT)
    few = sizes.limit((1 << 20) + 1).count() <= 1 << 20
    beside = lambda df: df.join(F.broadcast(sizes) if few else sizes, "image")
    banded = stages.put(beside(px).withColumn("band", F.floor(F.col("gy") / band).cast("int")), "bands") if most else beside(px).withColumn("band", F.lit(0))
    kind = "open boolean, " + _RECT
    columns = [c.split()[0] for c in kind.split(", ")]
    def of_band(n: int):
        def step(some: pd.DataFrame) -> pd.DataFrame:
            image, width = int(some["image"].iloc[0]), int(some["width"].iloc[0])
            dots, before = some[some["gx"].notna()], some[some["x"].notna()]
            at = np.zeros((band, width, 4), np.uint8)
            at[dots["gy"].to_numpy(int) - n * band, dots["gx"].to_numpy(int)] = dots[list("rgba")].to_numpy(np.uint8)
            done, on = mesh_band(at, n * band, [tuple(map(int, r)) for r in before[["x", "y", "w", "h", *"rgba"]].itertuples(index=False)], tolerance, n >= int(some["bands"].iloc[0]))
            return pd.DataFrame([(k, image, *r) for k, rects in ((False, done), (True, on)) for r in rects], columns=columns)

        return step

    found, carried = None, None
    for n in range(most + 1):
        rows = banded.where(F.col("band") == n).select("image", "width", "bands", F.lit(None).cast("int").alias("x"), F.lit(None).cast("int").alias("y"), F.lit(None).cast("int").alias("w"), F.lit(None).cast("int").alias("h"), "gx", "gy", *"rgba")
        # an image whose band has no pixels still ends its open rectangles
        if carried is not None:
            rows = rows.unionByName(beside(carried).select("image", "width", "bands", "x", "y", "w", "h", F.lit(None).cast("int").alias("gx"), F.lit(None).cast("int").alias("gy"), *"rgba"))

        made = stages.put(rows.groupBy("image").applyInPandas(of_band(n), kind), f"step{n}")
        ended = made.where("NOT open").drop("open")
        found, carried = ended if found is None else found.unionByName(ended), made.where("open").drop("open")
    result = stages.keep(found, "rectangles")
    stages.close()
    return result
