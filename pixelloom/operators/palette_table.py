"""A palette's nearest colours, looked up by cell: Oklab cut into 64 x 64 x 64 cells, each with the colour nearest to its
centre. The table is built once for a palette, block of cells by block, from the few colours that can be nearest to any
cell of the block; a lookup then costs the same for a palette of any size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp, oklab_of

SIDE, BLOCK = 64, 8
LOW, HIGH = np.array([0.0, -0.4, -0.4]), np.array([1.0, 0.4, 0.4])
#: The most colours of a palette; up to so many are scanned, which is quicker than a table.
MOST, FEW = 65_535, 32


def cells_of(lab: np.ndarray) -> np.ndarray:
    """The places, along the three sides, of the cells that rows of Oklab fall into; beyond the table those at its edge."""
    t = np.clip((lab - LOW) / (HIGH - LOW), 0.0, 1 - 1.1920929e-07)
    return np.minimum(np.floor(t * SIDE), SIDE - 1)


def centres(cells: np.ndarray) -> np.ndarray:
    return LOW + (cells + 0.5) / SIDE * (HIGH - LOW)


def numbers(cells: np.ndarray) -> np.ndarray:
    return (cells @ np.array([SIDE * SIDE, SIDE, 1])).astype(np.int64)


def cell_number(lab: Sequence[Column]) -> Column:
    """numbers(cells_of(lab)) of columns."""
    at = lambda x, low, high: F.least(F.floor(clamp((x - float(low)) / float(high - low), 0.0, 1 - 1.1920929e-07) * SIDE), F.lit(SIDE - 1))
    i, j, k = (at(x, a, b) for x, a, b in zip(lab, LOW, HIGH, strict=True))
    return (i * (SIDE * SIDE) + j * SIDE + k).cast("int")


def _nearest_in_block(labs: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell numbers, the first of the nearest colours) of a block of 8 x 8 x 8 cells."""
    n = SIDE // BLOCK
    corner = np.array([block // (n * n), block // n % n, block % n]) * BLOCK
    cells = corner + np.stack(np.unravel_index(np.arange(BLOCK**3), (BLOCK,) * 3), 1)
    at = centres(cells)
    middle = centres(corner + (BLOCK - 1) / 2)
    radius = np.sqrt(np.square(at - middle).sum(1).max())
    far = np.sqrt(np.square(labs - middle).sum(1))
    may = np.flatnonzero(far <= far.min() + 2 * radius + 1e-9)
    best = np.empty(len(at), np.int64)
    step = max(1, (1 << 20) // len(may))
    for a in range(0, len(at), step):
        best[a : a + step] = may[np.square(at[a : a + step, None] - labs[None, may]).sum(2).argmin(1)]
    return numbers(cells), best


def _labs(palette) -> np.ndarray:
    if not 1 <= len(palette) <= MOST:
        raise ValueError(f"a palette has 1 to {MOST} colours")
    return np.array([oklab_of(c) for c in palette], float)


def table_of(palette) -> np.ndarray:
    """The nearest colour of each cell, by the cells' numbers."""
    labs, out = _labs(palette), np.empty(SIDE**3, np.int32)
    for block in range((SIDE // BLOCK) ** 3):
        cells, best = _nearest_in_block(labs, block)
        out[cells] = best
    return out


def cells(spark: SparkSession, palette) -> DataFrame:
    """(cell, r, g, b): table_of(palette) as 262,144 rows, worked out in tasks."""
    colours = np.array(palette, float)
    sent = spark.sparkContext.broadcast((_labs(palette), colours))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        labs, colours = sent.value
        for batch in batches:
            for block in batch["id"]:
                cell, best = _nearest_in_block(labs, int(block))
                yield pd.DataFrame({"cell": cell.astype(np.int32), **dict(zip("rgb", colours[best].T, strict=True))})

    return spark.range((SIDE // BLOCK) ** 3).mapInPandas(run, "cell int, r double, g double, b double")
