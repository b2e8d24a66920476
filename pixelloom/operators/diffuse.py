"""Error diffusion, tile by tile in a wavefront.

Tiles on one anti-diagonal depend only on tiles of the two before: what spills over a tile's right edge, bottom edge and
corner goes to its neighbours as residuals. Spills to the left, or more than two pixels past an edge, are dropped.

An image is cut into at most STEPS x STEPS blocks of tiles, the more the larger its share of all pixels; a step of the
wavefront is one job over the blocks of one diagonal of all images, so that the number of jobs is bounded whatever an
image's size. Inside of a task the tiles of a diagonal, of all its blocks and images, advance together, pixel by pixel, as
one array with a tile a place. Steps are written to the shared store, so that a lost executor costs one step. Results and
residuals can be kept as a table of generations (``diffuse_into``, ``rediffuse``), of which a change renews only the tiles
that it reaches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import LUMA, TO_LAB, TO_LMS
from pixelloom.operators import palette_table
from pixelloom.plans.store import Stages, removed, scratch

# The published kernels, as divisor and (dx, dy, weight).
KERNELS = {
    "floyd_steinberg": (16, [(1, 0, 7), (-1, 1, 3), (0, 1, 5), (1, 1, 1)]),
    "atkinson": (8, [(1, 0, 1), (2, 0, 1), (-1, 1, 1), (0, 1, 1), (1, 1, 1), (0, 2, 1)]),
    "jarvis_judice_ninke": (48, [(1, 0, 7), (2, 0, 5), (-2, 1, 3), (-1, 1, 5), (0, 1, 7), (1, 1, 5), (2, 1, 3), (-2, 2, 1), (-1, 2, 3), (0, 2, 5), (1, 2, 3), (2, 2, 1)]),
    "stucki": (42, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2), (-2, 2, 1), (-1, 2, 2), (0, 2, 4), (1, 2, 2), (2, 2, 1)]),
    "burkes": (32, [(1, 0, 8), (2, 0, 4), (-2, 1, 2), (-1, 1, 4), (0, 1, 8), (1, 1, 4), (2, 1, 2)]),
    "sierra": (32, [(1, 0, 5), (2, 0, 3), (-2, 1, 2), (-1, 1, 4), (0, 1, 5), (1, 1, 4), (2, 1, 2), (-1, 2, 2), (0, 2, 3), (1, 2, 2)]),
}


def weights(spark) -> DataFrame:
    """The kernels as rows: kernel, dx, dy, weight (a share)."""
    rows = [(k, dx, dy, w / total) for k, (total, taps) in KERNELS.items() for dx, dy, w in taps]
    return spark.createDataFrame(rows, "kernel string, dx int, dy int, weight double")


class Quantiser:
    """How pixels are worked on: src(rgb) gives working values, limits bound them, pick(v) gives (colours, their working values).

    All of these take arrays of rows of three; gain multiplies what is passed on.
    """

    limits, gain = (np.zeros(3), np.ones(3)), 1.0

    def src(self, rgb: np.ndarray) -> np.ndarray:
        return rgb

    def pick(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError


class Uniform(Quantiser):
    def __init__(self, levels: int):
        self.n = levels - 1

    def pick(self, v):
        q = np.clip(np.floor(v * self.n + 0.5), 0, self.n) / self.n
        return q, q


def _times(v: np.ndarray, matrix) -> np.ndarray:
    """Rows of three times a matrix, summed from left to right, as the same formula of columns is."""
    x = v[..., None, :] * np.asarray(matrix)
    return x[..., 0] + x[..., 1] + x[..., 2]


def oklab(rgb: np.ndarray) -> np.ndarray:
    """Rows of linear colours, clamped, in Oklab."""
    return _times(np.cbrt(_times(np.clip(rgb, 0, 1), TO_LMS)), TO_LAB)


def _nearest(v: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Of equally near spots the first."""
    return np.square(v[:, None] - spots[None]).sum(2).argmin(1)


class Strict(Quantiser):
    """The nearest palette colour by the centre of its lookup cell."""

    def __init__(self, palette):
        self.colors = np.array(palette, float)
        self.labs = oklab(self.colors)
        self.table = palette_table.table_of(palette) if len(palette) > palette_table.FEW else None

    def of_cell(self, lab: np.ndarray) -> np.ndarray:
        cells = palette_table.cells_of(lab)
        return _nearest(palette_table.centres(cells), self.labs) if self.table is None else self.table[palette_table.numbers(cells)]

    def pick(self, v):
        q = self.colors[self.of_cell(oklab(v))]
        return q, q


class Guided(Quantiser):
    """Levels of each channel between the palette's least and most; a channel that hardly varies counts as 0 to 1."""

    def __init__(self, palette, levels: int | None = None):
        colors = np.array(palette, float)
        self.low, self.high = colors.min(0), colors.max(0)
        flat = self.high - self.low < 1e-6
        self.low[flat], self.high[flat] = 0.0, 1.0
        self.n = (levels or min(max(math.ceil(round(len(colors) ** (1 / 3), 9)), 2), 16)) - 1

    def pick(self, v):
        span = self.high - self.low
        x = np.clip((v - self.low) / np.maximum(span, 1e-6), 0, 1) * self.n
        q = self.low + np.minimum(np.floor(x) + (x - np.floor(x) > 0.5), self.n) / self.n * span
        return q, q


class Mixed(Guided):
    """The palette colour nearest to the guided value; what is passed on is held against that colour."""

    def __init__(self, palette, levels: int | None = None):
        super().__init__(palette, levels)
        self.colors = np.array(palette, float)
        self.labs = oklab(self.colors)

    def pick(self, v):
        q = self.colors[_nearest(oklab(super().pick(v)[0]), self.labs)]
        return q, q


def srgb_bytes(rgb: np.ndarray) -> np.ndarray:
    x = np.clip(rgb, 0, 1)
    return np.floor(np.where(x <= 0.0031308, 12.92 * x, 1.055 * np.power(x, 1 / 2.4) - 0.055) * 255 + 0.5)


class Simple(Quantiser):
    """The nearest palette colour by sRGB bytes, in which the error is passed on, too."""

    limits = (np.zeros(3), np.full(3, 255.0))

    def __init__(self, palette, scale: float = 1.0):
        self.colors, self.gain = np.array(palette, float), scale
        self.bytes = srgb_bytes(self.colors)

    def src(self, rgb):
        return srgb_bytes(rgb)

    def pick(self, v):
        i = _nearest(v, self.bytes)
        return self.colors[i], self.bytes[i]


class InOklab(Strict):
    """Strict, with the error passed on in Oklab."""

    limits = (np.array([0.0, -0.5, -0.5]), np.array([1.0, 0.5, 0.5]))

    def src(self, rgb):
        return oklab(rgb)

    def pick(self, v):
        i = self.of_cell(v)
        return self.colors[i], self.labs[i]


MODES = {"strict": Strict, "guided": Guided, "mixed": Mixed, "simple": Simple}


def _skewed(core: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, columns) of pixels that don't wait for each other, in an order in which none waits for a later one.

    All kernels reach two pixels back on lower rows, so that pixels of equal x + 3 y go together.
    """
    for d in range(4 * core - 3):
        y = np.arange(max(0, -(-(d - core + 1) // 3)), min(core - 1, d // 3) + 1)
        yield y, d - 3 * y


def _rows_of(kernel: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(dy, dx from left to right, shares) of a kernel's rows; each is without gaps."""
    total, taps = KERNELS[kernel]
    out = []
    for dy in sorted({t[1] for t in taps}):
        row = sorted((dx, w) for dx, y, w in taps if y == dy)
        out.append((dy, np.array([dx for dx, _ in row]), np.array([w / total for _, w in row])))
    return out


def diffuse_tiles(px: np.ndarray, how: Quantiser, kernel: str, left=None, top=None, diag=None, backward: bool = False, serpentine: bool = False, grayscale: bool = False, dither_alpha: bool | None = True):
    """(results, right, bottom, corner) of n tiles, n x core x core x 4, that advance together.

    Residuals are of two columns, two rows, two by two, for each tile; None for those that come in is as if all were 0.
    backward: with serpentine, whether the tiles' first rows run backward. dither_alpha: None keeps colours and alpha of
    all pixels.
    """
    n, core = px.shape[:2]
    err = np.zeros((core + 2, core + 4, n, 3))  # two columns before the tile, for what is dropped there
    for part, at in ((left, np.s_[:core, 2:4]), (top, np.s_[:2, 2 : core + 2]), (diag, np.s_[:2, 2:4])):
        if part is not None:
            err[at] += part.transpose(1, 2, 0, 3)
    luma = [LUMA]
    rgb = px[..., :3].transpose(1, 2, 0, 3)
    src = np.repeat(_times(rgb, luma), 3, 3) if grayscale else how.src(rgb.reshape(-1, 3)).reshape(core, core, n, 3)
    out, low, high = np.zeros((core, core, n, 3)), *how.limits
    taps = _rows_of(kernel)

    def step(v):
        v = np.minimum(np.maximum(v, low), high)
        q, own = how.pick(v.reshape(-1, 3))
        q, own = q.reshape(v.shape), own.reshape(v.shape)
        return q, (v - _times(own, luma) if grayscale else v - own) * how.gain

    if serpentine:  # a row that runs backward waits for the whole row before: pixels go one by one, all tiles at once
        turned = [(dy, -dx[::-1], w[::-1]) for dy, dx, w in taps]
        shaped = {turn: [(dy, int(dx[0]) + 2, len(dx), w[:, None, None]) for dy, dx, w in rows] for turn, rows in ((1, taps), (-1, turned))}
        for y in range(core):
            turn = -1 if (backward + y) % 2 else 1
            for x in range(core)[::turn]:
                q, d = step(src[y, x] + err[y, x + 2])
                out[y, x] = q
                for dy, first, m, w in shaped[turn]:
                    err[y + dy, x + first : x + first + m] += d * w
    else:
        for y, x in _skewed(core):
            q, d = step(src[y, x] + err[y, x + 2])
            out[y, x] = q
            for dy, dx, w in taps:
                err[y[:, None] + dy, x[:, None] + dx + 2] += d[:, None] * w[:, None, None]
    alpha = px[..., 3] if not dither_alpha else (px[..., 3] > 0.5).astype(float)
    full = np.concatenate((out.transpose(2, 0, 1, 3), alpha[..., None]), 3)
    if dither_alpha:
        full[alpha <= 0] = 0
    err = err.transpose(2, 0, 1, 3)
    return full, err[:, :core, core + 2 :], err[:, core:, 2 : core + 2], err[:, core:, core + 2 :]


def diffuse_tile(px: np.ndarray, gy: int, how: Quantiser, kernel: str, left=None, top=None, diag=None, serpentine: bool = False, grayscale: bool = False, dither_alpha: bool | None = True, core: int = 256):
    """diffuse_tiles of one tile, whose first row is gy."""
    one = [None if x is None else np.asarray(x)[None] for x in (left, top, diag)]
    return tuple(x[0] for x in diffuse_tiles(px[None, :core, :core], how, kernel, *one, backward=bool(gy % 2), serpentine=serpentine, grayscale=grayscale, dither_alpha=dither_alpha))


#: The most blocks of tiles along a side of an image.
STEPS = 16
#: A finished tile: its pixels and which of them there are, and what it passes on.
_DONE = "image long, tx long, ty long, px binary, has binary, right binary, bottom binary, corner binary"
_SENT = "image long, sx long, sy long, line long, tx long, ty long, px binary, has binary, right binary, bottom binary, corner binary"


def to_tiles(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """(image, tx, ty, px, has): a tile a row, its pixels as doubles; at most tile^2 pixel rows meet in a group."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        px, has = np.zeros((tile, tile, 4)), np.zeros((tile, tile), bool)
        y, x = rows["gy"] % tile, rows["gx"] % tile
        px[y, x], has[y, x] = rows[list("rgba")], True
        return pd.DataFrame({"image": [rows["image"][0]], "tx": [rows["tx"][0]], "ty": [rows["ty"][0]], "px": [px.tobytes()], "has": [np.packbits(has).tobytes()]})

    keyed = pixels.withColumns({"tx": F.floor(F.col("gx") / tile), "ty": F.floor(F.col("gy") / tile), "image": F.col("image").cast("long")})
    return keyed.groupBy("image", "tx", "ty").applyInPandas(pack, "image long, tx long, ty long, px binary, has binary")


def to_pixels(done: DataFrame, tile: int = 256) -> DataFrame:
    """Tiles (image, tx, ty, px, has) as pixels (image, gx, gy, r, g, b, a)."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for r in rows.itertuples():
                at = np.flatnonzero(np.unpackbits(np.frombuffer(r.has, np.uint8))[: tile * tile])
                px, (y, x) = np.frombuffer(r.px, float).reshape(-1, 4)[at], np.divmod(at, tile)
                yield pd.DataFrame({"image": r.image, "gx": (r.tx * tile + x).astype("int32"), "gy": (r.ty * tile + y).astype("int32"), **{c: px[:, i] for i, c in enumerate("rgba")}})

    return done.select("image", "tx", "ty", "px", "has").mapInPandas(unpack, "image long, gx int, gy int, r double, g double, b double, a double")


def _advance(how: Quantiser, kernel: str, serpentine: bool, grayscale: bool, dither_alpha: bool, tile: int):
    """A function over tiles sorted by line, those that are done already first, without pixels."""
    most = max(1, (1 << 21) // (tile * tile))  # tiles that advance together

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spilled: dict[tuple, list] = {}
        waiting, line = [], None

        def near(r, dx, dy, k, *shape):
            got = spilled.get((r.image, r.tx - dx, r.ty - dy))
            return np.zeros(shape) if got is None else np.frombuffer(got[k], float).reshape(*shape)

        def advance(rows):
            px = np.stack([np.frombuffer(r.px, float).reshape(tile, tile, 4) for r in rows])
            residuals = [np.stack([near(r, *at) for r in rows]) for at in ((1, 0, 0, tile, 2, 3), (0, 1, 1, 2, tile, 3), (1, 1, 2, 2, 2, 3))]
            found = diffuse_tiles(px, how, kernel, *residuals, backward=bool(rows[0].ty * tile % 2), serpentine=serpentine, grayscale=grayscale, dither_alpha=dither_alpha)
            out = []
            for i, r in enumerate(rows):
                done, *over = (np.ascontiguousarray(x[i]).tobytes() for x in found)
                spilled[r.image, r.tx, r.ty] = [*over, r.line]
                out.append((r.image, r.tx, r.ty, done, r.has, *over))
            return pd.DataFrame(out, columns=[x.split()[0] for x in _DONE.split(", ")])

        def flush():
            for odd in (0, 1):
                some = [r for r in waiting if r.ty * tile % 2 == odd]
                for a in range(0, len(some), most):
                    yield advance(some[a : a + most])

        for batch in batches:
            for r in batch.itertuples():
                if r.px is None:
                    spilled[r.image, r.tx, r.ty] = [r.right, r.bottom, r.corner, None]
                    continue
                if r.line != line or len(waiting) >= 2 * most:
                    yield from flush()
                    waiting.clear()
                    if r.line != line:
                        line = r.line
                        for key in [k for k, v in spilled.items() if v[3] is not None and v[3] < line - 2]:
                            del spilled[key]
                waiting.append(r)
        yield from flush()

    return run


def _wavefront(pixels: DataFrame, known: DataFrame | None, path: str, how: dict, tile: int) -> DataFrame:
    """Finished tiles (_DONE) of pixels, in path; known: residuals (image, tx, ty, right, bottom, corner) of tiles around."""
    spark = pixels.sparkSession
    stages = Stages(spark)
    pixels = pixels.withColumn("image", F.col("image").cast("long"))
    size = pixels.groupBy("image").agg(*(f(F.floor(F.col(g) / tile)).alias(n) for g, f, n in (("gx", F.min, "x0"), ("gy", F.min, "y0"), ("gx", F.max, "x1"), ("gy", F.max, "y1"))), F.count("*").alias("n"))
    size = stages.put(size, "images")
    total, images = size.agg(F.sum("n"), F.count("*")).first()
    if not images:
        stages.close()
        return spark.createDataFrame([], _DONE)
    cuts = F.least(F.greatest(F.ceil(F.col("n") * F.lit(float(spark.sparkContext.defaultParallelism) / total)), F.lit(1)), F.lit(STEPS))
    side = lambda a, b: F.ceil((F.col(b) - F.col(a) + 1) / cuts).cast("long")
    plan = size.select("image", "x0", "y0", side("x0", "x1").alias("w"), side("y0", "y1").alias("h"))
    beside = lambda df: df.join(F.broadcast(plan) if images <= 1 << 18 else plan, "image")
    block = lambda dx=0, dy=0: (F.floor((F.col("tx") + dx - F.col("x0")) / F.col("w")), F.floor((F.col("ty") + dy - F.col("y0")) / F.col("h")))
    tiles = beside(to_tiles(pixels, tile)).withColumns(dict(zip(("sx", "sy"), block(), strict=True)))
    tiles = tiles.withColumn("line", F.col("tx") + F.col("ty") - F.col("x0") - F.col("y0")).drop("x0", "y0", "w", "h")
    tiles.withColumn("step", F.col("sx") + F.col("sy")).write.partitionBy("step").parquet(f"{path}/tiles")
    tiles = spark.read.parquet(f"{path}/tiles")
    last = tiles.agg(F.max("step")).first()[0]

    def spilling(done: DataFrame, inside: bool) -> DataFrame:
        """Residuals for the blocks that they reach; inside: but for the block that a tile lies in itself."""
        own = F.struct(*(c.alias(n) for c, n in zip(block(), ("sx", "sy"), strict=True)))
        to = F.array_distinct(F.array(*(F.struct(*(c.alias(n) for c, n in zip(block(dx, dy), ("sx", "sy"), strict=True))) for dx, dy in ((1, 0), (0, 1), (1, 1)))))
        rows = beside(done.select("image", "tx", "ty", "right", "bottom", "corner")).select("image", "tx", "ty", "right", "bottom", "corner", own.alias("own"), F.explode(to).alias("to"))
        rows = rows.where("to <> own") if inside else rows
        return rows.select("image", "to.sx", "to.sy", F.lit(-1).cast("long").alias("line"), "tx", "ty", F.lit(None).cast("binary").alias("px"), F.lit(None).cast("binary").alias("has"), "right", "bottom", "corner")

    around = None if known is None else stages.put(spilling(known, False).withColumn("step", F.col("sx") + F.col("sy")), "around")
    none = [F.lit(None).cast("binary").alias(c) for c in ("right", "bottom", "corner")]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for d in range(last + 1):
        rows = tiles.where(F.col("step") == d).select("image", "sx", "sy", "line", "tx", "ty", "px", "has", *none)
        if d:
            before = spark.read.schema(_DONE + ", step int").parquet(f"{path}/done").where(F.col("step").isin(d - 1, d - 2))
            rows = rows.unionByName(spilling(before, True).where(F.col("sx") + F.col("sy") == d))
        if around is not None:
            rows = rows.unionByName(around.where(F.col("step") == d).drop("step"))
        dealt = rows.repartition(n, "image", "sx", "sy").sortWithinPartitions("line")
        dealt.mapInPandas(_advance(**how, tile=tile), _DONE).write.parquet(f"{path}/done/step={d}")
    stages.close()
    removed(spark, f"{path}/tiles")
    return spark.read.schema(_DONE + ", step int").parquet(f"{path}/done").drop("step")


def _how(levels, kernel, palette, serpentine, grayscale, dither_alpha, palette_mode) -> dict:
    quantise = MODES[palette_mode](palette) if palette else Uniform(levels)
    return dict(how=quantise, kernel=kernel, serpentine=serpentine, grayscale=grayscale, dither_alpha=dither_alpha)


def error_diffusion(pixels: DataFrame, levels: int = 2, kernel: str = "floyd_steinberg", palette=None, serpentine: bool = False, grayscale: bool = False, dither_alpha: bool = True, tile: int = 256, palette_mode: str = "strict", pixel_size: int = 1) -> DataFrame:
    """pixels (image, gx, gy, r, g, b, a) with diffused colours. palette_mode: strict, guided, mixed or simple.

    pixel_size: blocks of so many pixels take the result of their first pixel, by row, then column, and error goes from
    block to block; a tile then is of so many blocks. Images don't wait for each other.
    """
    if pixel_size > 1:
        how = dict(levels=levels, kernel=kernel, palette=palette, serpentine=serpentine, grayscale=grayscale, dither_alpha=dither_alpha, tile=tile, palette_mode=palette_mode)
        return _by_blocks(pixels, pixel_size, how)
    done = _wavefront(pixels, None, scratch(pixels.sparkSession, "wavefront"), _how(levels, kernel, palette, serpentine, grayscale, dither_alpha, palette_mode), tile)
    return to_pixels(done, tile)


def diffuse_into(path: str, pixels: DataFrame, generation: int = 0, tile: int = 256, known: DataFrame | None = None, levels: int = 2, kernel: str = "floyd_steinberg", palette=None, serpentine: bool = False, grayscale: bool = False, dither_alpha: bool = True, palette_mode: str = "strict") -> None:
    """Diffuses pixels and adds their tiles, with what they pass on, to the table in path as a generation.

    A generation that is written again, as after a failure, takes the place of what it held.
    """
    spark = pixels.sparkSession
    work = scratch(spark, "wavefront")
    done = _wavefront(pixels, known, work, _how(levels, kernel, palette, serpentine, grayscale, dither_alpha, palette_mode), tile)
    done.write.mode("overwrite").parquet(f"{path}/generation={generation}")
    removed(spark, work)


def newest_tiles(spark, path: str, before: int | None = None) -> DataFrame:
    """Of each tile in the table its newest generation (of those before one, if it is given).

    Which is newest is settled on keys alone; the tiles themselves are read once and not grouped.
    """
    rows = spark.read.schema(_DONE + ", generation int").parquet(path)
    rows = rows if before is None else rows.where(F.col("generation") < before)
    newest = rows.groupBy("image", "tx", "ty").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["image", "tx", "ty", "generation"], "left_semi")


def stale_cone(tiles: DataFrame, changed: DataFrame) -> DataFrame:
    """The tiles (image, tx, ty) that changes of tiles reach: at or to the right of, and at or below, one that changed."""
    first = changed.groupBy("image", "ty").agg(F.min("tx").alias("from"))
    rows = tiles.select("image", "ty").distinct().join(first, ["image", "ty"], "left")
    rows = rows.select("image", "ty", F.min("from").over(Window.partitionBy("image").orderBy("ty")).alias("from"))
    return tiles.select("image", "tx", "ty").distinct().join(rows, ["image", "ty"]).where(F.col("tx") >= F.col("from")).select("image", "tx", "ty")


def rediffuse(path: str, pixels: DataFrame, changed: DataFrame, generation: int, tile: int = 256, **how) -> DataFrame:
    """Brings the table in path up to date with changed tiles (image, tx, ty) of pixels; returns the tiles that it renewed.

    Only those that a change reaches are diffused again, from the residuals that are kept of the tiles around them.
    """
    spark = pixels.sparkSession
    stages = Stages(spark)
    changed = changed.select(*(F.col(c).cast("long").alias(c) for c in ("image", "tx", "ty"))).distinct()
    kept = newest_tiles(spark, path, generation)
    stale = stages.keep(stale_cone(kept.select("image", "tx", "ty").unionByName(changed), changed), "stale")
    next_to = lambda dx, dy: stale.select("image", (F.col("tx") - dx).alias("tx"), (F.col("ty") - dy).alias("ty"))
    border = next_to(1, 0).unionByName(next_to(0, 1)).unionByName(next_to(1, 1)).distinct().join(stale, ["image", "tx", "ty"], "left_anti")
    known = kept.select("image", "tx", "ty", "right", "bottom", "corner").join(border, ["image", "tx", "ty"], "left_semi")
    placed = pixels.withColumns({"image": F.col("image").cast("long"), "__tx": F.floor(F.col("gx") / tile), "__ty": F.floor(F.col("gy") / tile)})
    at = stale.select("image", F.col("tx").alias("__tx"), F.col("ty").alias("__ty"))
    some = placed.join(at, ["image", "__tx", "__ty"], "left_semi").drop("__tx", "__ty")
    diffuse_into(path, some, generation, tile, known=stages.put(known, "known"), **how)
    stages.close()
    return stale


def _by_blocks(pixels: DataFrame, size: int, how: dict) -> DataFrame:
    """Diffusion of one pixel a block, and its colour for all of the block; without dither_alpha each pixel keeps its alpha."""
    placed = pixels.select(F.col("image").cast("long").alias("image"), "gx", "gy", *"rgba", F.floor(F.col("gx") / size).cast("int").alias("bx"), F.floor(F.col("gy") / size).cast("int").alias("by"))
    first = placed.groupBy("image", "bx", "by").agg(F.min_by(F.struct(*"rgba"), F.struct("gy", "gx")).alias("v"))
    done = error_diffusion(first.select("image", F.col("bx").alias("gx"), F.col("by").alias("gy"), "v.*"), **how)
    done = done.select("image", F.col("gx").alias("bx"), F.col("gy").alias("by"), *(F.col(c).alias(f"d_{c}") for c in "rgba"))
    alpha = F.col("d_a") if how["dither_alpha"] else F.col("a")
    return placed.join(done, ["image", "bx", "by"]).select("image", "gx", "gy", *(F.col(f"d_{c}").alias(c) for c in "rgb"), alpha.alias("a"))


def palette_diffusion(pixels: DataFrame, palette, kernel: str = "floyd_steinberg", tile: int = 256, halo: int = 2) -> DataFrame:
    """pixels (image, gx, gy, r, g, b, a) in palette colours, error passed on in Oklab; alpha stays.

    Each tile is worked on by itself, over its pixels and its halo, with nothing from its neighbours; beyond the image all
    is 0. A pixel is sent to the up to four tiles that hold it: at most (tile + 2 halo)^2 rows meet in a group.
    """
    how, side = InOklab(palette), tile + 2 * halo
    owners = lambda g: F.sequence(F.greatest(F.floor((F.col(g) - halo) / tile), F.lit(0).cast("long")), F.floor((F.col(g) + halo) / tile))
    sent = pixels.withColumn("image", F.col("image").cast("long")).withColumn("tx", F.explode(owners("gx"))).withColumn("ty", F.explode(owners("gy")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x = (rows["gx"] - rows["tx"] * tile + halo).to_numpy()
        y = (rows["gy"] - rows["ty"] * tile + halo).to_numpy()
        px = np.zeros((side, side, 4))
        px[y, x] = rows[list("rgba")]
        out = diffuse_tile(px, 0, how, kernel, dither_alpha=None, core=side)[0]
        core = (x >= halo) & (x < tile + halo) & (y >= halo) & (y < tile + halo)
        mine = rows[core]
        return pd.DataFrame({"image": mine["image"], "gx": mine["gx"], "gy": mine["gy"], **{c: out[y[core], x[core], k] for k, c in enumerate("rgba")}})

    return sent.groupBy("image", "tx", "ty").applyInPandas(run, "image long, gx int, gy int, r double, g double, b double, a double")


def tile_dependencies(tiles: DataFrame) -> DataFrame:
    """Edges (tx, ty, needs_tx, needs_ty) of the wavefront: left, above, and across the corner."""
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1)))))
    near = tiles.withColumn("s", steps).select("tx", "ty", (F.col("tx") - F.col("s.dx")).alias("needs_tx"), (F.col("ty") - F.col("s.dy")).alias("needs_ty"))
    return near.where("needs_tx >= 0 AND needs_ty >= 0")


def causal_prefix(tiles: DataFrame, tx: int, ty: int) -> DataFrame:
    """The tiles that must be done before and with tile (tx, ty)."""
    return tiles.where((F.col("tx") <= tx) & (F.col("ty") <= ty))


def downstream(tiles: DataFrame, tx: int, ty: int) -> DataFrame:
    """The tiles whose residuals a change of tile (tx, ty) makes stale."""
    return tiles.where((F.col("tx") >= tx) & (F.col("ty") >= ty))
