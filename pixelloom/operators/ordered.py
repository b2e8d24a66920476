"""Ordered dithering: thresholds by place, quantisation to levels or palettes. Column expressions, no shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp, cmyk_to_rgb, linear_to_oklab, linear_to_srgb, luma, lut_snap, nearest, num, oklab_of, palette_literal, rgb_to_cmyk, rounded
from pixelloom.functions.color import byte_of
from pixelloom.functions.grid import aligned, ediv, emod, fmod_floor
from pixelloom.operators import palette_table
from pixelloom.operators.point import RGB, columns, set_rgb

# The published Bayer matrices; the 8 x 8 one follows from these two.
BAYER2 = [[0, 2], [3, 1]]
BAYER4 = [[0, 8, 2, 10], [12, 4, 14, 6], [3, 11, 1, 9], [15, 7, 13, 5]]


def bayer(n: int) -> list[list[int]]:
    if n == 8:
        return [[4 * BAYER4[y % 4][x % 4] + BAYER2[y // 4][x // 4] for x in range(8)] for y in range(8)]
    return {2: BAYER2, 4: BAYER4}[n]


def map_threshold(rows: Sequence[Sequence[float]], x: Column, y: Column) -> Column:
    """A map of thresholds, repeated over the plane."""
    height, width = len(rows), len(rows[0])
    flat = F.array(*(F.lit(float(v)) for row in rows for v in row))
    return F.element_at(flat, (emod(y, height) * width + emod(x, width) + 1).cast("int"))


def bayer_threshold(n: int, x: Column, y: Column) -> Column:
    return map_threshold([[v / (n * n) for v in row] for row in bayer(n)], x, y)


def wave_threshold(x: Column, y: Column, wavelength: float, amplitude: float, phase: float = 0.0, angle: float = 0.0) -> Column:
    t = math.radians(angle)
    u = x.cast("double") * math.cos(t) + y.cast("double") * math.sin(t)
    return clamp(F.lit(0.5) + F.sin(u * (2 * math.pi) / wavelength + phase) * (0.5 * amplitude), 0.0, 0.999999)


def rotate(x: Column, y: Column, angle: float) -> tuple[Column, Column]:
    """Whole coordinates of the pattern turned by angle degrees."""
    angle = angle % 360
    if angle == 0:
        return x, y
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return F.floor(x * c - y * s).cast("long"), F.floor(x * s + y * c).cast("long")


def biased(t: Column, bias: float) -> Column:
    return t if bias == 0 else clamp(t + bias, 0.0, 0.999999)


def quantise(v: Column, t: Column, levels: int, scale: float) -> Column:
    n = float(levels - 1)
    return clamp(rounded(v * n + (t - 0.5) * scale), 0.0, n) / n


def quantise_guided(v: Column, t: Column, low: float, high: float, levels: int, scale: float = 1.0) -> Column:
    n = levels - 1.0
    q = clamp((v - low) / max(high - low, 1e-6)) * n
    cut = F.lit(0.5) + (t - 0.5) * scale
    step = F.floor(q) + F.when(q - F.floor(q) > cut, 1.0).otherwise(0.0)
    return F.lit(low) + F.least(step, F.lit(n)) / n * (high - low)


def channel_ranges(palette: Sequence[Sequence[float]]) -> list[tuple[float, float]]:
    out = []
    for c in zip(*palette, strict=True):
        out.append((min(c), max(c)) if max(c) - min(c) >= 1e-6 else (0.0, 1.0))
    return out


def guided_levels(palette: Sequence, levels: int | None = None) -> int:
    return levels or min(max(math.ceil(len(palette) ** (1 / 3) - 1e-9), 2), 16)


LAB = ("__ok_l", "__ok_a", "__ok_b")


def with_lab(pixels: DataFrame, rgb: Sequence[Column]) -> DataFrame:
    """pixels with the Oklab place of rgb, as columns of their own, so that searches do not work it out for each colour."""
    return pixels.withColumns(dict(zip(LAB, linear_to_oklab(rgb), strict=True)))


def pick_strict(palette: Sequence[Sequence[float]], t: Column, scale: float) -> list[Column]:
    """Of the two palette colours nearest to with_lab's place the second if the threshold is below its share of the distance."""
    if len(palette) == 1:
        return [F.lit(v) for v in palette[0]]
    two = nearest(palette_literal([oklab_of(c) for c in palette]), columns(*LAB), 2)
    mix = F.transform(F.array(two), lambda n: F.when(n[0]["d"] + n[1]["d"] <= 1.1920929e-07, 0.0).otherwise(F.sqrt(n[0]["d"]) / (F.sqrt(n[0]["d"]) + F.sqrt(n[1]["d"]))))[0]
    return entry(palette, F.when(F.lit(0.5) + (t - 0.5) * scale < mix, two[1]["i"]).otherwise(two[0]["i"]))


def entry(palette: Sequence[Sequence[float]], i: Column) -> list[Column]:
    return [F.element_at(F.array(*(F.lit(float(c[k])) for c in palette)), i + 1) for k in range(3)]


def pick_guided(rgb, palette, t, scale, levels=None) -> list[Column]:
    n = guided_levels(palette, levels)
    return [quantise_guided(v, t, low, high, n, scale) for v, (low, high) in zip(rgb, channel_ranges(palette), strict=True)]


def pick_simple(palette, at: Sequence[Column]) -> list[Column]:
    """The palette colour nearest to a place in bytes."""
    near = nearest(palette_literal([[byte_of(v) for v in c] for c in palette]), at)
    return entry(palette, F.element_at(near, 1)["i"])


def lut_nearest(pixels: DataFrame, palette: Sequence[Sequence[float]]) -> DataFrame:
    """Each pixel's nearest palette colour in Oklab, by the centre of its lookup cell; alpha stays."""
    placed = with_lab(pixels, columns(*RGB))
    if len(palette) > palette_table.FEW:  # one lookup a pixel, whatever the palette's size
        table = palette_table.cells(pixels.sparkSession, palette).select(F.col("cell").alias("__cell"), *(F.col(c).alias(f"__{c}") for c in RGB))
        near = placed.withColumn("__cell", palette_table.cell_number(columns(*LAB))).join(F.broadcast(table), "__cell")
        return set_rgb(near, [F.col(f"__{c}") for c in RGB]).select(*pixels.columns)
    placed = placed.withColumns(dict(zip(LAB, lut_snap(columns(*LAB)), strict=True)))
    near = placed.withColumn("__i", F.element_at(nearest(palette_literal([oklab_of(c) for c in palette]), columns(*LAB)), 1)["i"])
    return set_rgb(near, entry(palette, F.col("__i"))).drop(*LAB, "__i")


def map_alpha(a: Column, t: Column) -> Column:
    return F.when(a > t, 1.0).otherwise(0.0)


@dataclass(frozen=True)
class Dither:
    """mode: bayer2, bayer4, bayer8, wave or map; palette_mode: none, strict, guided, mixed or simple."""

    mode: str = "bayer4"
    levels: int = 4
    scale: float = 1.0
    bias: float = 0.0
    pixel_size: int = 1
    angle: float = 0.0
    grayscale: bool = False
    palette: tuple = ()
    palette_mode: str = "none"
    channel_levels: int | None = None
    dither_alpha: bool = True
    wavelength: float = 8.0
    amplitude: float = 1.0
    phase: float = 0.0
    threshold_map: tuple = ()

    def __post_init__(self):
        bad = not (2 <= self.levels <= 256 and 0.1 <= self.scale <= 4 and 1 <= self.pixel_size <= 32 and -0.5 <= self.bias <= 0.5 and math.isfinite(self.angle))
        bad |= not (2 <= self.wavelength <= 256 and 0 <= self.amplitude <= 1) or (self.channel_levels is not None and not 2 <= self.channel_levels <= 16)
        if bad or self.palette_mode not in ("none", "strict", "guided", "mixed", "simple"):
            raise ValueError(f"a dither parameter is out of range: {self}")

    def threshold(self, x: Column, y: Column) -> Column:
        if self.mode == "wave":
            bx, by = aligned(x, self.pixel_size), aligned(y, self.pixel_size)
            t = wave_threshold(bx, by, self.wavelength, self.amplitude, self.phase, self.angle)
        else:
            u, v = rotate(aligned(x, self.pixel_size), aligned(y, self.pixel_size), self.angle)
            u, v = ediv(u, self.pixel_size), ediv(v, self.pixel_size)
            t = map_threshold(self.threshold_map, u, v) if self.mode == "map" else bayer_threshold(int(self.mode[5:]), u, v)
        return biased(t, self.bias)

    def pick(self, pixels: DataFrame, rgb: Sequence[Column], t: Column) -> DataFrame:
        """pixels with the chosen colour as __r, __g, __b."""
        mode = self.palette_mode if self.palette else "none"  # without its palette a filter falls back to levels
        if mode in ("guided", "mixed"):
            rgb = pick_guided(rgb, self.palette, t, self.scale, self.channel_levels)
        if mode in ("strict", "mixed"):
            pixels = with_lab(pixels, rgb)
            rgb = pick_strict(self.palette, t, self.scale)
        elif mode == "simple":
            moved = [clamp(linear_to_srgb(v).cast("double") + (t - 0.5) * (self.scale * 64.0), 0.0, 255.0) for v in rgb]
            pixels = pixels.withColumns(dict(zip(LAB, moved, strict=True)))
            rgb = pick_simple(self.palette, columns(*LAB))
        elif mode == "none":
            rgb = [quantise(v, t, self.levels, self.scale) for v in rgb]
        return pixels.withColumns(dict(zip(("__r", "__g", "__b"), rgb, strict=True)))


def block_sources(pixels: DataFrame, size: int) -> DataFrame:
    """Each pixel with the colour of its block's first pixel, by row, then column; the window is one block."""
    if size == 1:
        return pixels
    block = Window.partitionBy(aligned(F.col("gx"), size), aligned(F.col("gy"), size)).orderBy("gy", "gx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return pixels.withColumns({c: F.first(c).over(block) for c in "rgba"})


def dither(pixels: DataFrame, p: Dither) -> DataFrame:
    pixels = block_sources(pixels, p.pixel_size)
    rgb = columns(*RGB)
    if p.grayscale:
        pixels = pixels.withColumn("__grey", luma(rgb))
        rgb = [F.col("__grey")] * 3
    pixels = pixels.withColumn("__t", p.threshold(F.col("gx"), F.col("gy")))
    pixels = p.pick(pixels, rgb, F.col("__t"))
    out = columns("__r", "__g", "__b")
    alpha = map_alpha(F.col("a"), F.col("__t")) if p.dither_alpha else F.col("a")
    clear = alpha <= 0.0
    rest = [c for c in pixels.columns if c not in "rgba" and not c.startswith("__")]
    return pixels.select(*rest, *(F.when(clear, 0.0).otherwise(x).alias(c) for x, c in zip(out, RGB, strict=True)), alpha.alias("a"))


def halftone(pixels: DataFrame, cell: float = 6.0, scale: float = 1.0, bias: float = 0.0, angles: Sequence[float] = (15.0, 75.0, 0.0, 45.0)) -> DataFrame:
    """Round dots of four inks, each on a grid of its own angle, area by tone."""
    if not 2 <= cell <= 64:
        raise ValueError("a cell is 2 to 64")
    inks = []
    for tone, angle in zip(rgb_to_cmyk(columns(*RGB)), angles, strict=True):
        c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
        x, y = F.col("gx").cast("double"), F.col("gy").cast("double")
        u, v = fmod_floor(x * c + y * s, cell) - cell / 2, fmod_floor(y * c - x * s, cell) - cell / 2
        reach = F.sqrt(clamp(tone + bias)) * (cell / 2 * scale)
        inks.append(F.when(F.sqrt(u * u + v * v) <= reach, 1.0).otherwise(0.0))
    return set_rgb(pixels, cmyk_to_rgb(inks))


def legacy(depth: int, pattern: str) -> Dither:
    """Older parameters: a bit depth and a pattern's name; unknown patterns become 4 x 4."""
    return Dither(mode={"Bayer2x2": "bayer2", "Bayer4x4": "bayer4", "Bayer8x8": "bayer8"}.get(pattern, "bayer4"), levels=min(2**depth, 256))


__all__ = ["Dither", "block_sources", "dither", "halftone", "legacy", "lut_nearest", "num"]
