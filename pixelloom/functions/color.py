"""Colour functions over Columns: transfer curves, Oklab and OkLCH, gamut, CMYK, palettes in literal form."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

Rgb = tuple[Column, Column, Column]

# The published Oklab matrices.
TO_LMS = [(0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005)]
TO_LAB = [(0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)]
FROM_LAB = [(1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480)]
TO_RGB = [(4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010)]
LUMA = (0.2126, 0.7152, 0.0722)


def num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, num(low)), num(high))


def rounded(x: Column) -> Column:
    """Half up, for values that are clamped to what is not negative later."""
    return F.floor(x + 0.5).cast("double")


def _times(matrix, v: Sequence[Column]) -> list[Column]:
    return [sum((F.lit(k) * x for k, x in zip(row[1:], v[1:], strict=True)), F.lit(row[0]) * v[0]) for row in matrix]


def luma(rgb: Rgb) -> Column:
    return rgb[0] * LUMA[0] + rgb[1] * LUMA[1] + rgb[2] * LUMA[2]


def srgb_to_linear(byte: Column) -> Column:
    n = byte / 255.0
    return F.when(n <= 0.04045, n / 12.92).otherwise(F.pow((n + 0.055) / 1.055, F.lit(2.4)))


def linear_to_srgb(x: Column) -> Column:
    """0 to 255 as int."""
    x = clamp(x)
    s = F.when(x <= 0.0031308, x * 12.92).otherwise(F.lit(1.055) * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return F.floor(s * 255.0 + 0.5).cast("int")


def to_u8(x: Column, mode: str = "preview") -> Column:
    """preview: half up; export: cut off; save: half away from zero, the same as half up for values that are clamped."""
    x = clamp(x) * 255.0
    return (F.floor(x) if mode == "export" else F.floor(x + 0.5)).cast("int")


def _finite(x: Column) -> Column:
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def linear_to_oklab(rgb: Rgb, clip: bool = True) -> list[Column]:
    rgb = [clamp(_finite(x)) if clip else _finite(x) for x in rgb]
    return _times(TO_LAB, [F.cbrt(x) for x in _times(TO_LMS, rgb)])


def oklab_to_linear(lab: Sequence[Column], clip: bool = True) -> list[Column]:
    lab = [_finite(x) for x in lab] if clip else lab
    out = _times(TO_RGB, [F.pow(x, F.lit(3.0)) for x in _times(FROM_LAB, lab)])
    return [clamp(x) for x in out] if clip else out


def distance2(a: Sequence[Column], b: Sequence[Column]) -> Column:
    (x, y, z), (u, v, w) = a, b
    return (x - u) * (x - u) + (y - v) * (y - v) + (z - w) * (z - w)


def oklab_to_oklch(lab: Sequence[Column]) -> list[Column]:
    return [lab[0], F.hypot(lab[1], lab[2]), F.atan2(lab[2], lab[1])]


def oklch_to_oklab(lch: Sequence[Column]) -> list[Column]:
    return [lch[0], lch[1] * F.cos(lch[2]), lch[1] * F.sin(lch[2])]


def out_of_gamut(lab: Sequence[Column]) -> Column:
    far = [F.abs(x - 0.5) for x in oklab_to_linear(lab, clip=False)]
    return F.greatest(*far) > 0.5 + 1e-4


@F.pandas_udf(DoubleType())
def _chroma_in_gamut(l: pd.Series, c: pd.Series, h: pd.Series, steps: pd.Series) -> pd.Series:
    """The largest chroma in gamut by bisection of 0 to c, for a batch of rows; 0 where c is null."""
    low = np.zeros(len(c))
    at = np.flatnonzero(c.notna())
    if len(at):
        light, high, hue = (x.to_numpy(np.float64)[at] for x in (l, c, h))
        cos, sin, least = np.cos(hue), np.sin(hue), np.zeros(len(at))
        with np.errstate(all="ignore"):
            for _ in range(int(steps.iloc[0])):
                mid = (least + high) / 2
                a, b = mid * cos, mid * sin
                lms = [(light + i * a + j * b) ** 3 for _, i, j in FROM_LAB]
                far = [np.abs(i * lms[0] + j * lms[1] + k * lms[2] - 0.5) for i, j, k in TO_RGB]
                good = np.maximum(np.maximum(far[0], far[1]), far[2]) <= 0.5 + 1e-4  # not so for what is not a number
                least, high = np.where(good, mid, least), np.where(good, high, mid)
        low[at] = least
    return pd.Series(low)


def gamut_clip(lab: Sequence[Column], steps: int = 32) -> list[Column]:
    """Lightness and hue stay; chroma is the largest in gamut found by bisection, over batches of those out of gamut."""
    l, c, h = oklab_to_oklch(lab)
    bad = out_of_gamut(lab)
    low = _chroma_in_gamut(l, F.when(bad, c), h, F.lit(steps))
    clipped = oklch_to_oklab([l, low, h])
    return [F.when(bad, y).otherwise(x) for x, y in zip(lab, clipped, strict=True)]


def rgb_to_cmyk(rgb: Rgb) -> list[Column]:
    """Under-colour removal: black is what all three inks share, the inks are what is left of them."""
    c, m, y = (1.0 - x for x in rgb)
    k = F.least(c, m, y)
    full = k >= 1.0 - 1.1920929e-07
    return [F.when(full, 0.0).otherwise(clamp((x - k) / (1.0 - k))) for x in (c, m, y)] + [F.when(full, 1.0).otherwise(clamp(k))]


def cmyk_to_rgb(cmyk: Sequence[Column]) -> list[Column]:
    """What is left of white under each ink and black, as dots lie on each other."""
    *inks, k = cmyk
    return [1.0 - F.least(F.lit(1.0), x + k) for x in inks]


def hex_to_bytes(text: Column) -> list[Column]:
    """#rrggbb or rrggbb, in either case, spaces around; null for anything else."""
    body = F.upper(F.regexp_replace(F.trim(text), "^#", ""))
    good = body.rlike("^[0-9A-F]{6}$")
    return [F.when(good, F.conv(F.substring(body, 1 + 2 * i, 2), 16, 10).cast("int")) for i in range(3)]


def bytes_to_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02X%02X%02X", r, g, b)


def blend_mode(mode: str, s: Column, d: Column) -> Column:
    """B(source, destination) of one channel."""
    one, two = F.lit(1.0), F.lit(2.0)
    screen = lambda a, b: one - two * (one - a) * (one - b)
    modes: dict[str, Callable[[], Column]] = {
        "normal": lambda: s,
        "multiply": lambda: s * d,
        "screen": lambda: s + d - s * d,
        "overlay": lambda: F.when(d < 0.5, two * s * d).otherwise(screen(s, d)),
        "darken": lambda: F.least(s, d),
        "lighten": lambda: F.greatest(s, d),
        "color_dodge": lambda: F.when(s >= 1.0, one).otherwise(F.least(d / (one - s), one)),
        "color_burn": lambda: F.when(s <= 0.0, F.lit(0.0)).otherwise(one - F.least((one - d) / s, one)),
        "hard_light": lambda: F.when(s < 0.5, two * s * d).otherwise(screen(s, d)),
        "soft_light": lambda: F.when(s <= 0.5, d - (one - two * s) * d * (one - d)).otherwise(d + (two * s - one) * (F.when(d <= 0.25, ((16.0 * d - 12.0) * d + 4.0) * d).otherwise(F.sqrt(d)) - d)),
        "difference": lambda: F.abs(s - d),
        "exclusion": lambda: s + d - two * s * d,
    }
    return modes[mode]()


BLEND_MODES = ["normal", "multiply", "screen", "overlay", "darken", "lighten", "color_dodge", "color_burn", "hard_light", "soft_light", "difference", "exclusion"]


def over(src: Sequence[Column], dst: Sequence[Column], mode: str = "normal", opacity=1.0) -> list[Column]:
    """src (r, g, b, a) laid over dst; straight colour in, and out as it is summed, not divided by alpha."""
    sa, da = src[3] * num(opacity), dst[3]
    rgb = [blend_mode(mode, s, d) * sa + d * da * (1.0 - sa) for s, d in zip(src[:3], dst[:3], strict=True)]
    none = sa < 1e-6
    return [F.when(none, d).otherwise(x) for x, d in zip([*rgb, sa + da * (1.0 - sa)], dst, strict=True)]


def palette_literal(colors: Sequence[Sequence[float]]) -> Column:
    """A small palette as an array of (i, x, y, z); for palettes of more than a thousand colours join instead."""
    if not 1 <= len(colors) <= 1000:
        raise ValueError("a literal palette holds 1 to 1000 colours")
    return F.array(*(F.struct(F.lit(i).alias("i"), *(F.lit(float(v)).alias(n) for v, n in zip(c, "xyz", strict=True))) for i, c in enumerate(colors)))


def nearest(palette: Column, at: Sequence[Column], k: int = 1) -> Column:
    """The k nearest entries as an array of (d, i, x, y, z), ties to the lower index."""
    near = F.transform(palette, lambda c: F.struct(distance2(at, [c["x"], c["y"], c["z"]]).alias("d"), c["i"].alias("i"), c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z")))
    return F.array(F.array_min(near)) if k == 1 else F.slice(F.array_sort(near), 1, k)


def lut_snap(lab: Sequence[Column], size: int = 64) -> list[Column]:
    """The centre of the grid cell that a colour falls into; the nearest colour of a lookup table is the centre's."""
    out = []
    for x, (low, high) in zip(lab, [(0.0, 1.0), (-0.4, 0.4), (-0.4, 0.4)], strict=True):
        t = clamp((x - low) / (high - low), 0.0, 1 - 1.1920929e-07)
        cell = F.least(F.floor(t * float(size)), F.lit(size - 1)).cast("double")
        out.append(F.lit(low) + (cell + 0.5) / float(size) * (high - low))
    return out


# The same in plain numbers, for palettes that are made while a plan is built.


def oklab_of(rgb: Sequence[float]) -> tuple[float, float, float]:
    rgb = [min(max(x, 0.0), 1.0) for x in rgb]
    lms = [math.cbrt(sum(k * x for k, x in zip(row, rgb, strict=True))) for row in TO_LMS]
    return tuple(sum(k * x for k, x in zip(row, lms, strict=True)) for row in TO_LAB)


def linear_of(byte: int) -> float:
    n = byte / 255
    return n / 12.92 if n <= 0.04045 else ((n + 0.055) / 1.055) ** 2.4


def byte_of(x: float) -> int:
    x = min(max(x, 0.0), 1.0)
    return math.floor(255 * (12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055) + 0.5)
