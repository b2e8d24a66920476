"""Filters of one pixel at a time. Each takes and returns pixel rows; all are Column expressions without a shuffle."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import clamp, luma, over
from pixelloom.functions.grid import ediv, emod, hash01

LUT = 4096
RGB = ("r", "g", "b")


def columns(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def set_rgb(pixels: DataFrame, rgb: Sequence[Column]) -> DataFrame:
    return pixels.withColumns(dict(zip(RGB, rgb, strict=True)))


def lookup(table: Sequence[float], x: Column) -> Column:
    """A table of LUT values over 0 to 1, between entries by straight lines."""
    entries = F.array(*(F.lit(float(v)) for v in table)) if len(table) <= 64 else F.from_json(F.lit(str([float(v) for v in table])), "array<double>")
    at = clamp(x) * float(len(table) - 1)
    low = F.floor(at).cast("int")
    high = F.least(low + 1, F.lit(len(table) - 1))
    f = at - low
    return F.element_at(entries, low + 1) * (1.0 - f) + F.element_at(entries, high + 1) * f


def curve_points(points: Sequence[tuple[float, float]]) -> list[tuple[float, float]]:
    """The points in order of x, with the ends (0, 0) and (1, 1) added; one within 0.001 of another takes its place."""
    out: list[tuple[float, float]] = []
    for p in [(0.0, 0.0), (1.0, 1.0), *points]:
        near = next((i for i, q in enumerate(out) if abs(q[0] - p[0]) < 1e-3), None)
        if near is None:
            out.append(p)
        else:
            out[near] = p
    return sorted(out)


def curve_table(points: Sequence[tuple[float, float]], size: int = LUT) -> np.ndarray:
    """Catmull-Rom through the points, level beyond the first and the last."""
    p = np.array(curve_points(points))
    x = np.linspace(0, 1, size)
    i = np.clip(np.searchsorted(p[:, 0], x, "right") - 1, 0, len(p) - 2)
    y = p[:, 1]
    p0, p1, p2, p3 = y[np.maximum(i - 1, 0)], y[i], y[i + 1], y[np.minimum(i + 2, len(p) - 1)]
    t = np.clip((x - p[i, 0]) / np.maximum(p[i + 1, 0] - p[i, 0], 1e-12), 0, 1)
    out = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t**2 + (3 * p1 - p0 - 3 * p2 + p3) * t**3)
    out = np.where(x < 1e-3, y[0], np.where(x > 1 - 1e-3, y[-1], out))
    return np.clip(out, 0, 1)


def curves(pixels: DataFrame, points: Sequence[tuple[float, float]], channel: str = "all") -> DataFrame:
    """channel: r, g, b, all, or luminance_approx, which curves green alone."""
    table = curve_table(points).tolist()
    chosen = {"all": RGB, "luminance_approx": ("g",)}.get(channel, (channel,))
    return pixels.withColumns({c: lookup(table, F.col(c)) for c in chosen})


def levels(pixels: DataFrame, black: float = 0.0, white: float = 1.0, gamma: float = 1.0, out_black: float = 0.0, out_white: float = 1.0, channels: Sequence[str] = RGB) -> DataFrame:
    """Channels that are not named become 0."""
    if not (black < white and out_black < out_white and 0.1 <= gamma <= 10):
        raise ValueError("levels need black < white on either side and a gamma of 0.1 to 10")
    f = lambda v: F.lit(out_black) + F.pow(clamp((v - black) / (white - black)), F.lit(1.0 / gamma)) * (out_white - out_black)
    return set_rgb(pixels, [f(F.col(c)) if c in channels else F.lit(0.0) for c in RGB])


def adjust(pixels: DataFrame, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0) -> DataFrame:
    rgb = [clamp((F.col(c) - 0.5) * (1.0 + contrast) + 0.5 + brightness) for c in RGB]
    toned = set_rgb(pixels, rgb)
    k = 1 + 2 * saturation if saturation >= 0 else 1 + saturation
    grey = luma(columns(*RGB))
    clear = F.col("a") <= 1e-6
    return set_rgb(toned, [F.when(clear, 0.0).otherwise(clamp(grey + (F.col(c) - grey) * k)) for c in RGB])


def noise(pixels: DataFrame, amount: float, cell: int = 4) -> DataFrame:
    """The same value for all channels of a cell of the grid, which is shifted by the halo."""
    n = (hash01(ediv(F.col("gx") + 2, cell), ediv(F.col("gy") + 2, cell)) * 2.0 - 1.0) * amount
    return set_rgb(pixels, [clamp(F.col(c) + n) for c in RGB])


def crt(pixels: DataFrame, period: int = 2, strength: float = 0.5, mask: float = 0.25) -> DataFrame:
    """Every period's first rows darker; of three columns in turn one channel stays full."""
    if not 2 <= period <= 8:
        raise ValueError("the period is 2 to 8")
    dark = F.when(emod(F.col("gy"), period) < max(period // 2, 1), 1.0 - strength).otherwise(1.0)
    return set_rgb(pixels, [clamp(F.col(c) * dark * F.when(emod(F.col("gx"), 3) != i, 1.0 - mask).otherwise(1.0)) for i, c in enumerate(RGB)])


def premultiplied(pixels: DataFrame) -> DataFrame:
    return set_rgb(pixels, [F.col(c) * F.col("a") for c in RGB])


def unpremultiplied(pixels: DataFrame) -> DataFrame:
    return set_rgb(pixels, [F.when(F.col("a") <= 1e-6, 0.0).otherwise(clamp(F.col(c) / F.col("a"))) for c in RGB])


def with_blend(pixels: DataFrame, operator, mode: str = "normal", opacity: float = 1.0) -> DataFrame:
    """operator's result laid over its input; of pixels with is_core only those are blended, others keep their input."""
    if opacity >= 1 and mode == "normal":
        return operator(pixels)
    kept = operator(pixels.withColumns({f"pre_{c}": F.col(c) for c in "rgba"}))
    out = over(columns(*"rgba"), columns(*(f"pre_{c}" for c in "rgba")), mode, opacity)
    if "is_core" in pixels.columns:
        out = [F.when(F.col("is_core"), x).otherwise(F.col(f"pre_{c}")) for x, c in zip(out, "rgba", strict=True)]
    return kept.select(*[c for c in kept.columns if c not in "rgba" and not c.startswith("pre_")], *(x.alias(c) for x, c in zip(out, "rgba", strict=True)))
