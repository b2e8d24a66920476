"""Palettes out of pixels (median cut, k-means, ranges, samples), and out of colours (ramps, harmonies)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import distance2, gamut_clip, linear_to_oklab, oklab_to_linear, oklab_to_oklch, oklch_to_oklab
from pixelloom.operators.point import RGB, columns
from pixelloom.plans.running import running_sum


def distinct_colors(pixels: DataFrame) -> DataFrame:
    """The first pixel (by idx) of each colour in 8 bits."""
    keys = [F.floor(F.col(c) * 255.0 + 0.5).cast("int").alias(f"k{c}") for c in RGB]
    first = pixels.select(*keys, "idx", *RGB).groupBy("kr", "kg", "kb").agg(F.min_by(F.struct("idx", *RGB), "idx").alias("v"))
    return first.select("v.*")


def subsample(pixels: DataFrame, most: int, n: int) -> DataFrame:
    """Every k-th pixel by idx, k so that at most ``most`` of n stay; a sampling operator."""
    return pixels.where(F.col("idx") % max(1, math.ceil(n / most)) == 0)


def channel_ranges(pixels: DataFrame) -> DataFrame:
    """Least and most of each channel; one that hardly varies counts as 0 to 1."""
    found = pixels.agg(*(f(c).alias(f"{n}_{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))))
    flat = lambda c: F.col(f"hi_{c}") - F.col(f"lo_{c}") < 1e-6
    return found.select(*(F.when(flat(c), v).otherwise(F.col(f"{n}_{c}")).alias(f"{n}_{c}") for c in RGB for n, v in (("lo", 0.0), ("hi", 1.0))))


def weighted_cdf(pixels: DataFrame, chroma_weight: float, contrast_weight: float) -> DataFrame:
    """idx, weight and the running sum of weights by idx."""
    l, c, _ = oklab_to_oklch(linear_to_oklab(columns(*RGB)))
    marked = pixels.select("idx", l.alias("l"), c.alias("c"))
    facts = marked.agg(F.max("c").alias("mc"), F.avg("l").alias("ml"))
    spread = marked.crossJoin(F.broadcast(facts)).agg(F.max(F.abs(F.col("l") - F.col("ml"))).alias("md"))
    one = marked.crossJoin(F.broadcast(facts.crossJoin(spread)))
    w = F.lit(1.0) + F.when(F.col("mc") > 0, F.col("c") / F.col("mc") * chroma_weight).otherwise(0.0) + F.when(F.col("md") > 0, F.abs(F.col("l") - F.col("ml")) / F.col("md") * contrast_weight).otherwise(0.0)
    return running_sum(one.select("idx", w.alias("weight")), ["idx"], F.col("weight"), "cdf")


def _at_rank(rows: DataFrame, key: str, before: dict[int, int], rank: dict[int, int]) -> dict[int, tuple]:
    """{box: (the key at a rank of its rows, how many rows have smaller ones, how many have it)} of rows (box, key), all in one pass.

    before: how many rows smaller boxes hold. Counts run over ranges of (box, key), so that no task sees a whole box.
    """
    counts = running_sum(rows.groupBy("box", key).agg(F.count("*").alias("n")), ["box", key], F.col("n"), "upto")
    cut = F.element_at(F.create_map(*(F.lit(v).cast("long") for box in rank for v in (box, before[box] + rank[box]))), F.col("box"))
    found = counts.where(F.col("upto") > cut).groupBy("box").agg(F.min(F.struct(key, "upto", "n")).alias("v")).collect()
    return {r["box"]: (r["v"][key], r["v"]["upto"] - r["v"]["n"] - before[r["box"]], r["v"]["n"]) for r in found}


def median_cut(pixels: DataFrame, k: int) -> DataFrame:
    """Means of k bins: of all bins the one with the widest channel is split at the median, k - 1 times (idx orders ties).

    Where a bin is split depends on itself alone: its widest channel, the value in the middle, and the idx of the last row
    with that value that stays below. All bins that may be split next are measured and cut in one pass, and which of them
    are is settled over these facts, of which the driver sees a row a bin; rows are told apart by their values, so that the
    table is neither written again nor joined.
    """
    boxes: dict[int, dict] = {}  # facts of each, by number; children of box i are 2 i + 1 and 2 i + 2
    cuts: dict[int, tuple] = {}

    def numbered(open_boxes: set[int]) -> DataFrame:
        """idx, r, g, b and the box of each pixel by the cuts so far; rows walk down together, a step a level, in one Python
        step, which a UDF in a filter and a column would be twice."""
        known = {i: (RGB.index(axis), value, -(2**63) if last is None else last) for i, (axis, value, last) in cuts.items() if i not in open_boxes}

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                order, *rgb = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                box, moving = np.zeros(len(order), np.int64), np.arange(len(order))
                while len(moving):
                    stay = []
                    for i in np.unique(box[moving]):
                        at = moving[box[moving] == i]
                        if int(i) in known:
                            axis, value, last = known[int(i)]
                            v = rgb[axis][at]
                            box[at] = 2 * i + np.where((v < value) | ((v == value) & (order[at] <= last)), 1, 2)
                            stay.append(at)
                    moving = np.concatenate(stay) if stay else moving[:0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=["idx", *RGB, "box"])

        return pixels.select(F.col("idx").cast("long"), *(F.col(c).cast("double") for c in RGB)).mapInArrow(of, "idx long, r double, g double, b double, box long")

    def measure(fresh: set[int]) -> None:
        rows = numbered(fresh).where(F.col("box").isin(*fresh))
        facts = rows.groupBy("box").agg(F.count("*").alias("n"), *(F.max(c).alias(f"hi{c}") for c in RGB), *(F.min(c).alias(f"lo{c}") for c in RGB), *(F.avg(c).alias(f"mean{c}") for c in RGB)).collect()
        for r in facts:
            width = {c: r[f"hi{c}"] - r[f"lo{c}"] for c in RGB}
            axis = max(RGB, key=lambda c: (width[c], -RGB.index(c)))
            boxes[r["box"]] = {"n": r["n"], "width": width[axis], "axis": axis, "mean": [r[f"mean{c}"] for c in RGB]}
        wide = sorted(i for i in fresh if i in boxes and boxes[i]["n"] > 1)
        if not wide or k == 1:
            return
        axis = F.element_at(F.create_map(*(v for i in wide for v in (F.lit(i).cast("long"), F.lit(boxes[i]["axis"])))), F.col("box"))
        value = F.when(axis == "r", F.col("r")).when(axis == "g", F.col("g")).otherwise(F.col("b"))
        some = rows.where(F.col("box").isin(*wide)).select("box", value.alias("v"), "idx")
        before, total = {}, 0
        for i in wide:
            before[i], total = total, total + boxes[i]["n"]
        middle = _at_rank(some, "v", before, {i: boxes[i]["n"] // 2 for i in wide})
        tied = {i: boxes[i]["n"] // 2 - below for i, (_, below, _) in middle.items()}
        for i, (v, _, _) in middle.items():
            cuts[i] = (boxes[i]["axis"], v, None)
        split = [i for i in wide if tied[i] > 0]
        if split:
            at = F.element_at(F.create_map(*(v for i in split for v in (F.lit(i).cast("long"), F.lit(float(middle[i][0]))))), F.col("box"))
            ties = some.where(F.col("box").isin(*split) & (F.col("v") == at)).select("box", "idx")
            before, total = {}, 0
            for i in split:
                before[i], total = total, total + middle[i][2]
            for i, (last, _, _) in _at_rank(ties, "idx", before, {i: tied[i] - 1 for i in split}).items():
                cuts[i] = (*cuts[i][:2], last)

    measure({0})
    if not boxes:
        return pixels.select(F.lit(0).alias("i"), *RGB)
    while True:
        order = [0]
        while len(order) < k:
            wide = [(boxes[b]["width"], i, b) for i, b in enumerate(order) if boxes[b]["n"] > 1]
            if not wide:
                break
            b = max(wide)[2]
            if 2 * b + 1 not in boxes:
                break
            order = [x for x in order if x != b] + [2 * b + 1, 2 * b + 2]
        open_ = [b for b in order if boxes[b]["n"] > 1 and len(order) < k and 2 * b + 1 not in boxes]
        if not open_:
            break
        # with these, the widest that are not cut yet, as one of them may be next
        others = sorted((b for b in boxes if boxes[b]["n"] > 1 and 2 * b + 1 not in boxes and b not in open_), key=lambda b: -boxes[b]["width"])
        missing = {c for b in open_ + others[: max(0, k - len(open_))] for c in (2 * b + 1, 2 * b + 2)}
        measure(missing)
    rows = [(i, *map(float, boxes[b]["mean"])) for i, b in enumerate(order)]
    return pixels.sparkSession.createDataFrame(rows, "i int, r double, g double, b double")


def assign(pixels: DataFrame, centres: Sequence[Sequence[float]]) -> DataFrame:
    """pixels with the index of the nearest centre (the first of equals) and the squared distance."""
    spots = F.array(*(F.struct(*(F.lit(float(v)).alias(n) for v, n in zip(c, "xyz", strict=True)), F.lit(i).alias("i")) for i, c in enumerate(centres)))
    best = F.array_min(F.transform(spots, lambda s: F.struct(distance2(columns(*RGB), [s["x"], s["y"], s["z"]]).alias("d"), s["i"].alias("i"))))
    return pixels.withColumn("__b", best).select(*pixels.columns, F.col("__b.i").alias("centre"), F.col("__b.d").alias("d"))


def k_means(pixels: DataFrame, k: int, rounds: int = 50, tolerance: float = 1e-4) -> list[tuple[float, ...]]:
    """Centres: the first pixel, then whichever is farthest from all so far (the last of equals); then means, at most rounds times."""
    first = pixels.orderBy("idx").select(*RGB).first()
    if first is None:
        return []
    centres = [tuple(first)]
    while len(centres) < k:
        far = assign(pixels, centres).agg(F.max_by(F.struct(*RGB), F.struct("d", "idx")).alias("v")).first()["v"]
        centres.append(tuple(far))
    for _ in range(rounds):
        means = {r["centre"]: r for r in assign(pixels, centres).groupBy("centre").agg(*(F.avg(c).alias(c) for c in RGB)).collect()}
        moved = [tuple(means[i][c] for c in RGB) if i in means else old for i, old in enumerate(centres)]
        step = max(math.dist(a, b) for a, b in zip(centres, moved, strict=True))
        centres = moved
        if step < tolerance:
            break
    return centres


def _clipped(rows: DataFrame) -> DataFrame:
    """rows with r, g, b in place of __l, __a, __b, chroma cut to what the gamut holds."""
    clipped = rows.withColumns(dict(zip(("__l", "__a", "__b"), gamut_clip(columns("__l", "__a", "__b")), strict=True)))
    return clipped.withColumns(dict(zip(RGB, oklab_to_linear(columns("__l", "__a", "__b")), strict=True))).drop("__l", "__a", "__b")


def ramp(colors: DataFrame, end: Sequence[Column], n: int) -> DataFrame:
    """colors with i from 0 and r, g, b: n colours from each row's r, g, b to end, in even steps of Oklab, kept in gamut."""
    if not 1 <= n <= 64:
        raise ValueError("a ramp has 1 to 64 colours")
    ends = colors.withColumn("__from", F.array(*linear_to_oklab(columns(*RGB)))).withColumn("__to", F.array(*linear_to_oklab(end)))
    rows = ends.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    t = F.col("i") / float(max(n - 1, 1))
    lab = {f"__{x}": F.col("__from")[k] * (1.0 - t) + F.col("__to")[k] * t for k, x in enumerate("lab")}
    return _clipped(rows.withColumns(lab).drop("__from", "__to"))


HARMONIES = ("monochromatic", "analogous", "complementary", "triadic", "split")
SPREAD, SPLIT = math.pi / 6, 0.5  # radians on either side: of the base, of the opposite


def harmony(colors: DataFrame, rule: str, count: int, spread: float = SPREAD) -> DataFrame:
    """colors with i from 0 and r, g, b: colours that go with each row's r, g, b.

    Monochromatic spreads lightness from 0.15 to 0.9, analogous spreads the hue evenly around the base's; the others give
    the hues of their rule, each at least once, and again from the first where more are asked for.
    """
    if not 1 <= count <= 32:
        raise ValueError("a harmony has 1 to 32 colours")
    turns = {"complementary": (0.0, math.pi), "triadic": (0.0, 2 * math.pi / 3, 4 * math.pi / 3), "split": (0.0, math.pi - SPLIT, math.pi + SPLIT)}
    n = max(count, len(turns.get(rule, (0.0,))))
    even = [0.5 if n == 1 else k / (n - 1) for k in range(n)]
    places = {"monochromatic": [(0.15 + 0.75 * t, 0.0) for t in even], "analogous": [(None, spread * (2 * t - 1)) for t in even]}
    places |= {name: [(None, hues[k % len(hues)]) for k in range(n)] for name, hues in turns.items()}
    steps = F.array(*(F.struct(F.lit(k).alias("i"), F.lit(l).cast("double").alias("l"), F.lit(h).alias("h")) for k, (l, h) in enumerate(places[rule])))
    base = colors.withColumn("__base", F.array(*oklab_to_oklch(linear_to_oklab(columns(*RGB))))).withColumn("__s", F.explode(steps))
    lab = oklch_to_oklab([F.coalesce(F.col("__s.l"), F.col("__base")[0]), F.col("__base")[1], F.col("__base")[2] + F.col("__s.h")])
    rows = base.withColumns({"i": F.col("__s.i"), **{f"__{x}": v for v, x in zip(lab, "lab", strict=True)}})
    return _clipped(rows.drop("__base", "__s"))
