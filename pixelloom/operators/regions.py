"""Regions of one colour and their outlines.

A region is a set of pixels of one colour joined side to side. Each tile labels its own pixels and follows its own stretch
of every outline; what crosses tiles is settled by joins over pixels and stretches at tile borders alone: labels by star
contraction, stretches of an outline by pointer doubling.

Outlines run along the sides of pixels, the region on the right-hand side (y points down): outer ones clockwise, those of
holes against it, so that filling by the even-odd rule gives the region back. Where a region touches itself at a corner
its outline turns towards its own pixel and does not cross.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.plans.store import Stages

#: Sides of a pixel in the order of their ids: top, right, bottom, left; where each begins, and which way it goes.
FROM = np.array([(0, 0), (1, 0), (1, 1), (0, 1)])
WAY = np.array([(1, 0), (0, 1), (-1, 0), (0, -1)])
_PARTS = "kind int, image long, a long, b long, region long, colour long, area long, first int, last int, sides long, points binary"


def pixel_id(gx, gy):
    """A number that orders pixels by row, then column; sides of pixels are numbered four times as high."""
    return gy * (1 << 28) + gx


def least_label(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n places that each reaches over the pairs (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _ranked(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, steps from it) of each place in chains given by the place before, -1 for a head; a ring starts at its smallest."""
    n = len(before)
    at = np.arange(n)
    low, jump = at.copy(), np.where(before < 0, at, before)
    for _ in range(max(1, int(n).bit_length())):
        low, jump = np.minimum(low, low[jump]), jump[jump]
    ring = before[jump] >= 0  # a chain has come to its head by now
    jump = np.where((before < 0) | (ring & (low == at)), at, before)
    steps = (jump != at).astype(np.int64)
    for _ in range(max(1, int(n).bit_length())):
        steps, jump = steps + steps[jump], jump[jump]
    return jump, steps


def trace_tile(colour: np.ndarray, x0: int, y0: int) -> pd.DataFrame:
    """Labels and outlines of a tile. colour is (h + 2) x (w + 2) with one pixel around, negative where there is none.

    kind 0: a and b are pixels of one region, at or over a border, or a pixel and its region's first in the tile. kind 1:
    a stretch of an outline from side a up to before side b (null where it closes), of the region with first pixel region.
    """
    h, w = colour.shape[0] - 2, colour.shape[1] - 2
    inner = colour[1:-1, 1:-1]
    full = np.full(colour.shape, -1, np.int64)
    full[1:-1, 1:-1] = np.arange(h * w).reshape(h, w)
    ys, xs = np.divmod(np.arange(h * w), w)
    ids = pixel_id(xs + x0, ys + y0)
    here = inner.ravel()
    live = here >= 0

    right, down = live & (colour[1:-1, 2:].ravel() == here), live & (colour[2:, 1:-1].ravel() == here)
    pairs = [(np.flatnonzero(right & (xs < w - 1)), 1), (np.flatnonzero(down & (ys < h - 1)), w)]
    label = least_label(h * w, np.concatenate([p for p, _ in pairs]), np.concatenate([p + s for p, s in pairs]))
    region = ids[label]
    over = [(right & (xs == w - 1), 1, 0), (down & (ys == h - 1), 0, 1)]
    edge = live & ((xs == 0) | (ys == 0) | (xs == w - 1) | (ys == h - 1))
    links = [(ids[m], pixel_id(xs[m] + x0 + dx, ys[m] + y0 + dy)) for m, dx, dy in over] + [(ids[edge], region[edge])]
    a, b = (np.concatenate(v) for v in zip(*links, strict=True))
    keep = a != b
    link_rows = pd.DataFrame({"kind": 0, "a": a[keep], "b": b[keep]})

    # the side that follows each side of an outline, by the colours ahead of it
    side_of, follower, crosses = [], [], []
    for s in range(4):
        wx, wy = WAY[s]
        lx, ly = WAY[s - 1]  # to the left of the way
        y, x = ys + 1, xs + 1
        out = live & (colour[y + ly, x + lx] != here)
        p = np.flatnonzero(out)
        y, x, c = y[p], x[p], here[p]
        ahead = colour[y + wy, x + wx] == c
        across = ahead & (colour[y + wy + ly, x + wx + lx] == c)
        nx, ny = x + np.where(ahead, wx, 0) + np.where(across, lx, 0), y + np.where(ahead, wy, 0) + np.where(across, ly, 0)
        ns = np.where(across, s - 1, np.where(ahead, s, s + 1)) % 4
        local = full[ny, nx]
        side_of.append(4 * p + s)
        follower.append(np.where(local >= 0, 4 * local + ns, -1))
        crosses.append(4 * pixel_id(nx - 1 + x0, ny - 1 + y0) + ns)
    side, after, beyond = np.concatenate(side_of), np.concatenate(follower), np.concatenate(crosses)
    if not len(side):
        return link_rows.reindex(columns=["kind", "a", "b", "region", "colour", "area", "first", "last", "sides", "points"])
    order = np.argsort(side)
    side, after, beyond = side[order], after[order], beyond[order]
    place = np.searchsorted(side, after)
    before = np.full(len(side), -1)
    inside = np.flatnonzero(after >= 0)
    before[place[inside]] = inside
    head, steps = _ranked(before)
    order = np.lexsort((steps, head))
    side, after, beyond, head, before = side[order], after[order], beyond[order], head[order], before[order]
    way = side % 4
    side_ids = 4 * ids[side // 4] + way
    whole = np.flatnonzero(np.concatenate(([True], head[1:] != head[:-1])))
    # an open stretch is cut before its smallest side, so that an outline can begin at that
    low = np.lexsort((side_ids, head))[whole]
    starts = np.union1d(whole, low[after[np.append(whole[1:], len(side)) - 1] < 0])
    ends = np.append(starts[1:], len(side)) - 1
    px, py = xs[side // 4] + x0 + FROM[way, 0], ys[side // 4] + y0 + FROM[way, 1]
    area = px * (py + WAY[way, 1]) - (px + WAY[way, 0]) * py
    previous = np.concatenate(([0], way[:-1]))
    closed = after[ends] == side[starts]
    onward = np.where(after[ends] >= 0, np.append(side_ids[starts[1:]], 0), beyond[ends])
    previous[starts] = np.where(closed, way[ends], -1)  # an open stretch keeps its first point
    corner = way != previous
    at = np.concatenate(([0], np.cumsum(corner)))
    points = np.stack([px[corner], py[corner]], 1).astype("<i4")
    return pd.concat([link_rows, pd.DataFrame({
        "kind": 1, "a": side_ids[starts], "b": pd.array(onward, dtype="Int64"), "region": region[side[starts] // 4], "colour": here[side[starts] // 4],
        "area": np.add.reduceat(area, starts), "first": way[starts], "last": way[ends], "sides": ends - starts + 1, "points": [points[i:j].tobytes() for i, j in zip(at[starts], at[ends + 1], strict=True)],
    }).assign(b=lambda t: t["b"].mask(closed))])


def connected(edges: DataFrame, stages: Stages, key: str = "image") -> DataFrame:
    """(key, node, root) of all nodes of edges (key, a, b): the smallest node that each reaches, by star contraction."""
    both = lambda t: t.select(key, "a", "b").unionByName(t.select(key, F.col("b").alias("a"), F.col("a").alias("b")))
    now = stages.put(edges.select(key, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before, state = None, lambda t: tuple(t.agg(F.count("*"), F.sum(F.xxhash64(key, "a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
    while (after := state(now)) != before:
        before = after
        low = both(now).groupBy(key, "a").agg(F.min("b").alias("m")).select(key, "a", F.least("a", "m").alias("m"))
        large = both(now).join(low, [key, "a"]).where("b > a").select(key, F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy(key, "a").agg(F.min("b").alias("m"))
        small = large.join(down, [key, "a"]).select(key, F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        now = stages.put(small.unionByName(down.select(key, "a", F.col("m").alias("b"))).distinct(), "stars")
    roots = now.select(key, F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(key, F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _rings(stretches: DataFrame, stages: Stages) -> DataFrame:
    """(image, a, loop, part) of stretches (image, a, b) that form rings: the ring's smallest side, and the place from there."""
    on = lambda t, names: t.select("image", F.col("a").alias("b"), *(F.col(c).alias(f"{c}2") for c in names))
    now = stages.put(stretches.select("image", "a", "b", F.col("a").alias("low")), "rings")
    before, state = None, lambda t: tuple(t.agg(F.count("*"), F.sum("low")).first())
    while (after := state(now)) != before:
        before = after
        step = now.join(on(now.withColumn("next", F.col("b")), ["next", "low"]), ["image", "b"])
        now = stages.put(step.select("image", "a", F.col("next2").alias("b"), F.least("low", "low2").alias("low")), "rings")
    rings = stretches.select("image", "a", "b").join(now.select("image", "a", F.col("low").alias("loop")), ["image", "a"])
    now = stages.put(rings.select("image", "a", "loop", F.when(F.col("b") != F.col("loop"), F.col("b")).alias("b"), F.when(F.col("b") != F.col("loop"), 1).otherwise(0).cast("long").alias("left")), "ranks")
    while now.where("b IS NOT NULL").limit(1).count():
        step = now.join(on(now.withColumn("next", F.col("b")), ["next", "left"]), ["image", "b"], "left")
        now = stages.put(step.select("image", "a", "loop", F.col("next2").alias("b"), (F.col("left") + F.coalesce("left2", F.lit(0))).alias("left")), "ranks")
    total = now.where("a = loop").select("image", "loop", F.col("left").alias("all"))
    return now.join(total, ["image", "loop"]).select("image", "a", "loop", (F.col("all") - F.col("left")).alias("part"))


def outlines(pixels: DataFrame, tile: int = 256) -> DataFrame:
    """(image, region, colour, loop, hole, part, area, sides, points) of pixels (image, gx, gy, r, g, b, a), channels 0 to 255.

    A row is a stretch of an outline: of region (its first pixel's id), outline loop (its first side's id), in the order of
    part from 0; points holds its corners, area is of the whole outline, twice and signed. Pixels with a = 0, with a null,
    or outside of the image belong to no region; no outline meets in one task: the rows of one are as many as the tiles
    that it runs through, each with the corners of that tile. gx and gy are below 2^26.
    """
    stages = Stages(pixels.sparkSession)
    owners = lambda g: F.sequence(F.greatest(F.floor((F.col(g) - 1) / tile), F.lit(0).cast("long")), F.floor((F.col(g) + 1) / tile))
    packed = F.shiftleft(F.col("r").cast("long"), 24) + F.shiftleft(F.col("g").cast("long"), 16) + F.shiftleft(F.col("b").cast("long"), 8) + F.col("a").cast("long")
    seen = pixels.where("a > 0").select(F.col("image").cast("long").alias("image"), F.col("gx").cast("long").alias("gx"), F.col("gy").cast("long").alias("gy"), packed.alias("colour")).where("colour IS NOT NULL")
    sent = seen.withColumn("tx", F.explode(owners("gx"))).withColumn("ty", F.explode(owners("gy")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(rows["tx"].iloc[0]) * tile, int(rows["ty"].iloc[0]) * tile
        colour = np.full((tile + 2, tile + 2), -1, np.int64)
        colour[rows["gy"] - y0 + 1, rows["gx"] - x0 + 1] = rows["colour"]
        found = trace_tile(colour, x0, y0)
        return found.assign(image=rows["image"].iloc[0])[[c.split()[0] for c in _PARTS.split(", ")]]

    parts = stages.put(sent.groupBy("image", "tx", "ty").applyInPandas(run, _PARTS), "parts")
    stretches = parts.where("kind = 1").drop("kind")
    joined = stretches.where("b IS NOT NULL")
    rings = _rings(joined.select("image", "a", "b"), stages)
    regions = connected(parts.where("kind = 0"), stages).select("image", F.col("node").alias("region"), "root")
    # the first point of a stretch is none of the outline's corners if the stretch before came the same way
    came = joined.select("image", F.col("b").alias("a"), F.col("last").alias("came"))
    rows = stretches.join(rings, ["image", "a"], "left").join(came, ["image", "a"], "left").join(regions, ["image", "region"], "left")
    loop = F.coalesce("loop", "a")
    straight = F.coalesce(F.col("came") == F.col("first"), F.lit(False))
    points = F.when(straight, F.expr("substring(points, 9)")).otherwise(F.col("points"))
    rows = rows.select("image", F.coalesce("root", "region").alias("region"), "colour", loop.alias("loop"), F.coalesce("part", F.lit(0)).alias("part"), F.col("area").alias("own"), "sides", points.alias("points"))
    areas = rows.groupBy("image", "loop").agg(F.sum("own").alias("area"))
    found = rows.join(areas, ["image", "loop"]).select("image", "region", "colour", "loop", (F.col("area") < 0).alias("hole"), "part", "area", "sides", "points")
    found = _unpacked(found)
    done = stages.keep(found, "outlines")
    stages.close()
    return done


def _unpacked(rows: DataFrame) -> DataFrame:
    names = ["image", "region", "colour", "loop", "hole", "part", "area", "sides"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for some in batches:
            yield some[names].assign(points=[np.frombuffer(p, "<i4").tolist() for p in some["points"]])

    kinds = dict(rows.dtypes)
    return rows.select(*names, "points").mapInPandas(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", points array<int>")


def svg_paths(found: DataFrame) -> DataFrame:
    """(image, region, fill, d) of outlines: a path a region, its outer outline first, then its holes by their first side.

    A path is one string, so that all corners of one region meet; outlines() itself keeps them apart.
    """
    corners = F.expr("transform(filter(sequence(0, greatest(size(points) - 1, 0)), i -> i % 2 = 0 AND i < size(points)), i -> concat(points[i], ' ', points[i + 1]))")
    stretch = found.select("image", "region", "colour", "loop", "hole", "part", F.array_join(corners, " L").alias("line")).where("line <> ''")
    line = F.concat(F.lit("M"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "line"))), lambda s: s["line"]), " L"), F.lit(" Z"))
    loops = stretch.groupBy("image", "region", "colour", "hole", "loop").agg(line.alias("line"))
    d = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hole", "loop", "line"))), lambda s: s["line"]), " ")
    fill = F.lower(F.concat(F.lit("#"), F.lpad(F.hex(F.shiftright("colour", 8)), 6, "0")))
    return loops.groupBy("image", "region", "colour").agg(d.alias("d")).select("image", "region", fill.alias("fill"), (F.col("colour").bitwiseAND(F.lit(255)) / 255.0).alias("opacity"), "d")
