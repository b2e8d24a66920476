"""Registered queries of outlines, meshes, palette search and what is kept between edits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators.diffuse import KERNELS
from pixelloom.operators.ordered import channel_ranges, guided_levels
from pixelloom.plans import raster_queries as R
from pixelloom.plans import raster_sql as S
from pixelloom.sources.rasters import PALETTE5, event_raster, vector_raster
from pixelloom.streaming import versions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# A pixel's number is gy * 2^28 + gx, that of its side (top, right, bottom, left) four times that and 0 to 3.
_OUTLINES = f"""
WITH RECURSIVE {S.E},
c AS (SELECT gy * 268435456::BIGINT + gx AS id, gx, gy, CASE WHEN r >= 0.5 THEN 1 ELSE 0 END AS c FROM p WHERE a > 0),
n AS (SELECT x.id AS a, y.id AS b FROM c x JOIN c y ON y.id = x.id + 1 AND y.c = x.c UNION ALL SELECT x.id, y.id FROM c x JOIN c y ON y.id = x.id + 268435456 AND y.c = x.c),
nb AS (SELECT a, b FROM n UNION ALL SELECT b, a FROM n),
lab(id, root) USING KEY (id) AS (SELECT id, id FROM c UNION SELECT nb.b, min(lab.root) FROM lab JOIN nb ON nb.a = lab.id JOIN recurring.lab AS o ON o.id = nb.b WHERE lab.root < o.root GROUP BY nb.b),
w(s, wx, wy, fx, fy) AS (VALUES (0, 1, 0, 0, 0), (1, 0, 1, 1, 0), (2, -1, 0, 1, 1), (3, 0, -1, 0, 1)),
t AS (SELECT c.*, s, wx, wy, wy AS lx, -wx AS ly, gx + fx AS px, gy + fy AS py FROM c, w),
o AS (SELECT t.* FROM t LEFT JOIN c l ON l.id = t.id + lx + 268435456 * ly AND l.c = t.c WHERE l.id IS NULL),
e AS (SELECT o.*, 4 * o.id + s AS e, 4 * (CASE WHEN b.id IS NOT NULL THEN b.id WHEN a.id IS NOT NULL THEN a.id ELSE o.id END) + (CASE WHEN b.id IS NOT NULL THEN s + 3 WHEN a.id IS NOT NULL THEN s ELSE s + 1 END) % 4 AS nx
      FROM o LEFT JOIN c a ON a.id = o.id + wx + 268435456 * wy AND a.c = o.c LEFT JOIN c b ON b.id = a.id + lx + 268435456 * ly AND b.c = o.c),
m(e, low) USING KEY (e) AS (SELECT e, e FROM e UNION SELECT e.nx, m.low FROM m JOIN e ON e.e = m.e JOIN recurring.m AS q ON q.e = e.nx WHERE m.low < q.low),
k AS (SELECT m.low AS loop, e.*, e.s <> f.s AS corner FROM e JOIN m ON m.e = e.e JOIN e f ON f.nx = e.e)
SELECT lab.root AS region, k.c AS colour, loop, sum(px * (py + wy) - (px + wx) * py) < 0 AS hole, sum(px * (py + wy) - (px + wx) * py)::BIGINT AS area, count(*)::BIGINT AS sides, count(*) FILTER (WHERE corner)::BIGINT AS corners
FROM k JOIN lab ON lab.id = k.id GROUP BY ALL
"""


def two_tones(pixels: DataFrame) -> DataFrame:
    """Pixels in bytes, light or dark by their red, without those that are transparent."""
    v = F.when(F.col("r") >= 0.5, 255).otherwise(0)
    return pixels.select(F.lit(0).alias("image"), "gx", "gy", *(v.alias(c) for c in "rgb"), F.when(F.col("a") > 0, 255).otherwise(0).alias("a"))


@query("snk4_svg_contour", _OUTLINES)
def _contour(spark, d):
    from pixelloom.operators.regions import outlines

    found = outlines(two_tones(event_raster(spark, d)), tile=64)
    light = F.when(F.col("colour") == 255, 0).otherwise(1)
    of = found.groupBy("region", light.alias("colour"), "loop", "hole", "area")
    return of.agg(F.sum("sides").alias("sides"), F.sum(F.size("points") / 2).cast("long").alias("corners"))


# --- palettes by table --------------------------------------------------------------------------------------------------

#: 256 colours: a cube of six levels a channel, and forty greys.
PALETTE256 = [(r / 5, g / 5, b / 5) for r in range(6) for g in range(6) for b in range(6)] + [(v / 41, v / 41, v / 41) for v in range(1, 41)]


@query("ed10_large_palette", R._lut_sql(S.V, PALETTE256))
def _large_palette(spark, d):
    from pixelloom.operators.ordered import lut_nearest

    return R.out(lut_nearest(vector_raster(spark, d), PALETTE256))


# --- error diffusion ----------------------------------------------------------------------------------------------------


def _first_least(distances: list[str]) -> str:
    """The place, from 1, of the first of the least."""
    return f"list_position([{', '.join(distances)}], least({', '.join(distances)}))"


def _between(v, points) -> list[str]:
    return [" + ".join(f"({x} - {S.n(y)}) * ({x} - {S.n(y)})" for x, y in zip(v, p, strict=True)) for p in points]


def _of_palette(place: str, palette) -> list[str]:
    return [f"[{', '.join(S.n(c[k]) for c in palette)}][{place}]" for k in range(3)]


# A pick is a list of layers over the values vr, vg, vb, each a {name: SQL} that may use the names before, and gives qr, qg,
# qb and, where the error is counted in other units, owr, owg, owb.
_Q, _V = ("qr", "qg", "qb"), ("vr", "vg", "vb")


def _uniform(levels: int) -> list[dict]:
    n = S.n(levels - 1)
    return [{q: f"least(greatest(floor({v} * {n} + {S.n(0.5)}), 0), {n}) / {n}" for q, v in zip(_Q, _V, strict=True)}]


def _nearest_of(at, points, result: dict) -> list[dict]:
    return [{f"d{i}": x for i, x in enumerate(_between(at, points))}, {"place": _first_least([f"d{i}" for i in range(len(points))])}, {n: x for names, palette in result.items() for n, x in zip(names, _of_palette("place", palette), strict=True)}]


def _lab(of) -> list[dict]:
    return [dict(zip(("ox", "oy", "oz"), S.oklab(*of), strict=True))]


def _strict() -> list[dict]:
    snap = {s: f"{S.n(low)} + (least(floor({S.clamp(f'({x} - {S.n(low)}) / {S.n(high - low)}', 0.0, 1 - 1.1920929e-07)} * 64), 63) + {S.n(0.5)}) / 64 * {S.n(high - low)}" for s, x, low, high in zip(("sx", "sy", "sz"), ("ox", "oy", "oz"), (0.0, -0.4, -0.4), (1.0, 0.4, 0.4), strict=True)}
    return [*_lab(_V), snap, *_nearest_of(("sx", "sy", "sz"), [C.oklab_of(c) for c in PALETTE5], {_Q: PALETTE5})]


def _guided(names=_Q) -> list[dict]:
    n = guided_levels(PALETTE5) - 1
    ranges = channel_ranges(PALETTE5)
    at = {f"at_{q}": f"{S.clamp(f'({v} - {S.n(low)}) / {S.n(high - low)}')} * {S.n(n)}" for q, v, (low, high) in zip(names, _V, ranges, strict=True)}
    return [at, {q: f"{S.n(low)} + least(floor(at_{q}) + (CASE WHEN at_{q} - floor(at_{q}) > {S.n(0.5)} THEN 1 ELSE 0 END), {S.n(n)}) / {S.n(n)} * {S.n(high - low)}" for q, (low, high) in zip(names, ranges, strict=True)}]


def _mixed() -> list[dict]:
    return [*_guided(("gr", "gg", "gb")), *_lab(("gr", "gg", "gb")), *_nearest_of(("ox", "oy", "oz"), [C.oklab_of(c) for c in PALETTE5], {_Q: PALETTE5})]


def _simple() -> list[dict]:
    bytes_ = [[float(C.byte_of(x)) for x in c] for c in PALETTE5]
    return _nearest_of(_V, bytes_, {_Q: PALETTE5, ("owr", "owg", "owb"): bytes_})


def diffusion_sql(raster: str, pick: list[dict], kernel: str = "floyd_steinberg", image: str = "0", tile: int = 64, gray: bool = False, src=("r", "g", "b"), limits=((0.0, 1.0),) * 3, source: str = "p", result: str = "", serpentine: bool = False) -> str:
    """Error diffusion by recursion over steps k, each of which needs a bounded number of those before it.

    A step is a line of equal gx + 3 gy; with serpentine, a pixel of each tile of a row, a tile a row's length after its
    left neighbour. Sums go by tile first (left, above, across the corner, its own), then in the order in which pixels are
    worked on, so that they round alike; what spills to the left out of a tile is dropped. Tiles are worked on whole, black
    where there is no pixel.
    """
    total, taps = KERNELS[kernel]
    taps = sorted(taps, key=lambda t: (-t[1], -t[0]) if serpentine else (-t[0] - 3 * t[1], t[1]))
    value = [S.luma()] * 3 if gray else list(src)
    k, keep = "gx + 3 * gy", "k > cur - 8"
    if serpentine:
        k = f"gy * {tile} + (CASE WHEN gy % 2 = 0 THEN gx % {tile} ELSE {tile - 1} - gx % {tile} END) + gx // {tile} * {tile}"
        keep = f"(k > cur - {2 * tile + 3} OR k > cur - {4 * tile} AND gx % {tile} >= {tile - 2})"
    turn = lambda dy: f" * (CASE WHEN (p.gy - {dy}) % 2 = 0 THEN 1 ELSE -1 END)" if serpentine else ""
    joins = " ".join(f"LEFT JOIN e AS s{i} ON s{i}.gx = p.gx - ({dx}){turn(dy)} AND s{i}.gy = p.gy - {dy} AND s{i}.image = p.image" for i, (dx, dy, _) in enumerate(taps))

    def spilled(c: str) -> str:
        part = lambda i, w, x, y: f"(CASE WHEN s{i}.tx = p.tx - {x} AND s{i}.ty = p.ty - {y} THEN s{i}.d{c} * {S.n(w / total)} ELSE 0{R.D} END)"
        around = [" + ".join(part(i, w, x, y) for i, (_, _, w) in enumerate(taps)) for x, y in ((1, 0), (0, 1), (1, 1))]
        found = f"((({around[0]}) + ({around[1]})) + ({around[2]}))"
        for i, (_, _, w) in enumerate(taps):
            found = f"({found} + {part(i, w, 0, 0)})"
        return found

    rows = f"(SELECT p.*, {', '.join(f'{S.clamp(f"p.s{c} + {spilled(c)}", *limit)} AS v{c}' for c, limit in zip('rgb', limits, strict=True))} FROM (SELECT * FROM z WHERE k = (SELECT max(cur) + 1 FROM e)) p {joins})"
    for layer in pick:
        rows = f"(SELECT *, {', '.join(f'{x} AS {name}' for name, x in layer.items())} FROM {rows})"
    own = ("owr", "owg", "owb") if "owr" in pick[-1] else _Q
    passed = [S.luma(*own)] * 3 if gray else own
    columns = "gx, gy, image, tx, ty, k, qr, qg, qb"
    return f"""WITH RECURSIVE {raster.removeprefix('WITH ')},
grid AS (SELECT x::INT AS gx, y::INT AS gy FROM (SELECT unnest(range((max(gx) // {tile} + 1) * {tile})) AS x FROM {source}), (SELECT unnest(range(max(gy) + 1)) AS y FROM {source})),
z AS MATERIALIZED (SELECT gx, gy, a, {image} AS image, gx // {tile} AS tx, gy // {tile} AS ty, {k} AS k, {', '.join(f'coalesce({x}, 0) AS s{c}' for x, c in zip(value, 'rgb', strict=True))} FROM grid LEFT JOIN {source} USING (gx, gy)),
e(cur, fresh, {columns}, dr, dg, db) AS (
  SELECT min(k) - 1, false, -9, -9, -9, -9, -9, min(k) - 1, 0{R.D}, 0{R.D}, 0{R.D}, 0{R.D}, 0{R.D}, 0{R.D} FROM z
  UNION ALL (SELECT k, true, {columns}, {', '.join(f'v{c} - {x}' for c, x in zip('rgb', passed, strict=True))} FROM {rows}
  UNION ALL SELECT cur + 1, false, {columns}, dr, dg, db FROM e WHERE {keep}))
""" + (result or f"SELECT gx, gy, {_DITHERED} FROM e JOIN z USING (gx, gy) WHERE fresh AND a IS NOT NULL")


_DITHERED = ", ".join(f"round(CASE WHEN z.a > 0.5 THEN q{c} ELSE 0{R.D} END, 6) AS {c}" for c in "rgb") + f", CASE WHEN z.a > 0.5 THEN 1{R.D} ELSE 0{R.D} END AS a"
_BANDS = "gy // 64"
_BYTES = [f"({S.to_srgb(c)}){R.D}" for c in "rgb"]
SQL["ed2_error_diffusion"] = diffusion_sql(S.E, _uniform(4))
SQL["ed7_strict_diffusion"] = diffusion_sql(S.V, _strict(), image=_BANDS)
SQL["ed7_guided_diffusion"] = diffusion_sql(S.V, _guided(), image=_BANDS)
SQL["ed7_mixed_diffusion"] = diffusion_sql(S.V, _mixed(), image=_BANDS)
SQL["ed7_simple_diffusion"] = diffusion_sql(S.V, _simple(), image=_BANDS, src=_BYTES, limits=((0.0, 255.0),) * 3)
SQL["ed8_grayscale_diffusion"] = diffusion_sql(S.E, _uniform(3), kernel="sierra", image=_BANDS, gray=True)
SQL["ed3_serpentine"] = diffusion_sql(S.E, _uniform(4), kernel="stucki", image=_BANDS, serpentine=True)
# A block takes the result of its first pixel; blocks are the pixels of the recursion.
SQL["ed9_mega_pixels"] = diffusion_sql(
    f"{S.E}, b AS (SELECT (gx // 4)::INT AS gx, (gy // 4)::INT AS gy, arg_min(r, gy * 1000 + gx) AS r, arg_min(g, gy * 1000 + gx) AS g, arg_min(b, gy * 1000 + gx) AS b, arg_min(a, gy * 1000 + gx) AS a FROM p GROUP BY 1, 2)",
    _uniform(4), image="gy // 16", source="b", result=f"SELECT p.gx, p.gy, {_DITHERED} FROM p JOIN e ON e.gx = p.gx // 4 AND e.gy = p.gy // 4 AND fresh JOIN z ON z.gx = e.gx AND z.gy = e.gy",
)
# Tiles with their halo side by side, each an image of its own.
_HALO = f"""{S.V}, t AS (SELECT (x.tx * 68 + p.gx - x.tx * 64 + 2)::INT AS gx, (p.gy // 64 * 68 + p.gy % 64 + 2)::INT AS gy, r, g, b, a
  FROM p, (SELECT unnest(range((SELECT max(gx) // 64 + 1 FROM p))) AS tx) x WHERE p.gx BETWEEN x.tx * 64 - 2 AND x.tx * 64 + 65)"""
_SNAP = {s: f"{S.n(low)} + (least(floor({S.clamp(f'({v} - {S.n(low)}) / {S.n(high - low)}', 0.0, 1 - 1.1920929e-07)} * 64), 63) + {S.n(0.5)}) / 64 * {S.n(high - low)}" for s, v, low, high in zip(("sx", "sy", "sz"), _V, (0.0, -0.4, -0.4), (1.0, 0.4, 0.4), strict=True)}
_LAB5 = [C.oklab_of(c) for c in PALETTE5]
SQL["ed11_palette_diffusion"] = diffusion_sql(
    _HALO, [_SNAP, *_nearest_of(("sx", "sy", "sz"), _LAB5, {_Q: PALETTE5, ("owr", "owg", "owb"): _LAB5})], kernel="atkinson", image="gy // 68 * 1000 + gx // 68", tile=68, src=S.oklab(),
    limits=((0.0, 1.0), (-0.5, 0.5), (-0.5, 0.5)), source="t", result="SELECT p.gx, p.gy, round(qr, 6) AS r, round(qg, 6) AS g, round(qb, 6) AS b, round(p.a, 6) AS a FROM p JOIN e ON fresh AND e.gx = p.gx // 64 * 68 + p.gx % 64 + 2 AND e.gy = p.gy // 64 * 68 + p.gy % 64 + 2",
)


@query("ed6_rediffused", diffusion_sql(f"{S.E.replace('p AS (', 'before AS (', 1)}, p AS (SELECT gx, gy, CASE WHEN gx // 64 = 3 THEN 1 - r ELSE r END AS r, g, b, a FROM before)", _uniform(4), image=_BANDS))
def _rediffused(spark, d):
    """Bands of an image are diffused and kept; then one column of tiles changes, and what it reaches is diffused again."""
    from pixelloom.operators.diffuse import diffuse_into, newest_tiles, rediffuse, to_pixels
    from pixelloom.plans.store import scratch

    before = event_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64))
    column = F.floor(F.col("gx") / 64)
    after = before.withColumn("r", F.when(column == 3, 1 - F.col("r")).otherwise(F.col("r")))
    path = scratch(spark, "residuals")
    diffuse_into(path, before, 0, tile=64, levels=4)
    changed = after.where(column == 3).select("image", column.alias("tx"), F.floor(F.col("gy") / 64).alias("ty"))
    rediffuse(path, after, changed, 1, tile=64, levels=4)
    return R.out(to_pixels(newest_tiles(spark, path), 64).drop("image"))


# --- palettes and pyramids ----------------------------------------------------------------------------------------------

# Bins are numbered as they come into being, so that the larger number is the later one in the list of bins.
_MEDIAN_CUT = f"""WITH RECURSIVE {S.E}, i AS (SELECT *, gy::BIGINT * 300 + gx AS idx FROM p), m(idx, bin, step) USING KEY (idx) AS (
  SELECT idx, 0, 0 FROM i
  UNION SELECT idx, CASE WHEN n <= half THEN 2 * s - 1 ELSE 2 * s END, s FROM (
    SELECT j.idx, s, half, row_number() OVER (ORDER BY CASE WHEN dr >= dg AND dr >= db THEN r WHEN dg >= db THEN g ELSE b END, j.idx) AS n
    FROM (SELECT bin, (SELECT max(step) + 1 FROM m) AS s, count(*) // 2 AS half, max(r) - min(r) AS dr, max(g) - min(g) AS dg, max(b) - min(b) AS db
          FROM recurring.m JOIN i USING (idx) GROUP BY bin HAVING count(*) > 1 ORDER BY greatest(dr, dg, db) DESC, bin DESC LIMIT 1) f
    JOIN recurring.m AS q ON q.bin = f.bin JOIN i j ON j.idx = q.idx) WHERE s <= 15)
SELECT (dense_rank() OVER (ORDER BY bin) - 1)::INT AS i, r, g, b FROM (SELECT bin, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM m JOIN i USING (idx) GROUP BY bin)
"""


@query("ag5_median_cut_16", _MEDIAN_CUT)
def _median_cut(spark, d):
    from pixelloom.operators.palettes import median_cut

    return median_cut(R.indexed(spark, d), 16).select("i", *(F.round(c, 6).alias(c) for c in "rgb"))


def _turned(pixels: DataFrame) -> DataFrame:
    """The pixels with red turned round in a column of 64."""
    return pixels.withColumn("r", F.when(F.floor(F.col("gx") / 64) == 3, 1 - F.col("r")).otherwise(F.col("r")))


_TURNED = f"{S.E.replace('p AS (', 'before AS (', 1)}, p AS (SELECT gx, gy, CASE WHEN gx // 64 = 3 THEN 1 - r ELSE r END AS r, g, b, a FROM before)"


def _halved(name: str, source: str) -> str:
    return f"{name} AS (SELECT (gx // 2)::INT AS gx, (gy // 2)::INT AS gy, {', '.join(f'avg({c}) AS {c}' for c in 'rgba')} FROM {source} GROUP BY ALL)"


@query("ag3_updated_pyramid", f"WITH {_TURNED}, {_halved('l1', 'p')}, {_halved('l2', 'l1')} " + S.rows(source="l2"))
def _updated_pyramid(spark, d):
    """A pyramid is built and kept; then some tiles change, and only what lies above them is made again."""
    from pixelloom.operators import pyramid
    from pixelloom.plans.store import scratch

    before = event_raster(spark, d)
    after, path = _turned(before), scratch(spark, "pyramid")
    height = before.agg(F.max("gy")).first()[0] or 0
    top = pyramid.build(path, before, 300, height + 1, tile=16)
    changed = pyramid.in_tiles(after.where(F.floor(F.col("gx") / 64) == 3), 16).select("tx", "ty")
    pyramid.update(path, after, changed, 1, top, tile=16)
    return R.out(pyramid.newest(spark, path, 2))


# --- PNG files ----------------------------------------------------------------------------------------------------------


@query("src1_png_files", f"WITH {S.E} SELECT 'image-' || gy // 64 || '.png' AS name, gx, gy % 64 AS gy, " + ", ".join(f"floor({c} * 255 + 0.5{R.D})::INT AS {c}" for c in "rgba") + " FROM p WHERE gy // 64 >= 0")
def _png_files(spark, d):
    """Bands of a raster are written as PNG files and read back; files that are not 300 wide would not be decoded."""
    from pixelloom.plans.store import scratch
    from pixelloom.sources.png_files import read_png, write_png

    image, folder = F.floor(F.col("gy") / 64), scratch(spark, "png")
    raster = event_raster(spark, d).withColumns({"image": image, "gy": (F.col("gy") % 64).cast("int")})
    write_png(raster, folder, "preview")
    found = read_png(spark, folder).where("width = 300").select("name", "gx", "gy", *(F.round(F.col(c) * 255).cast("int").alias(c) for c in "rgba"))
    # pixels that the table lacks, at the end of the last row, are clear in the file
    there = raster.select(F.concat(F.lit("image-"), F.col("image").cast("string"), F.lit(".png")).alias("name"), "gx", "gy")
    return found.join(there, ["name", "gx", "gy"], "left_semi")


# --- tiles by URL -------------------------------------------------------------------------------------------------------

_PLACE = "'/l/' || event_id % 3 || '/' || event_id % 300 // 16 || '/' || event_id // 300 // 16"
_ASKED = f"""u AS (SELECT event_id, CASE event_id % 13 WHEN 0 THEN 'http://doc/1' WHEN 1 THEN 'tile://doc/1/layer/2' WHEN 2 THEN 'tile://doc/x/layer/1/stage/raw/l/0/0/0'
    WHEN 3 THEN 'tile://doc/1/layer/1/stage/raw/l/256/0/0' WHEN 4 THEN 'tile://doc/1/layer/4294967296/stage/raw/l/0/0/0' WHEN 5 THEN 'tile://localhost/doc/1//layer/composite/stage/composite/l/00/+1/0/#x'
    ELSE 'tile://doc/' || user_id % 4 || '/layer/' || user_id % 6 || '/stage/' || CASE event_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' WHEN 2 THEN 'composite' ELSE 'raw' END || CASE WHEN event_id % 2 = 0 THEN '/l/0/' || event_id % 300 // 16 || '/' || event_id // 300 // 16 ELSE {_PLACE} END || '?g=' || event_id END AS url FROM events)"""
_ANSWERS = f"""WITH {_ASKED}, t AS (SELECT user_id % 3 AS doc, user_id % 5 AS layer, CASE event_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'composite' END AS stage,
    event_id % 300 // 16 AS tx, event_id // 300 // 16 AS ty, max(event_id) AS generation, arg_max(event_type, event_id) = 'click' AS dirty FROM events GROUP BY ALL),
d AS (SELECT user_id % 3 AS doc, 300 AS width, max(event_id) // 300 + 1 AS height, max(event_id) // 2 AS live FROM events GROUP BY ALL),
l AS (SELECT DISTINCT user_id % 3 AS doc, user_id % 5 AS layer FROM events),
s AS (SELECT *, list_filter(string_split(regexp_extract(url, '^tile://(?:localhost/)?([^?#]*)', 1), '/'), lambda x: x <> '') AS p FROM u),
n AS (SELECT event_id, p, p[6] AS stage, p[4] = 'composite' AS whole, {', '.join(f"CASE WHEN regexp_matches(p[{i}], '^[+]?[0-9]+$') AND TRY_CAST(ltrim(p[{i}], '+') AS HUGEINT) <= {most} THEN TRY_CAST(ltrim(p[{i}], '+') AS BIGINT) END AS {c}" for i, c, most in ((2, 'doc', 2**32 - 1), (4, 'named', 2**32 - 1), (8, 'level', 255), (9, 'tx', 2**32 - 1), (10, 'ty', 2**32 - 1)))} FROM s),
k AS (SELECT *, CASE WHEN whole THEN 0 ELSE named END AS layer FROM n),
f AS (SELECT *, coalesce(len(p) = 10 AND p[1] = 'doc' AND p[3] = 'layer' AND p[5] = 'stage' AND p[7] = 'l' AND stage IN ('raw', 'processed', 'composite') AND doc IS NOT NULL AND layer IS NOT NULL AND level IS NOT NULL AND tx IS NOT NULL AND ty IS NOT NULL, false) AS ok FROM k),
v AS (SELECT f.*, live, coalesce(d.doc IS NOT NULL AND (whole OR l.layer IS NOT NULL) AND f.tx < ceil(width / (16 * pow(2, level))) AND f.ty < ceil(height / (16 * pow(2, level))), false) AS valid
      FROM f LEFT JOIN d ON d.doc = f.doc AND f.ok LEFT JOIN l ON l.doc = f.doc AND l.layer = f.layer)
SELECT event_id, (CASE WHEN NOT ok THEN 400 WHEN NOT valid THEN 404 WHEN NOT dirty AND generation >= live THEN 200 ELSE 202 END)::INT AS status, CASE WHEN ok AND valid AND NOT dirty AND generation >= live THEN generation END AS generation
FROM v LEFT JOIN t ON v.valid AND v.level = 0 AND t.doc = v.doc AND t.layer = v.layer AND t.stage = v.stage AND t.tx = v.tx AND t.ty = v.ty
"""


@query("src16_tile_answers", _ANSWERS)
def _answers(spark, d):
    """Tiles asked for by URL, good and bad ones, of a store of the newest tiles of level 0."""
    from pixelloom.operators import tile_store
    from pixelloom.plans.store import scratch
    from pixelloom.sources.rasters import table

    e, at = table(spark, d, "events"), F.col("event_id")
    doc, layer, x, y = F.col("user_id") % 3, F.col("user_id") % 5, F.floor(at % 300 / 16), F.floor(F.floor(at / 300) / 16)
    stage = F.element_at(F.array(*(F.lit(s) for s in tile_store.STAGES)), (at % 3 + 1).cast("int"))
    tiles = e.select(doc.alias("doc"), layer.alias("layer"), stage.alias("stage"), F.lit(0).alias("level"), x.alias("tx"), y.alias("ty"), at.alias("generation"), (F.col("event_type") == "click").alias("dirty"))
    newest = tiles.groupBy(*tile_store.KEY).agg(F.max("generation").alias("generation"), F.max_by("dirty", "generation").alias("dirty"))
    path = scratch(spark, "tiles")
    tile_store.write_store(newest, path)
    asked = F.element_at(F.array(*(F.lit(s) for s in ("raw", "processed", "composite", "raw"))), (at % 4 + 1).cast("int"))
    level = F.when(at % 2 == 0, 0).otherwise(at % 3)
    good = F.concat(tile_store.tile_url(F.col("user_id") % 4, F.col("user_id") % 6, asked, level, x, y), F.lit("?g="), at.cast("string"))
    bad = ["http://doc/1", "tile://doc/1/layer/2", "tile://doc/x/layer/1/stage/raw/l/0/0/0", "tile://doc/1/layer/1/stage/raw/l/256/0/0", "tile://doc/1/layer/4294967296/stage/raw/l/0/0/0", "tile://localhost/doc/1//layer/composite/stage/composite/l/00/+1/0/#x"]
    url = F.when(at % 13 < len(bad), F.element_at(F.array(*(F.lit(b) for b in bad)), (F.least(at % 13, F.lit(len(bad) - 1)) + 1).cast("int"))).otherwise(good)
    documents = e.groupBy(doc.alias("doc")).agg(F.lit(300).alias("width"), (F.floor(F.max("event_id") / 300) + 1).alias("height"), F.floor(F.max("event_id") / 2).alias("generation"))
    layers = e.select(doc.alias("doc"), layer.alias("layer")).distinct()
    return tile_store.answered(e.select("event_id", url.alias("url")), documents, layers, path, tile=16).select("event_id", "status", "generation")


@query("snk3_exact_mesh")
def _exact_mesh(spark, d):
    """Rectangles of images of 192 rows, in bands of 64 that don't cut them, a little tolerant of colour."""
    from pixelloom.operators.mesh import rectangles

    tones = two_tones(event_raster(spark, d)).withColumns({"image": F.floor(F.col("gy") / 192), "gy": (F.col("gy") % 192).cast("int")})
    return rectangles(tones.withColumn("g", F.col("g") - F.when(F.col("gx") % 7 == 0, F.col("g") / 255 * 3).otherwise(0)), tolerance=3)


# A log of edits, undos and redos: every twentieth user works on document 0, all others on their own.
_LOG = """l AS (SELECT CASE WHEN user_id % 20 = 0 THEN 0 ELSE user_id END AS doc, event_id AS seq, event_id % 5 AS layer, value,
  CASE WHEN event_id * 7919 % 10 < 5 THEN 'edit' WHEN event_id * 7919 % 10 < 8 THEN 'undo' ELSE 'redo' END AS op FROM events)"""
_REPLAY = """o AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seq) AS n FROM l),
w AS (SELECT doc, 0::BIGINT AS n, NULL::BIGINT AS seq, '' AS op, FALSE AS applied, NULL::BIGINT AS version, []::BIGINT[] AS u, []::BIGINT[] AS r, []::BIGINT[] AS path FROM (SELECT DISTINCT doc FROM l)
  UNION ALL SELECT o.doc, o.n, o.seq, o.op, o.op = 'edit' OR (o.op = 'undo' AND len(u) > 0) OR (o.op = 'redo' AND len(r) > 0),
    CASE WHEN o.op = 'edit' THEN o.seq WHEN o.op = 'undo' AND len(u) > 0 THEN u[-1] WHEN o.op = 'redo' AND len(r) > 0 THEN r[-1] ELSE version END,
    CASE WHEN o.op = 'edit' THEN list_append(u, version)[-{depth}:] WHEN o.op = 'undo' THEN u[:-2] WHEN len(r) > 0 THEN list_append(u, version) ELSE u END,
    CASE WHEN o.op = 'edit' THEN [] WHEN o.op = 'redo' THEN r[:-2] WHEN len(u) > 0 THEN list_append(r, version) ELSE r END,
    CASE WHEN o.op = 'edit' THEN list_append(path, o.seq) WHEN o.op = 'undo' AND len(u) > 0 THEN path[:-2] WHEN o.op = 'redo' AND len(r) > 0 THEN list_append(path, r[-1]) ELSE path END
  FROM w JOIN o ON o.doc = w.doc AND o.n = w.n + 1)"""


def edit_log(spark, d):
    """The events as a log of documents: doc, seq, op, layer, value."""
    turn = F.col("event_id") * 7919 % 10
    op = F.when(turn < 5, "edit").when(turn < 8, "undo").otherwise("redo")
    doc = F.when(F.col("user_id") % 20 == 0, F.lit(0).cast("long")).otherwise(F.col("user_id"))
    return R.table(spark, d, "events").select(doc.alias("doc"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("event_id") % 5).alias("layer"), "value")


@query("st11_undo_redo", f"WITH RECURSIVE {_LOG}, {_REPLAY.format(depth=5)} SELECT doc, seq, op, applied, version, len(u)::BIGINT AS undo, len(r)::BIGINT AS redo FROM w WHERE n > 0")
def _undo_redo(spark, d):
    return versions.history(edit_log(spark, d), depth=5).drop("level")


@query("st10_checkout", f"WITH RECURSIVE {_LOG}, {_REPLAY.format(depth=50)}, f AS (SELECT doc, arg_max(path, n) AS path FROM w GROUP BY doc), e AS (SELECT doc, unnest(path) AS seq FROM f) SELECT doc, layer, max(seq) AS version, arg_max(value, seq) AS value FROM e JOIN l USING (doc, seq) GROUP BY doc, layer")
def _checkout(spark, d):
    """Documents as they stand at the end, by a snapshot half way and the log after it."""
    log = edit_log(spark, d)
    half = log.agg(F.floor(F.max("seq") / 2)).first()[0]
    first = versions.snapshot(versions.history(log.where(F.col("seq") <= half)))
    later = versions.history(log.where(F.col("seq") > half), start=first)
    return versions.checkout(log, versions.snapshot(later, first), ["layer"])
