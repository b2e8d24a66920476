"""Registered queries of palettes as text, tile sets, schedules, versions and changes, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators import diffuse, palettes, params
from pixelloom.plans import raster_sql as S
from pixelloom.plans import viewport
from pixelloom.plans.running import running_sum
from pixelloom.plans.store import scratch
from pixelloom.sources import palette_files, rasters
from pixelloom.sources.presets import PRESETS
from pixelloom.sources.rasters import PALETTE5, event_raster, table
from pixelloom.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
D = "::DOUBLE"
RGB = ("r", "g", "b")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Tiles of 16 pixels over the event raster, with a stage, a size and versions made of the events in them.
TILES = """t AS (SELECT (user_id % 3)::BIGINT AS doc, (user_id % 5)::BIGINT AS layer, ((event_id % 300) // 16)::BIGINT AS tx, ((event_id // 300) // 16)::BIGINT AS ty,
  CASE event_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' ELSE 'composite' END AS stage, event_id AS generation, user_id % 2 = 0 AS active, event_id % 4 = 0 AS visible, (1000 + event_id % 77)::BIGINT AS bytes, ts, event_type, value FROM events)"""
KINDS = "CASE user_id % 4 WHEN 0 THEN 'raw' WHEN 1 THEN 'filter' WHEN 2 THEN 'properties' ELSE 'mask' END"


def tile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    step = F.col("event_id") % 3
    return e.select(
        (F.col("user_id") % 3).alias("doc"),
        (F.col("user_id") % 5).alias("layer"),
        F.floor((F.col("event_id") % 300) / 16).alias("tx"),
        F.floor(F.floor(F.col("event_id") / 300) / 16).alias("ty"),
        F.when(step == 0, "raw").when(step == 1, "processed").otherwise("composite").alias("stage"),
        F.col("event_id").alias("generation"),
        (F.col("user_id") % 2 == 0).alias("active"),
        (F.col("event_id") % 4 == 0).alias("visible"),
        (F.lit(1000) + F.col("event_id") % 77).cast("long").alias("bytes"),
        "ts",
        "event_type",
        "value",
    )


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes: the clicks, each on the tile where it lies."""
    e = table(spark, sf_dir, "events").where(F.col("event_type") == "click")
    step = F.col("user_id") % 4
    kind = F.when(step == 0, "raw").when(step == 1, "filter").when(step == 2, "properties").otherwise("mask")
    return e.select((F.col("user_id") % 3).alias("doc"), (F.col("user_id") % 5).alias("layer"), F.floor((F.col("event_id") % 300) / 16).alias("tx"), F.floor(F.floor(F.col("event_id") / 300) / 16).alias("ty"), kind.alias("kind"))


CHANGES = f"c AS (SELECT (user_id % 3)::BIGINT AS doc, (user_id % 5)::BIGINT AS layer, ((event_id % 300) // 16)::BIGINT AS tx, ((event_id // 300) // 16)::BIGINT AS ty, {KINDS} AS kind FROM events WHERE event_type = 'click')"


# --- sources and sinks -------------------------------------------------------------------------------------------------


@query("src2_blank", f"WITH {S.E}, s AS (SELECT max(gx) + 1 AS w, max(gy) + 1 AS h FROM p) SELECT (i % w)::INT AS gx, (i // w)::INT AS gy, 1{D} AS r, 1{D} AS g, 1{D} AS b, 1{D} AS a FROM s, (SELECT unnest(range(w * h)) AS i FROM s)")
def _blank(spark, d):
    size = event_raster(spark, d).agg(F.max("gx"), F.max("gy")).first()
    wide, tall, found = size[0] + 1, size[1] + 1, None
    for top in range(0, tall, rasters.SIDE):  # canvases of bounded size, one below the other
        one = rasters.blank(spark, wide, min(rasters.SIDE, tall - top), "white").withColumn("gy", (F.col("gy") + top).cast("int"))
        found = one if found is None else found.unionByName(one)
    return found


@query("src3_import_layer", f"WITH {S.E}, s AS (SELECT max(gx) + 21 AS w, max(gy) + 3 AS h FROM p), g AS (SELECT (i % w)::INT AS gx, (i // w)::INT AS gy FROM s, (SELECT unnest(range(w * h)) AS i FROM s)) SELECT gx, gy, " + ", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in "rgba") + " FROM g LEFT JOIN p USING (gx, gy)")
def _import(spark, d):
    from pixelloom.sources.images import import_layer

    size = event_raster(spark, d).agg(F.max("gx"), F.max("gy")).first()
    return import_layer(event_raster(spark, d), size[0] + 21, size[1] + 3).select("gx", "gy", *(F.round(c, 6).alias(c) for c in "rgba"))


def event_colors(spark, d) -> DataFrame:
    """A palette per day: the colours of its events, in order of id."""
    e = table(spark, d, "events")
    unit = lambda x: F.pmod(x, F.lit(256)).cast("int")
    day = F.date_format("ts", "yyyy-MM-dd")
    one = F.lit(1).cast("long")
    e = running_sum(e.select(day.alias("name"), "event_id", "value", "user_id"), ["name", "event_id"], one, "n")
    before = e.groupBy("name").agg(F.min("n").alias("first"))
    e = e.join(F.broadcast(before), "name")
    return e.select("name", (F.col("n") - F.col("first")).cast("int").alias("i"), unit(F.floor(F.col("value") * 100.0 + 0.5)).alias("r"), unit(F.col("user_id") * 37).alias("g"), unit(F.col("event_id") * 11).alias("b"))


_COLORS = f"""k AS (SELECT strftime(ts, '%Y-%m-%d') AS name, (row_number() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY event_id) - 1)::INT AS i,
 (((floor(value * 100{D} + 0.5{D})::BIGINT % 256) + 256) % 256)::INT AS r, ((((user_id * 37) % 256) + 256) % 256)::INT AS g, ((event_id * 11) % 256)::INT AS b FROM events)"""


def _round_trip(kind: str):
    """Palettes written in a format, kept, and parsed again, a day as files of as many colours as the format takes."""

    def run(spark, d):
        colors, most = event_colors(spark, d), palette_files.A_FILE
        block = F.floor(F.col("i") / most).cast("string")
        files = colors.select(F.concat_ws("/", "name", block).alias("name"), (F.col("i") % most).alias("i"), *RGB)
        at = F.split("name", "/")
        path = scratch(spark, "palettes")
        palette_files.encoded(files, kind).write.parquet(path)
        found = palette_files.parsed(spark.read.parquet(path))
        return found.select(at[0].alias("name"), (at[1].cast("int") * most + F.col("i")).cast("int").alias("i"), *RGB)

    return run


for _id, _kind in (("src7", "ase"), ("src8", "aco"), ("src10", "pal"), ("src11", "csv"), ("src12", "json"), ("snk8", "gpl")):
    query(f"{_id}_palette_{_kind}", f"WITH {_COLORS} SELECT name, i, r, g, b FROM k")(_round_trip(_kind))


@query("src9_palette_gpl_text", f"WITH {_COLORS} SELECT name, (i + 2)::INT AS line, r, g, b FROM k")
def _gpl_text(spark, d):
    line = F.format_string("%3d %3d %3d\tUntitled", "r", "g", "b")
    text = event_colors(spark, d).groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return palette_files.parsed_text(text.select("name", F.concat(F.lit("GIMP Palette\n#\n"), "t").alias("body")))


@query("src13_palette_limits", f"WITH {_COLORS} SELECT name, count(*)::BIGINT AS n, count(*) BETWEEN 1 AND 65536 AS fits, round(avg(CASE WHEN r / 255{D} <= {S.n(0.04045)} THEN r / 255{D} / {S.n(12.92)} ELSE pow((r / 255{D} + {S.n(0.055)}) / {S.n(1.055)}, {S.n(2.4)}) END), 6) AS red FROM k GROUP BY name")
def _limits(spark, d):
    return event_colors(spark, d).groupBy("name").agg(F.count("*").alias("n"), F.count("*").between(1, palette_files.MOST).alias("fits"), F.round(F.avg(C.srgb_to_linear(F.col("r"))), 6).alias("red"))


@query("src14_presets", f"WITH {S.E}, k(id, i, kr, kg, kb) AS (VALUES {', '.join(f"('{n}', {i}, {c[0]}, {c[1]}, {c[2]})" for p in PRESETS for n in [p.id] for i, c in enumerate(p.colors))}), n AS (SELECT gx, gy, id, i, row_number() OVER (PARTITION BY gx, gy, id ORDER BY pow(r * 255 - kr, 2) + pow(g * 255 - kg, 2) + pow(b * 255 - kb, 2), i) AS n FROM p, k) SELECT id, i::INT AS i, count(*)::BIGINT AS pixels FROM n WHERE n = 1 GROUP BY id, i")
def _presets(spark, d):
    """Pixels by nearest colour of each preset."""
    near = [C.nearest(C.palette_literal(preset.colors), [F.col(c) * 255.0 for c in RGB]) for preset in PRESETS]
    each = F.array(*(F.struct(F.lit(preset.id).alias("id"), F.element_at(n, 1)["i"].alias("i")) for preset, n in zip(PRESETS, near, strict=True)))
    found = event_raster(spark, d).select(F.explode(each).alias("x")).select("x.*")
    return found.groupBy("id", "i").agg(F.count("*").alias("pixels"))


@query("src16_tile_lookup", f"WITH {TILES}, want AS (SELECT DISTINCT doc, layer, tx, ty FROM t WHERE visible), have AS (SELECT doc, layer, tx, ty, max(generation) AS generation FROM t WHERE stage = 'composite' GROUP BY ALL) SELECT doc, layer, tx, ty, CASE WHEN generation IS NULL THEN 202 ELSE 200 END::INT AS status, generation FROM want LEFT JOIN have USING (doc, layer, tx, ty)")
def _lookup(spark, d):
    """The newest composite of each tile that is asked for: 200 with it, or 202 where it is yet to be made."""
    t = tile_events(spark, d)
    have = t.where("stage = 'composite'").groupBy(*_KEY).agg(F.max("generation").alias("generation"))
    found = t.where("visible").select(*_KEY).distinct().join(have, _KEY, "left")
    return found.select(*_KEY, F.when(F.col("generation").isNull(), 202).otherwise(200).alias("status"), "generation")


@query("snk10_content_dedup", "SELECT sha256(event_type || ':' || (user_id % 100)::VARCHAR)[1:32] AS digest, min(event_id) AS first, count(*)::BIGINT AS n FROM events GROUP BY 1")
def _content(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.substring(F.sha2(F.concat_ws(":", "event_type", (F.col("user_id") % 100).cast("string")), 256), 1, 32).alias("digest")).agg(F.min("event_id").alias("first"), F.count("*").alias("n"))


@query("snk11_recent_files", "WITH f AS (SELECT user_id, event_type, max(ts) AS seen, max(event_id) AS id FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seen DESC, id DESC) AS n FROM f) SELECT user_id, event_type, n::INT AS n FROM r WHERE n <= 3")
def _recent(spark, d):
    seen = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("at"), F.max("event_id").alias("id"))
    return seen.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("at"), F.desc("id")))).where("n <= 3").select("user_id", "event_type", "n")


# --- joins -------------------------------------------------------------------------------------------------------------

_KEY = ["doc", "layer", "tx", "ty"]


def _last_tile(spark, d) -> tuple[int, int]:
    """The largest tx and ty."""
    found = tile_events(spark, d).agg(F.max("tx"), F.max("ty")).first()
    return found[0] or 0, found[1] or 0


@query("j1_point_join", f"WITH {TILES}, w AS (SELECT DISTINCT doc, layer, tx, ty FROM t WHERE visible) SELECT t.doc, t.layer, t.tx, t.ty, t.stage, t.generation FROM t JOIN w USING (doc, layer, tx, ty)")
def _point_join(spark, d):
    t = tile_events(spark, d)
    return t.join(t.where("visible").select(*_KEY).distinct(), _KEY).select(*_KEY, "stage", "generation")


@query("j3_neighbours", f"WITH {TILES}, k AS (SELECT DISTINCT doc, tx, ty FROM t) SELECT k.doc, k.tx, k.ty, l.tx IS NOT NULL AS has_left, u.tx IS NOT NULL AS has_top, g.tx IS NOT NULL AS has_diag FROM k LEFT JOIN k l ON l.doc = k.doc AND l.tx = k.tx - 1 AND l.ty = k.ty LEFT JOIN k u ON u.doc = k.doc AND u.tx = k.tx AND u.ty = k.ty - 1 LEFT JOIN k g ON g.doc = k.doc AND g.tx = k.tx - 1 AND g.ty = k.ty - 1")
def _neighbours(spark, d):
    k = tile_events(spark, d).select("doc", "tx", "ty").distinct()
    out = k
    for name, dx, dy in (("left", 1, 0), ("top", 0, 1), ("diag", 1, 1)):
        near = k.select("doc", (F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), F.lit(True).alias(f"has_{name}"))
        out = out.join(near, ["doc", "tx", "ty"], "left")
    return out.select("doc", "tx", "ty", *(F.coalesce(f"has_{n}", F.lit(False)).alias(f"has_{n}") for n in ("left", "top", "diag")))


@query("j5_nearest_lab", f"WITH {S.V}, {S.palette(PALETTE5)}, l AS (SELECT i, {', '.join(f'{x} AS p{k}' for x, k in zip(S.oklab(), 'xyz', strict=True))} FROM pal), c AS (SELECT gx, gy, {', '.join(f'{x} AS c{k}' for x, k in zip(S.oklab(), 'xyz', strict=True))} FROM p), n AS (SELECT gx, gy, i, row_number() OVER (PARTITION BY gx, gy ORDER BY pow(cx - px, 2) + pow(cy - py, 2) + pow(cz - pz, 2), i) AS n FROM c, l) SELECT i::INT AS i, count(*)::BIGINT AS pixels FROM n WHERE n = 1 GROUP BY i")
def _nearest(spark, d):
    near = C.nearest(C.palette_literal([C.oklab_of(c) for c in PALETTE5]), C.linear_to_oklab([F.col(c) for c in RGB]))
    return rasters.vector_raster(spark, d).select(F.element_at(near, 1)["i"].alias("i")).groupBy("i").agg(F.count("*").alias("pixels"))


@query("j8_range", f"WITH {TILES} SELECT doc, layer, tx, ty, stage, generation FROM t, (SELECT max(tx) AS mx, max(ty) AS my FROM t) WHERE tx BETWEEN mx // 4 AND mx * 3 // 4 AND ty BETWEEN my // 4 AND my * 3 // 4")
def _range(spark, d):
    t, (mx, my) = tile_events(spark, d), _last_tile(spark, d)
    return t.where(F.col("tx").between(mx // 4, mx * 3 // 4) & F.col("ty").between(my // 4, my * 3 // 4)).select(*_KEY, "stage", "generation")


@query("j9_parents", f"WITH {TILES}, k AS (SELECT DISTINCT doc, tx, ty FROM t), q AS (SELECT DISTINCT doc, tx // 2 AS px, ty // 2 AS py FROM k) SELECT q.doc, px, py, count(*)::BIGINT AS children FROM q JOIN k ON k.doc = q.doc AND k.tx // 2 = px AND k.ty // 2 = py GROUP BY ALL")
def _parents(spark, d):
    k = tile_events(spark, d).select("doc", "tx", "ty").distinct()
    return k.groupBy("doc", F.floor(F.col("tx") / 2).alias("px"), F.floor(F.col("ty") / 2).alias("py")).agg(F.count("*").alias("children"))


@query("j10_references", f"WITH {TILES} SELECT DISTINCT doc, layer FROM t SEMI JOIN (SELECT DISTINCT user_id % 3 AS doc FROM events WHERE event_type = 'purchase' AND value > 90) w USING (doc)")
def _references(spark, d):
    wanted = table(spark, d, "events").where("event_type = 'purchase' AND value > 90").select((F.col("user_id") % 3).alias("doc")).distinct()
    return tile_events(spark, d).join(wanted, "doc", "left_semi").select("doc", "layer").distinct()


@query("j11_orphans", f"WITH {TILES} SELECT DISTINCT doc, layer, tx, ty FROM t WHERE stage = 'raw' AND NOT EXISTS (SELECT 1 FROM t u WHERE u.doc = t.doc AND u.layer = t.layer AND u.tx = t.tx AND u.ty = t.ty AND u.visible)")
def _orphans(spark, d):
    t = tile_events(spark, d)
    return t.where("stage = 'raw'").select(*_KEY).distinct().join(t.where("visible").select(*_KEY).distinct(), _KEY, "left_anti")


@query("j12_id_remap", "WITH m AS (SELECT user_id, row_number() OVER (ORDER BY user_id) AS new_id FROM (SELECT DISTINCT user_id FROM events)) SELECT event_id, new_id FROM events JOIN m USING (user_id)")
def _remap(spark, d):
    e = table(spark, d, "events")
    ids = running_sum(e.select("user_id").distinct(), ["user_id"], F.lit(1).cast("long"), "new_id")
    return e.join(ids, "user_id").select("event_id", "new_id")


# --- viewport, schedule, eviction --------------------------------------------------------------------------------------

@query("wn3_visible_tiles", f"WITH {S.E}, n AS (SELECT ceil((max(gx) + 1){D} / 16)::BIGINT AS nx, ceil((max(gy) + 1){D} / 16)::BIGINT AS ny FROM p), g AS (SELECT x, y, nx, ny FROM n, range(2000) a(x), range(3) b(y)) SELECT 1 AS level, x AS tx, y AS ty FROM g WHERE x BETWEEN floor(70{D} / 32) AND ceil((70 + 110 / {S.n(0.4)}) / 32) - 1 AND y BETWEEN 0 AND ceil((20 + 70 / {S.n(0.4)}) / 32) - 1 AND x < ceil(nx{D} / 2) AND y < ceil(ny{D} / 2)")
def _visible(spark, d):
    size = event_raster(spark, d).agg(F.max("gx"), F.max("gy")).first()
    return viewport.visible(spark, 70.0, 20.0, 110.0, 70.0, 0.4, -(-(size[0] + 1) // 16), -(-(size[1] + 1) // 16), tile=16)


def _box(spark, d):
    """The distinct tiles that hold purchases."""
    return tile_events(spark, d).where("event_type = 'purchase'").select("tx", "ty").distinct()


_BOX = f"{TILES}, b AS (SELECT DISTINCT tx, ty FROM t WHERE event_type = 'purchase')"


@query("wn1_center_out", f"WITH {_BOX}, m AS (SELECT (min(tx) + max(tx)) / 2{D} AS cx, (min(ty) + max(ty)) / 2{D} AS cy FROM b) SELECT tx, ty, abs(tx - cx) + abs(ty - cy) AS distance, row_number() OVER (ORDER BY abs(tx - cx) + abs(ty - cy), ty, tx)::INT AS rank FROM b, m")
def _center_out(spark, d):
    return viewport.center_out(_box(spark, d))


@query("wn2_priority", f"WITH {_BOX}, m AS (SELECT min(tx){D} AS x0, max(tx){D} AS x1, min(ty){D} AS y0, max(ty){D} AS y1 FROM b) SELECT tx, ty, CASE WHEN abs(tx - (x0 + x1) / 2) <= (x1 - x0 + 1) / 4 AND abs(ty - (y0 + y1) / 2) <= (y1 - y0 + 1) / 4 THEN 'center' ELSE 'edge' END AS priority FROM b, m")
def _priority(spark, d):
    return viewport.with_priority(_box(spark, d))


@query("wn4_prefetch_ring", f"WITH {_BOX}, m AS (SELECT greatest(min(tx) - 1, 0) AS x0, least(max(tx) + 1, (SELECT max(tx) + 1 FROM t)) AS x1, greatest(min(ty) - 1, 0) AS y0, least(max(ty) + 1, (SELECT max(ty) + 1 FROM t)) AS y1 FROM b), g AS (SELECT unnest(range(x0, x1 + 1)) AS tx, y0, y1 FROM m), h AS (SELECT tx, unnest(range(y0, y1 + 1)) AS ty FROM g) SELECT tx, ty FROM h ANTI JOIN b USING (tx, ty)")
def _ring(spark, d):
    mx, my = _last_tile(spark, d)  # the grid goes on one tile further
    return viewport.prefetch_ring(_box(spark, d), mx + 2, my + 2)


@query("wn5_level_from_zoom", f"SELECT event_id, CASE WHEN z >= 1 THEN 0 ELSE least(floor(log2(1 / z)), 5) END::INT AS level FROM (SELECT event_id, least(greatest(value / 100, {S.n(0.01)}), {S.n(64)}) AS z FROM events)")
def _zoom(spark, d):
    z = F.least(F.greatest(F.col("value") / 100, F.lit(0.01)), F.lit(64.0))
    return table(spark, d, "events").select("event_id", F.when(z >= 1, 0).otherwise(F.least(F.floor(F.log2(1 / z)), F.lit(5))).cast("int").alias("level"))


@query("wn6_queue", f"WITH {TILES}, k AS (SELECT doc, layer, tx, ty, (generation % 4)::INT AS priority, generation, row_number() OVER (PARTITION BY doc, layer, tx, ty ORDER BY generation % 4, generation DESC) AS n FROM t) SELECT doc, layer, tx, ty, priority, generation FROM k WHERE n = 1")
def _queue(spark, d):
    t = tile_events(spark, d).select(F.struct(*_KEY).alias("key"), (F.col("generation") % 4).cast("int").alias("priority"), "generation")
    return viewport.pending(t).select("key.*", "priority", "generation")


@query("wn7_eviction", f"WITH {TILES}, k AS (SELECT doc, generation, stage, bytes, sum(bytes) OVER (PARTITION BY doc ORDER BY CASE WHEN stage = 'raw' THEN 0 WHEN visible THEN 1 WHEN active THEN 2 ELSE 3 END, CASE WHEN stage = 'processed' THEN 0 ELSE 1 END, generation ROWS UNBOUNDED PRECEDING) AS total FROM t) SELECT doc, generation AS key, stage FROM k WHERE total > 400000 AND stage <> 'raw'")
def _eviction(spark, d):
    t = tile_events(spark, d).withColumnRenamed("generation", "key")
    return viewport.evicted(t.select("doc", "key", "stage", "active", "visible", "bytes"), 400000).select("doc", "key", "stage")


@query("wn8_undo_depth", "WITH k AS (SELECT user_id AS doc, event_id AS version, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT doc, version FROM k WHERE n <= 5")
def _undo(spark, d):
    return viewport.last_versions(table(spark, d, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("version")), 5)


@query("set1_dirty_union", f"WITH {TILES} SELECT doc, layer, tx, ty FROM t WHERE visible UNION SELECT doc, layer, tx, ty FROM t WHERE stage = 'composite'")
def _dirty(spark, d):
    t = tile_events(spark, d)
    return t.where("visible").select(*_KEY).unionByName(t.where("stage = 'composite'").select(*_KEY)).dropDuplicates()


# --- error diffusion's relations ---------------------------------------------------------------------------------------


@query("ed1_kernel_reach", f"WITH {S.E}, w(kernel, dx, dy, weight) AS (VALUES {', '.join(f"('{k}', {dx}, {dy}, {S.n(w / total)})" for k, (total, taps) in diffuse.KERNELS.items() for dx, dy, w in taps)}) SELECT kernel, count(*)::BIGINT AS landed, round(sum(weight), 6) AS weight FROM p, w, (SELECT max(gy) AS ym FROM p) WHERE gx + dx BETWEEN 0 AND 299 AND gy + dy <= ym GROUP BY kernel")
def _reach(spark, d):
    """How much error the pixels pass on inside the image."""
    p = event_raster(spark, d).select("gx", "gy")
    tall = event_raster(spark, d).agg(F.max("gy")).first()[0]
    taps = F.array(*(F.struct(F.lit(k).alias("kernel"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(w / total).alias("weight")) for k, (total, ts) in diffuse.KERNELS.items() for dx, dy, w in ts))
    sent = p.select("gx", "gy", F.explode(taps).alias("w")).where((F.col("gx") + F.col("w.dx")).between(0, 299) & (F.col("gy") + F.col("w.dy") <= tall))
    return sent.groupBy("w.kernel").agg(F.count("*").alias("landed"), F.round(F.sum("w.weight"), 6).alias("weight"))


@query("ed6_downstream", f"WITH {TILES} SELECT DISTINCT doc, tx, ty FROM t, (SELECT max(tx) AS mx, max(ty) AS my FROM t) WHERE tx >= mx // 2 AND ty >= my // 2")
def _downstream(spark, d):
    return diffuse.downstream(tile_events(spark, d).select("doc", "tx", "ty").distinct(), *(x // 2 for x in _last_tile(spark, d)))


@query("ed12_dependencies", f"WITH {TILES}, k AS (SELECT DISTINCT tx, ty FROM t), s(dx, dy) AS (VALUES (1, 0), (0, 1), (1, 1)) SELECT tx, ty, tx - dx AS needs_tx, ty - dy AS needs_ty FROM k, s WHERE tx >= dx AND ty >= dy")
def _dependencies(spark, d):
    return diffuse.tile_dependencies(tile_events(spark, d).select("tx", "ty").distinct())


@query("ed13_causal_prefix", f"WITH {TILES} SELECT DISTINCT tx, ty FROM t, (SELECT max(tx) AS mx, max(ty) AS my FROM t) WHERE tx <= mx // 2 AND ty <= my // 2")
def _prefix(spark, d):
    return diffuse.causal_prefix(tile_events(spark, d).select("tx", "ty").distinct(), *(x // 2 for x in _last_tile(spark, d)))


# --- functions on colours and text -------------------------------------------------------------------------------------


@query("fn12_colors_to_oklab", f"WITH {_COLORS}, l AS (SELECT name, i, {', '.join(f'CASE WHEN {c} / 255{D} <= {S.n(0.04045)} THEN {c} / 255{D} / {S.n(12.92)} ELSE pow(({c} / 255{D} + {S.n(0.055)}) / {S.n(1.055)}, {S.n(2.4)}) END AS {c}' for c in RGB)} FROM k) SELECT name, i, {', '.join(f'round({x}, 6) AS {n}' for x, n in zip(S.oklab(), ('ok_l', 'ok_a', 'ok_b'), strict=True))} FROM l")
def _to_oklab(spark, d):
    text = event_colors(spark, d).select("name", "i", C.bytes_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"))
    linear = text.select("name", "i", *(C.srgb_to_linear(x).alias(c) for x, c in zip(C.hex_to_bytes(F.col("hex")), RGB, strict=True)))
    return linear.select("name", "i", *(F.round(x, 6).alias(n) for x, n in zip(C.linear_to_oklab([F.col(c) for c in RGB]), ("ok_l", "ok_a", "ok_b"), strict=True)))


_V3 = "(CASE WHEN regexp_matches(t, '^[0-9]+\\.[0-9]+\\.[0-9]+$') THEN string_split(t, '.')[{}]::INT END)"


@query("fn18_semver", f"WITH v AS (SELECT event_id, event_type, (user_id % 4)::VARCHAR || '.' || (event_id % 13)::VARCHAR || CASE WHEN event_id % 10 = 3 THEN '' ELSE '.' || (event_id % 7)::VARCHAR END AS t FROM events) SELECT event_type, array_to_string(max([{_V3.format(1)}, {_V3.format(2)}, {_V3.format(3)}]) FILTER ({_V3.format(1)} IS NOT NULL), '.') AS newest, count({_V3.format(1)})::BIGINT AS good FROM v GROUP BY event_type")
def _semver(spark, d):
    text = F.concat_ws(".", (F.col("user_id") % 4).cast("string"), (F.col("event_id") % 13).cast("string"), F.when(F.col("event_id") % 10 != 3, (F.col("event_id") % 7).cast("string")))
    parts = table(spark, d, "events").select("event_type", text.alias("t")).withColumn("v", F.when(F.col("t").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.transform(F.split("t", r"\."), lambda x: x.cast("int"))))
    return parts.groupBy("event_type").agg(F.array_join(F.max("v"), ".").alias("newest"), F.count("v").alias("good"))


@query("fn19_palette_names", "SELECT event_id, left('Palette ' || coalesce(props, '') || ' (' || (user_id % 256)::VARCHAR || ')', 64) AS name FROM events")
def _names(spark, d):
    return table(spark, d, "events").select("event_id", F.left(F.concat(F.lit("Palette "), F.coalesce("props", F.lit("")), F.lit(" ("), (F.col("user_id") % 256).cast("string"), F.lit(")")), F.lit(64)).alias("name"))


@query("fn20_tile_url", "WITH u AS (SELECT event_id, 'tile://doc/' || user_id || '/layer/' || CASE WHEN event_id % 5 = 0 THEN 'composite' ELSE (event_id % 9)::VARCHAR END || '/stage/processed/l/' || (event_id % 3) || '/' || (event_id % 17) || '/' || CASE WHEN event_id % 11 = 0 THEN 'x' ELSE (event_id % 19)::VARCHAR END AS t FROM events) SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 400 ELSE 200 END::INT AS status, CASE WHEN event_id % 11 <> 0 THEN string_split(t, '/')[4]::BIGINT END AS doc, CASE WHEN event_id % 11 <> 0 THEN CASE WHEN string_split(t, '/')[6] = 'composite' THEN 0 ELSE string_split(t, '/')[6]::BIGINT END END AS layer, CASE WHEN event_id % 11 <> 0 THEN string_split(t, '/')[12]::INT END AS ty FROM u")
def _urls(spark, d):
    e, s = F.col("event_id"), lambda x: x.cast("string")
    layer = F.when(e % 5 == 0, "composite").otherwise(s(e % 9))
    y = F.when(e % 11 == 0, "x").otherwise(s(e % 19))
    url = F.concat(F.lit("tile://doc/"), s(F.col("user_id")), F.lit("/layer/"), layer, F.lit("/stage/processed/l/"), s(e % 3), F.lit("/"), s(e % 17), F.lit("/"), y)
    rule = r"^tile://doc/(\d+)/layer/(\d+|composite)/stage/(raw|processed|composite)/l/(\d+)/(\d+)/(\d+)$"
    got = lambda k: F.nullif(F.regexp_extract("t", rule, k), F.lit(""))
    return table(spark, d, "events").select("event_id", url.alias("t")).select("event_id", F.when(F.col("t").rlike(rule), 200).otherwise(400).alias("status"), got(1).cast("long").alias("doc"), F.when(got(2) == "composite", 0).otherwise(F.expr(f"try_cast(regexp_extract(t, r'{rule}', 2) AS BIGINT)")).alias("layer"), got(6).cast("int").alias("ty"))


def _means(spark, d):
    """The mean colour of each event type."""
    types = table(spark, d, "events").select((F.col("event_id") % 300).cast("int").alias("gx"), F.floor(F.col("event_id") / 300).cast("int").alias("gy"), "event_type")
    return event_raster(spark, d).join(types, ["gx", "gy"]).groupBy("event_type").agg(*(F.avg(c).alias(c) for c in RGB))


_R6 = lambda df, *keys: df.select(*keys, *(F.round(c, 6).alias(c) for c in RGB))
_TYPES = f"{S.E}, e AS (SELECT event_type, (event_id % 300)::INT AS gx, (event_id // 300)::INT AS gy FROM events), base AS (SELECT event_type, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM p JOIN e USING (gx, gy) GROUP BY event_type)"
_BASE = f"ok AS (SELECT event_type, {', '.join(f'{x} AS {n}' for x, n in zip(S.oklab(), 'lab', strict=True))} FROM base)"
_RGB_OF = ", ".join(f"round({x}, 6) AS {c}" for x, c in zip(S.linear(("l", "a", "b")), RGB, strict=True))
_WHITE = C.oklab_of((1.0, 1.0, 1.0))


@query("fn9_ramp", f"WITH RECURSIVE {_TYPES}, {_BASE}, steps AS (SELECT event_type, i::INT AS i, {', '.join(f'{x} * (1 - i / 6{D}) + {S.n(w)} * (i / 6{D}) AS {x}' for x, w in zip('lab', _WHITE, strict=True))} FROM ok, range(7) t(i)), {S.clipped('steps', 'event_type, i')} SELECT event_type, i, {_RGB_OF} FROM clipped")
def _ramp(spark, d):
    return _R6(palettes.ramp(_means(spark, d), [F.lit(1.0)] * 3, 7), "event_type", "i")


_TURNS = f"""turns AS (SELECT 'monochromatic' AS rule, i, {S.n(0.15)} + {S.n(0.75)} * i / 4 AS nl, 0{D} AS turn FROM range(5) t(i)
 UNION ALL SELECT 'analogous', i, NULL, -pi() / 6 + pi() / 3 * i / 4 FROM range(5) t(i)
 UNION ALL SELECT 'complementary', i, NULL, pi() * (i % 2) FROM range(5) t(i)
 UNION ALL SELECT 'triadic', i, NULL, 2 * pi() / 3 * (i % 3) FROM range(5) t(i)
 UNION ALL SELECT 'split', i, NULL, CASE i % 3 WHEN 0 THEN 0 WHEN 1 THEN pi() - {S.n(0.5)} ELSE pi() + {S.n(0.5)} END FROM range(5) t(i))"""


@query("fn10_harmony", f"WITH RECURSIVE {_TYPES}, {_BASE}, {_TURNS}, lch AS (SELECT event_type, rule, i::INT AS i, coalesce(nl, l) AS l, sqrt(a * a + b * b) AS c, atan2(b, a) + turn AS h FROM ok, turns), steps AS (SELECT event_type, rule, i, l, c * cos(h) AS a, c * sin(h) AS b FROM lch), {S.clipped('steps', 'event_type, rule, i')} SELECT event_type, rule, i, {_RGB_OF} FROM clipped")
def _harmony(spark, d):
    means, found = _means(spark, d), None
    for rule in palettes.HARMONIES:
        one = _R6(palettes.harmony(means, rule, 5).withColumn("rule", F.lit(rule)), "event_type", "rule", "i")
        found = one if found is None else found.unionByName(one)
    return found


@query("fn8_gamut_clip", f"WITH RECURSIVE {S.V}, wide AS (SELECT gx, gy, r AS l, g * {S.n(0.8)} - {S.n(0.4)} AS a, b * {S.n(0.8)} - {S.n(0.4)} AS b FROM p), {S.clipped('wide', 'gx, gy')} SELECT gx, gy, round(l, 6) AS ok_l, round(a, 6) AS ok_a, round(b, 6) AS ok_b FROM clipped")
def _gamut(spark, d):
    lab = [F.col("r"), F.col("g") * 0.8 - 0.4, F.col("b") * 0.8 - 0.4]
    return rasters.vector_raster(spark, d).select("gx", "gy", *(F.round(x, 6).alias(n) for x, n in zip(C.gamut_clip(lab), ("ok_l", "ok_a", "ok_b"), strict=True)))


# --- versions and changes ----------------------------------------------------------------------------------------------


@query("st1_versioned_upsert", f"WITH {TILES} SELECT doc, layer, tx, ty, max(generation) AS generation FROM t GROUP BY ALL")
def _upsert(spark, d):
    return changes.newest(tile_events(spark, d).select(*_KEY, "generation"), _KEY)


@query("st2_late_results", "WITH g AS (SELECT user_id % 3 AS doc, user_id % 5 AS layer, max(event_id % 6) AS doc_generation, max(event_id % 4) AS layer_generation FROM events GROUP BY ALL) SELECT event_id FROM events JOIN g ON g.doc = user_id % 3 AND g.layer = user_id % 5 AND g.doc_generation = event_id % 6 AND g.layer_generation = event_id % 4")
def _late(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("doc"), (F.col("user_id") % 5).alias("layer"), (F.col("event_id") % 6).alias("doc_generation"), (F.col("event_id") % 4).alias("layer_generation"))
    now = e.groupBy("doc", "layer").agg(F.max("doc_generation").alias("doc_generation"), F.max("layer_generation").alias("layer_generation"))
    return changes.current_only(e, now).select("event_id")


@query("st3_ready", "SELECT event_id FROM events WHERE NOT (event_type = 'click') AND event_id % 9 >= user_id % 9")
def _ready(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("event_type") == "click").alias("dirty"), (F.col("event_id") % 9).alias("generation"), (F.col("user_id") % 9).alias("doc_generation"))
    return changes.ready(e).select("event_id")


def _cascade_sql() -> str:
    parts = []
    for kind, rules in changes.CASCADE.items():
        for stage, same_tile, same_layer in rules:
            on = ["c.doc = t.doc", *(["c.tx = t.tx AND c.ty = t.ty"] if same_tile else []), *(["c.layer = t.layer"] if same_layer else [])]
            parts.append(f"SELECT doc, layer, tx, ty, stage FROM t WHERE stage = '{stage}' AND EXISTS (SELECT 1 FROM c WHERE kind = '{kind}' AND {' AND '.join(on)})")
    return f"WITH {TILES}, {CHANGES} " + " UNION ".join(parts)


@query("st4_invalidation", _cascade_sql())
def _invalidation(spark, d):
    return changes.stale(tile_events(spark, d).select(*_KEY, "stage"), change_events(spark, d))


@query("st5_structure", f"WITH {TILES} SELECT DISTINCT doc, layer, tx, ty, stage FROM t WHERE stage = 'composite' AND EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase' AND value > 95)")
def _structure(spark, d):
    e = table(spark, d, "events").where("event_type = 'purchase' AND value > 95")
    return changes.structure_stale(tile_events(spark, d), e.select(F.lit("structure").alias("kind")))


@query("st6_palette_cascade", f"WITH {TILES}, l AS (SELECT DISTINCT e.user_id % 3 AS doc, e.user_id % 5 AS layer FROM events e WHERE EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id % 20 = 0 AND c.user_id % 3 = e.user_id % 3 AND c.user_id % 7 = e.user_id % 7)) SELECT DISTINCT doc, layer, tx, ty, stage FROM t WHERE (stage = 'processed' AND EXISTS (SELECT 1 FROM l WHERE l.doc = t.doc AND l.layer = t.layer)) OR (stage = 'composite' AND EXISTS (SELECT 1 FROM l WHERE l.doc = t.doc))")
def _palette_cascade(spark, d):
    """Tiles that changes of palettes make stale: the clicks of every twentieth user change one of seven palettes."""
    doc, palette = (F.col("user_id") % 3).alias("doc"), (F.col("user_id") % 7).alias("palette")
    e = table(spark, d, "events")
    changed = e.where("event_type = 'click' AND user_id % 20 = 0").select(doc, palette)
    return changes.stale(tile_events(spark, d).select(*_KEY, "stage"), changes.palette_changes(changed, e.select(doc, (F.col("user_id") % 5).alias("layer"), palette)))


_KINDS = "['curves', 'levels', 'dither', 'glow', 'crt', 'adjust', 'warp']"


@query("ag14_min_version", f"WITH f AS (SELECT user_id, {_KINDS}[event_id % 7 + 1] AS kind, CASE WHEN event_id % 13 = 0 THEN 'spiral' ELSE 'wave' END AS mode FROM events) SELECT user_id, CASE max(CASE WHEN kind = 'warp' OR (kind = 'dither' AND mode = 'spiral') THEN 2 WHEN kind = 'adjust' THEN 1 ELSE 0 END) WHEN 2 THEN '0.10.0' WHEN 1 THEN '0.2.0' ELSE '0.1.0' END AS needs FROM f GROUP BY user_id")
def _min_version(spark, d):
    kind = F.expr(f"array({_KINDS[1:-1]})[int(event_id % 7)]")
    mode = F.when(F.col("event_id") % 13 == 0, "spiral").otherwise("wave")
    return params.min_versions(table(spark, d, "events").select("user_id", kind.alias("kind"), mode.alias("mode")), ["user_id"], "0.10.0")


@query("st7_coalesced", "SELECT user_id % 3 AS doc, event_id // 50 AS period, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)::INT AS clear, arg_max(user_id % 5, event_id) AS layer, count(*)::BIGINT AS requests FROM events GROUP BY ALL")
def _coalesced(spark, d):
    e = table(spark, d, "events").select((F.col("user_id") % 3).alias("doc"), F.floor(F.col("event_id") / 50).alias("period"), (F.col("event_type") == "purchase").alias("clear"), (F.col("user_id") % 5).alias("layer"), F.col("event_id").alias("at"))
    return changes.coalesced(e)


@query("st10_snapshot", "SELECT user_id AS doc, max(event_id) AS version FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events) GROUP BY user_id")
def _snapshot(spark, d):
    e = table(spark, d, "events")
    half = e.agg(F.floor(F.max("event_id") / 2)).first()[0]
    return e.where(F.col("event_id") <= half).groupBy(F.col("user_id").alias("doc")).agg(F.max("event_id").alias("version"))


@query("ag13_max_generation", f"WITH {TILES} SELECT doc, max(generation) AS generation FROM t GROUP BY doc")
def _max_generation(spark, d):
    return tile_events(spark, d).groupBy("doc").agg(F.max("generation").alias("generation"))


@query("ag12_tile_counts", f"WITH {TILES} SELECT stage, count(DISTINCT (doc, layer, tx, ty))::BIGINT AS tiles, sum(bytes)::BIGINT AS bytes FROM t GROUP BY stage")
def _counts(spark, d):
    return tile_events(spark, d).groupBy("stage").agg(F.count_distinct(F.struct(*_KEY)).alias("tiles"), F.sum("bytes").alias("bytes"))


@query("st1_stream")
def _stream(spark, d):
    """The events as a stream of files, upserted by batches of one; the table after the last."""
    from pixelloom.plans.store import scratch

    path = scratch(spark, "stream")
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events*").parquet(f"{d}/events.parquet" if _is_folder(spark, f"{d}/events.parquet") else d)
    rows = stream.select((F.col("user_id") % 3).alias("doc"), (F.col("user_id") % 5).alias("layer"), F.col("event_id").alias("generation"), "value")
    batches: list[int] = []
    changes.upsert_stream(rows, f"{path}/table", ["doc", "layer"], f"{path}/checkpoint", then=lambda _, n: batches.append(n)).awaitTermination()
    return changes.upserted(spark, f"{path}/table", rows.schema, max(batches, default=-1) + 1, ["doc", "layer"])


SQL["st1_stream"] = "SELECT user_id % 3 AS doc, user_id % 5 AS layer, max(event_id) AS generation, arg_max(value, event_id) AS value FROM events GROUP BY ALL"


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
