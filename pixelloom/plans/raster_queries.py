"""Registered queries of the raster operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.functions import grid as G
from pixelloom.operators import compose, ordered, palettes, params, point, tiles
from pixelloom.plans import raster_sql as S
from pixelloom.sources.rasters import PALETTE5, event_raster, mirrored, table, vector_raster

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


def out(df: DataFrame) -> DataFrame:
    keys = [c for c in ("gx", "gy") if c in df.columns]
    return df.select(*keys, *(F.round(c, 6).alias(c) for c in "rgba"))


def cols(*names):
    return [F.col(n) for n in names]


def on_events(name: str, f: Callable[[DataFrame], DataFrame], sql: str) -> None:
    query(name, f"WITH {S.E} {sql}")(lambda spark, d: out(f(event_raster(spark, d))))


# --- point operators ---------------------------------------------------------------------------------------------------

CURVE = [(0.25, 0.15), (0.75, 0.9)]


def _curve_sql() -> str:
    """The curve as a table built by SQL: Catmull-Rom segments at 4,096 places, then straight lines."""
    pts = point.curve_points(CURVE)
    cases = []
    for i in range(len(pts) - 1):
        (x1, y1), (x2, y2) = pts[i], pts[i + 1]
        y0, y3 = pts[max(i - 1, 0)][1], pts[min(i + 2, len(pts) - 1)][1]
        t = f"((x - {S.n(x1)}) / {S.n(x2 - x1)})"
        v = f"({S.n(-0.5 * y0 + 1.5 * y1 - 1.5 * y2 + 0.5 * y3)} * pow({t}, 3) + {S.n(y0 - 2.5 * y1 + 2 * y2 - 0.5 * y3)} * pow({t}, 2) + {S.n(-0.5 * y0 + 0.5 * y2)} * {t} + {S.n(y1)})"
        cases.append(f"WHEN x < {S.n(x2)} THEN {v}" if i < len(pts) - 2 else f"ELSE {v}")
    curve = S.clamp(f"CASE WHEN x < {S.n(1e-3)} THEN 0 WHEN x > {S.n(1 - 1e-3)} THEN 1 {' '.join(cases)} END")
    lut = f"g AS (SELECT i, i{D} / 4095 AS x FROM range(4096) t(i)), lut AS (SELECT list({curve} ORDER BY i) AS y FROM g)"
    at = lambda c: f"(y[floor({c} * 4095)::INT + 1] * (1 - ({c} * 4095 - floor({c} * 4095))) + y[least(floor({c} * 4095)::INT + 1, 4095) + 1] * ({c} * 4095 - floor({c} * 4095)))"
    return f"WITH {S.E}, {lut} " + S.rows(*(at(c) for c in RGB), source="p, lut")


query("pt1_curves", _curve_sql())(lambda spark, d: out(point.curves(event_raster(spark, d), CURVE)))
_LEVEL = lambda c: f"({S.n(0.1)} + pow({S.clamp(f'({c} - {S.n(0.2)}) / {S.n(0.9 - 0.2)}')}, {S.n(1 / 1.5)}) * {S.n(0.95 - 0.1)})"
on_events("pt2_levels", lambda p: point.levels(p, 0.2, 0.9, 1.5, 0.1, 0.95), S.rows(*(_LEVEL(c) for c in RGB)))


def _adjust_sql() -> str:
    tone = [S.clamp(f"({c} - {S.n(0.5)}) * {S.n(1.3)} + {S.n(0.5)} + {S.n(-0.05)}") + f" AS {c}" for c in RGB]
    sat = [f"CASE WHEN a <= {S.n(1e-6)} THEN 0 ELSE {S.clamp(f'{S.luma()} + ({c} - {S.luma()}) * {S.n(1.8)}')} END" for c in RGB]
    return f", t AS (SELECT gx, gy, {', '.join(tone)}, a FROM p) " + S.rows(*sat, source="t")


on_events("pt3_adjust", lambda p: point.adjust(p, -0.05, 0.3, 0.4), _adjust_sql())
_U = "4294967296"
_NOISE = f"""n1 AS (SELECT *, ((floor((gx + 2){D} / 4)::HUGEINT * 374761393 % {_U} + floor((gy + 2){D} / 4)::HUGEINT * 668265263 % {_U}) % {_U})::UBIGINT AS h FROM p),
n2 AS (SELECT *, ((xor(h, h >> 13))::HUGEINT * 1274126177 % {_U})::UBIGINT AS h2 FROM n1),
n3 AS (SELECT *, (xor(h2, h2 >> 16)){D} / 4294967295{D} * 2 - 1 AS u FROM n2)"""
on_events("pt4_noise", lambda p: point.noise(p, 0.2), f", {_NOISE} " + S.rows(*(S.clamp(f"{c} + u * {S.n(0.2)}") for c in RGB), source="n3"))
on_events("pt5_crt", lambda p: point.crt(p, 3, 0.4, 0.3), S.rows(*(S.clamp(f"{c} * (CASE WHEN gy % 3 < 1 THEN {S.n(0.6)} ELSE 1{D} END) * (CASE WHEN gx % 3 <> {i} THEN {S.n(0.7)} ELSE 1{D} END)") for i, c in enumerate(RGB))))
on_events("pt6_placeholder", lambda p: p, S.rows())


def _half_blend(p: DataFrame) -> DataFrame:
    return point.with_blend(p, lambda x: point.crt(x, 3, 0.4, 0.3), "multiply", 0.5)


_CRT = [S.clamp(f"{c} * (CASE WHEN gy % 3 < 1 THEN {S.n(0.6)} ELSE 1{D} END) * (CASE WHEN gx % 3 <> {i} THEN {S.n(0.7)} ELSE 1{D} END)") + f" AS {c}" for i, c in enumerate(RGB)]
on_events("pt7_filter_blend", _half_blend, f", f AS (SELECT gx, gy, {', '.join(_CRT)}, a FROM p) " + S.rows(*S.over("multiply", "f", "p", 0.5), source="f JOIN p USING (gx, gy)"))
on_events("pt8_luminance", lambda p: point.set_rgb(p, [C.luma(tuple(cols(*RGB)))] * 3), S.rows(*[S.luma()] * 3))
on_events("pt9_premultiply", lambda p: point.unpremultiplied(point.premultiplied(p)), S.rows(*(f"CASE WHEN a <= {S.n(1e-6)} THEN 0 ELSE {S.clamp(f'({c} * a) / a')} END" for c in RGB)))


@query("pt10_legacy_dither", f"WITH {S.E} " + S.rows(*(f"CASE WHEN a <= t THEN 0 ELSE {S.quantise(c, 't', 8)} END" for c in RGB), "CASE WHEN a > t THEN 1 ELSE 0 END", source=f"(SELECT *, {S.bayer(8, 'gx', 'gy')} AS t FROM p)"))
def _legacy(spark, d):
    return out(ordered.dither(event_raster(spark, d), ordered.legacy(3, "Bayer8x8")))


_NAMES = [*params.LIMITS, "unknown"]
_PARAMS = f"w AS (SELECT event_id, [{', '.join(f"'{x}'" for x in _NAMES)}][event_id % {len(_NAMES)} + 1] AS name, CASE WHEN event_id % 50 = 7 THEN NULL ELSE value / 10 - 1 END AS value FROM events), k(name, low, high) AS (VALUES {', '.join(f"('{x}', {S.n(low)}, {S.n(high)})" for x, (low, high) in params.LIMITS.items())})"


@query("pt11_validation", f"WITH {_PARAMS} SELECT event_id, name, CASE WHEN low IS NULL THEN 'name' WHEN value IS NULL THEN 'not a number' ELSE 'range' END AS reason FROM w LEFT JOIN k USING (name) WHERE low IS NULL OR value IS NULL OR value < low OR value > high")
def _validation(spark, d):
    """Each event as a filter's parameter: those that a filter must refuse."""
    e = table(spark, d, "events")
    name = F.element_at(F.array(*(F.lit(x) for x in _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    asked = e.select("event_id", name.alias("name"), F.when(F.col("event_id") % 50 != 7, F.col("value") / 10 - 1).alias("value"))
    return params.violations(asked).select("event_id", "name", "reason")


_LOOSE = "CASE event_id % 4 WHEN 0 THEN '{}' WHEN 1 THEN '{\"intensity\": ' || value || '}' WHEN 2 THEN '{\"radius\": 1.5, \"other\": 1}' ELSE '{\"intensity\": 2, \"threshold\": ' || value / 100 || '}' END"


@query("pt12_defaults", f"WITH j AS (SELECT event_id, ({_LOOSE})::JSON AS j FROM events) SELECT event_id, {', '.join(f"round(coalesce((j->>'{n}')::DOUBLE, {S.n(v)}), 6) AS {n}" for n, v in params.DEFAULTS['glow'].items())} FROM j")
def _defaults(spark, d):
    """Parameters of a glow, of which each event's text gives some."""
    text = F.expr(_LOOSE)
    found = params.with_defaults("glow", F.col("j"))
    return table(spark, d, "events").select("event_id", text.alias("j")).select("event_id", *(F.round(x, 6).alias(n) for n, x in found.items()))


# --- ordered dithering -------------------------------------------------------------------------------------------------


def dithered(t: str, rgb, source: str = "p", before: str = "", keep_alpha: bool = False) -> str:
    clear = [f"CASE WHEN a <= t THEN 0{D} ELSE {x} END" for x in rgb] if not keep_alpha else rgb
    return f"{before} " + S.rows(*clear, "a" if keep_alpha else f"CASE WHEN a > t THEN 1{D} ELSE 0{D} END", source=f"(SELECT *, {t} AS t FROM {source})")


for _n in (2, 4, 8):
    on_events(f"od1_bayer{_n}", lambda p, n=_n: ordered.dither(p, ordered.Dither(mode=f"bayer{n}", levels=4)), dithered(S.bayer(_n, "gx", "gy"), [S.quantise(c, "t", 4) for c in RGB]))
_MAP = ((0.1, 0.6, 0.35), (0.85, 0.25, 0.5))
on_events("od2_threshold_map", lambda p: ordered.dither(p, ordered.Dither(mode="map", threshold_map=_MAP, levels=3)), dithered(f"[{', '.join(S.n(v) for row in _MAP for v in row)}][(gy % 2) * 3 + gx % 3 + 1]", [S.quantise(c, "t", 3) for c in RGB]))
_T = 0.5235987755982988
_WAVE = S.clamp(f"{S.n(0.5)} + sin((gx * cos({S.n(_T)}) + gy * sin({S.n(_T)})) * {S.n(6.283185307179586 / 7.3)} + {S.n(0.4)}) * {S.n(0.5 * 0.83)}", 0.0, 0.999999)
on_events("od3_wave", lambda p: ordered.dither(p, ordered.Dither(mode="wave", levels=5, wavelength=7.3, amplitude=0.83, phase=0.4, angle=30.0)), dithered(_WAVE, [S.quantise(c, "t", 5) for c in RGB]))


def _halftone_sql() -> str:
    import math

    k = f"({S.n(1.0)} - greatest(r, g, b))"
    tones = [f"(CASE WHEN {k} >= {S.n(1 - 1.1920929e-07)} THEN 0{D} ELSE {S.clamp(f'(1{D} - {c} - {k}) / (1{D} - {k})')} END)" for c in RGB] + [f"(CASE WHEN {k} >= {S.n(1 - 1.1920929e-07)} THEN 1{D} ELSE {S.clamp(k)} END)"]
    inks, cell = [], 6.1
    for tone, angle in zip(tones, (15.0, 75.0, 0.0, 45.0), strict=True):
        c, s = S.n(math.cos(math.radians(angle))), S.n(math.sin(math.radians(angle)))
        u, v = f"(gx * {c} + gy * {s})", f"(gy * {c} - gx * {s})"
        u, v = (f"({x} - floor({x} / {S.n(cell)}) * {S.n(cell)} - {S.n(cell / 2)})" for x in (u, v))
        inks.append(f"(CASE WHEN sqrt({u} * {u} + {v} * {v}) <= sqrt({S.clamp(f'{tone} + {S.n(0.03)}')}) * {S.n(cell / 2 * 0.97)} THEN 1{D} ELSE 0{D} END)")
    return S.rows(*(f"1{D} - least(1{D}, {x} + {inks[3]})" for x in inks[:3]))


on_events("od4_halftone", lambda p: ordered.halftone(p, 6.1, 0.97, 0.03), _halftone_sql())
_RX, _RY = S.rotation(33.0)
on_events("od5_rotated_bayer", lambda p: ordered.dither(p, ordered.Dither(mode="bayer4", levels=4, angle=33.0)), dithered(S.bayer4("u", "v"), [S.quantise(c, "t", 4) for c in RGB], source=f"(SELECT *, {_RX} AS u, {_RY} AS v FROM p)"))
_BLOCK = f", k AS (SELECT gx, gy, {', '.join(f'first_value({c}) OVER w AS {c}' for c in 'rgba')} FROM p WINDOW w AS (PARTITION BY gx // 4, gy // 4 ORDER BY gy, gx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
on_events("od6_pattern_blocks", lambda p: ordered.dither(p, ordered.Dither(mode="bayer4", levels=4, pixel_size=4)), dithered(S.bayer4("(gx // 4)", "(gy // 4)"), [S.quantise(c, "t", 4) for c in RGB], source="k", before=_BLOCK))
on_events("od7_bias", lambda p: ordered.dither(p, ordered.Dither(mode="bayer4", levels=4, bias=0.21)), dithered(S.clamp(f"{S.bayer4('gx', 'gy')} + {S.n(0.21)}", 0.0, 0.999999), [S.quantise(c, "t", 4) for c in RGB]))
on_events("od8_quantise", lambda p: point.set_rgb(p, [ordered.quantise(F.col(c), F.lit(0.5), 6, 1.0) for c in RGB]), S.rows(*(S.quantise(c, S.n(0.5), 6) for c in RGB)))
on_events("od9_mega_pixels", lambda p: ordered.block_sources(p, 4), f"{_BLOCK} " + S.rows(source="k"))
on_events("od10_grayscale", lambda p: ordered.dither(p, ordered.Dither(mode="bayer8", levels=5, grayscale=True)), dithered(S.bayer(8, "gx", "gy"), [S.quantise(S.luma(), "t", 5)] * 3))
on_events("od15_alpha_kept", lambda p: ordered.dither(p, ordered.Dither(mode="bayer4", levels=4, dither_alpha=False)), f"{S.rows(*(f'CASE WHEN a <= 0 THEN 0{D} ELSE {S.quantise(c, S.bayer4("gx", "gy"), 4)} END' for c in RGB))}")

_PAL_LAB = [C.oklab_of(c) for c in PALETTE5]


def _labs(palette) -> str:
    return f"lab(i, x, y, z) AS (VALUES {', '.join(f'({i}, {S.n(x)}, {S.n(y)}, {S.n(z)})' for i, (x, y, z) in enumerate(C.oklab_of(c) for c in palette))})"


_LABS = _labs(PALETTE5)


def _strict_sql(rgb, source: str, scale: float) -> str:
    lab = S.oklab(*rgb)
    return f""", {S.palette(PALETTE5)}, {_LABS},
c AS (SELECT gx, gy, a, t, {lab[0]} AS lx, {lab[1]} AS ly, {lab[2]} AS lz FROM (SELECT *, {S.bayer4('gx', 'gy')} AS t FROM {source})),
n AS (SELECT gx, gy, a, t, i, (lx - x) * (lx - x) + (ly - y) * (ly - y) + (lz - z) * (lz - z) AS d FROM c, lab),
k AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY d, i) AS n FROM n),
w AS (SELECT gx, gy, any_value(a) AS a, any_value(t) AS t, min(d) FILTER (n = 1) AS d1, min(d) FILTER (n = 2) AS d2, min(i) FILTER (n = 1) AS i1, min(i) FILTER (n = 2) AS i2 FROM k WHERE n <= 2 GROUP BY gx, gy),
s AS (SELECT gx, gy, a, t, CASE WHEN {S.n(0.5)} + (t - {S.n(0.5)}) * {S.n(scale)} < (CASE WHEN d1 + d2 <= {S.n(1.1920929e-07)} THEN 0 ELSE sqrt(d1) / (sqrt(d1) + sqrt(d2)) END) THEN i2 ELSE i1 END AS i FROM w)
""" + S.rows(*(f"CASE WHEN s.a <= t THEN 0{D} ELSE pal.{c} END" for c in RGB), f"CASE WHEN s.a > t THEN 1{D} ELSE 0{D} END", source="s JOIN pal USING (i)")


on_events("od11_palette_strict", lambda p: ordered.dither(p, ordered.Dither(palette=tuple(PALETTE5), palette_mode="strict", scale=0.9)), _strict_sql(RGB, "p", 0.9))


def _guided(c: str, levels: int, scale: float) -> str:
    q = f"({S.clamp(c)} * {S.n(levels - 1)})"
    return f"(least(floor({q}) + (CASE WHEN {q} - floor({q}) > {S.n(0.5)} + (t - {S.n(0.5)}) * {S.n(scale)} THEN 1{D} ELSE 0{D} END), {S.n(levels - 1)}) / {S.n(levels - 1)})"


on_events("od12_palette_guided", lambda p: ordered.dither(p, ordered.Dither(palette=tuple(PALETTE5), palette_mode="guided", channel_levels=3, scale=0.9)), dithered(S.bayer4("gx", "gy"), [_guided(c, 3, 0.9) for c in RGB]))
_MIX = f"(SELECT gx, gy, a, {', '.join(f'{_guided(c, 3, 0.9)} AS {c}' for c in RGB)} FROM (SELECT *, {S.bayer4('gx', 'gy')} AS t FROM p))"
on_events("od13_palette_mixed", lambda p: ordered.dither(p, ordered.Dither(palette=tuple(PALETTE5), palette_mode="mixed", channel_levels=3, scale=0.9)), _strict_sql(RGB, _MIX, 0.9))


def _simple_sql() -> str:
    at = [S.clamp(f"{S.to_srgb(c)}{D} + (t - {S.n(0.5)}) * {S.n(0.9 * 64)}", 0, 255) for c in RGB]
    dist = " + ".join(f"(m{c} - pal.{c} * 255) * (m{c} - pal.{c} * 255)" for c in RGB)
    return f""", {S.palette(PALETTE5)}, m AS (SELECT gx, gy, a, t, {', '.join(f'{x} AS m{c}' for x, c in zip(at, RGB, strict=True))} FROM (SELECT *, {S.bayer4('gx', 'gy')} AS t FROM p)),
k AS (SELECT gx, gy, m.a, t, pal.r, pal.g, pal.b, row_number() OVER (PARTITION BY gx, gy ORDER BY {dist}, i) AS n FROM m, pal)
""" + S.rows(*(f"CASE WHEN a <= t THEN 0{D} ELSE {c} END" for c in RGB), f"CASE WHEN a > t THEN 1{D} ELSE 0{D} END", source="k WHERE n = 1")


on_events("od14_palette_simple", lambda p: ordered.dither(p, ordered.Dither(palette=tuple(PALETTE5), palette_mode="simple", scale=0.9)), _simple_sql())


def _lut_sql(raster: str, palette=tuple(PALETTE5)) -> str:
    lab = S.oklab()
    snap = []
    for x, low, high in zip(lab, (0.0, -0.4, -0.4), (1.0, 0.4, 0.4), strict=True):
        t = S.clamp(f"({x} - {S.n(low)}) / {S.n(high - low)}", 0.0, 1 - 1.1920929e-07)
        snap.append(f"{S.n(low)} + (least(floor({t} * 64), 63) + {S.n(0.5)}) / 64 * {S.n(high - low)}")
    return f"""WITH {raster}, {S.palette(palette)}, {_labs(palette)}, c AS (SELECT gx, gy, a, {', '.join(f'{x} AS l{k}' for x, k in zip(snap, 'xyz', strict=True))} FROM p),
k AS (SELECT gx, gy, a, i, row_number() OVER (PARTITION BY gx, gy ORDER BY (lx - x) * (lx - x) + (ly - y) * (ly - y) + (lz - z) * (lz - z), i) AS n FROM c, lab)
""" + S.rows("pal.r", "pal.g", "pal.b", "k.a", source="k JOIN pal USING (i) WHERE n = 1")


query("ed10_palette_nearest", _lut_sql(S.V))(lambda spark, d: out(ordered.lut_nearest(vector_raster(spark, d), PALETTE5)))


# --- functions ---------------------------------------------------------------------------------------------------------


def each(name: str, raster: str, make, sql: dict[str, str]) -> None:
    source = {"E": event_raster, "V": vector_raster}[raster]
    text = f"WITH {getattr(S, raster)} SELECT gx, gy, " + ", ".join(f"{x} AS {c}" for c, x in sql.items()) + " FROM p"
    query(name, text)(lambda spark, d: source(spark, d).select("gx", "gy", *(x.alias(c) for c, x in zip(sql, make(*cols(*RGB)), strict=True))))


_R6 = lambda xs: [F.round(x, 6) for x in xs]
_BYTE = f"(floor({{}} * 255{D} + 0.5{D}))"
each("fn1_srgb_to_linear", "E", lambda *c: _R6(C.srgb_to_linear(C.rounded(x * 255.0)) for x in c), {f"l{c}": f"round(CASE WHEN {_BYTE.format(c)} / 255 <= {S.n(0.04045)} THEN {_BYTE.format(c)} / 255 / {S.n(12.92)} ELSE pow(({_BYTE.format(c)} / 255 + {S.n(0.055)}) / {S.n(1.055)}, {S.n(2.4)}) END, 6)" for c in RGB})
each("fn2_linear_to_srgb", "V", lambda *c: [C.linear_to_srgb(x) for x in c], {f"s{c}": S.to_srgb(c) for c in RGB})
each("fn3_linear_to_oklab", "V", lambda *c: _R6(C.linear_to_oklab(c)), dict(zip(("ok_l", "ok_a", "ok_b"), (f"round({x}, 6)" for x in S.oklab()), strict=True)))
each("fn4_oklab_to_linear", "V", lambda *c: _R6(C.oklab_to_linear([c[0], c[1] * 0.4 - 0.2, c[2] * 0.4 - 0.2])), dict(zip(RGB, (f"round({x}, 6)" for x in S.linear(("r", f"(g * {S.n(0.4)} - {S.n(0.2)})", f"(b * {S.n(0.4)} - {S.n(0.2)})"))), strict=True)))
_WHITE = C.oklab_of((1, 1, 1))
each("fn5_oklab_distance", "V", lambda *c: _R6([C.distance2(C.linear_to_oklab(c), [F.lit(v) for v in _WHITE])]), {"d2": f"round({' + '.join(f'pow({x} - {S.n(w)}, 2)' for x, w in zip(S.oklab(), _WHITE, strict=True))}, 6)"})
each("fn6_oklch", "V", lambda *c: _R6(C.oklab_to_oklch(C.linear_to_oklab(c))), {"l": f"round({S.oklab()[0]}, 6)", "c": f"round(sqrt(pow({S.oklab()[1]}, 2) + pow({S.oklab()[2]}, 2)), 6)", "h": f"round(atan2({S.oklab()[2]}, {S.oklab()[1]}), 6)"})
_WIDE = ("r", f"(g * {S.n(0.8)} - {S.n(0.4)})", f"(b * {S.n(0.8)} - {S.n(0.4)})")
each("fn7_out_of_gamut", "V", lambda *c: [C.out_of_gamut([c[0], c[1] * 0.8 - 0.4, c[2] * 0.8 - 0.4])], {"bad": "(" + " OR ".join(f"{x} < {S.n(-1e-4)} OR {x} > {S.n(1 + 1e-4)}" for x in S.linear(_WIDE, False)) + ")"})
each("fn15_cmyk", "V", lambda *c: _R6(C.rgb_to_cmyk(c)), {**{k: f"round(CASE WHEN 1{D} - greatest(r, g, b) >= {S.n(1 - 1.1920929e-07)} THEN 0 ELSE {S.clamp(f'(1{D} - {c} - (1{D} - greatest(r, g, b))) / (1{D} - (1{D} - greatest(r, g, b)))')} END, 6)" for k, c in zip(("cyan", "magenta", "yellow"), RGB, strict=True)}, "black": f"round(1{D} - greatest(r, g, b), 6)"})
each("fn11_hex", "E", lambda *c: [C.bytes_to_hex(*(C.to_u8(x) for x in c)), C.hex_to_bytes(C.bytes_to_hex(*(C.to_u8(x) for x in c)))[0]], {"hex": "format('#{:02X}{:02X}{:02X}', " + ", ".join(f"floor({c} * 255 + 0.5{D})::INT" for c in RGB) + ")", "red": f"floor(r * 255 + 0.5{D})::INT"})
each("fn14_guided_channel", "V", lambda *c: _R6([ordered.quantise_guided(c[0], F.lit(0.4), 0.1, 0.9, 5)]), {"q": f"round({S.n(0.1)} + least(floor({S.clamp(f'(r - {S.n(0.1)}) / {S.n(0.9 - 0.1)}')} * 4) + (CASE WHEN {S.clamp(f'(r - {S.n(0.1)}) / {S.n(0.9 - 0.1)}')} * 4 - floor({S.clamp(f'(r - {S.n(0.1)}) / {S.n(0.9 - 0.1)}')} * 4) > {S.n(0.5 + (0.4 - 0.5) * 1.0)} THEN 1{D} ELSE 0{D} END), 4{D}) / 4 * {S.n(0.9 - 0.1)}, 6)"})
each("snk9_u8", "E", lambda *c: [C.to_u8(x, m) for x in c for m in ("preview", "export")], {f"{m}_{c}": f"floor({S.clamp(c)} * 255{h})::INT" for c in RGB for m, h in (("preview", f" + 0.5{D}"), ("export", ""))})


@query("fn13_blend_modes", f"WITH {S.E}, {S.L2}, j AS (SELECT gx, gy, p.r AS s, q.r AS d FROM p JOIN q USING (gx, gy)) SELECT gx, gy, " + ", ".join(f"round({S.blend(m, 's', 'd')}, 6) AS {m}" for m in C.BLEND_MODES) + " FROM j")
def _blends(spark, d):
    p = event_raster(spark, d)
    j = p.select("gx", "gy", F.col("r").alias("s")).join(mirrored(p).select("gx", "gy", F.col("r").alias("d")), ["gx", "gy"])
    return j.select("gx", "gy", *(F.round(C.blend_mode(m, F.col("s"), F.col("d")), 6).alias(m) for m in C.BLEND_MODES))


@query("fn16_euclid", f"SELECT event_id, (((event_id - 500) % 8 + 8) % 8)::BIGINT AS m, floor((event_id - 500){D} / 8)::BIGINT AS q, (floor((event_id - 500){D} / 16) * 16)::BIGINT AS origin FROM events")
def _euclid(spark, d):
    x = F.col("event_id") - 500
    return table(spark, d, "events").select("event_id", G.emod(x, 8).cast("long").alias("m"), G.ediv(x, 8).alias("q"), G.aligned(x, 16).cast("long").alias("origin"))


each("fn17_hash01", "E", lambda *_: _R6([G.hash01(G.ediv(F.col("gx") + 2, 4), G.ediv(F.col("gy") + 2, 4))]), {"h": "0"})
SQL["fn17_hash01"] = f"WITH {S.E}, {_NOISE} SELECT gx, gy, round((xor(h2, h2 >> 16)){D} / 4294967295{D}, 6) AS h FROM n3"
_M64 = "18446744073709551616"


# --- stencils ----------------------------------------------------------------------------------------------------------

T = 32  # a small tile, so that the rasters have seams


def in_tiles(f: Callable[[DataFrame], DataFrame]):
    def run(spark, d):
        p = event_raster(spark, d)
        height = p.agg(F.max("gy")).first()[0] + 1
        return out(tiles.core(f(tiles.decompose(p, 300, height, T)), 300, height))

    return run


_TILES = f"""h AS (SELECT max(gy) + 1 AS height FROM p), t AS (SELECT tx, ty FROM range(10) a(tx), (SELECT unnest(range(ceil(height{D} / {T})::BIGINT)) AS ty FROM h)),
f AS (SELECT tx, ty, lx, ly, tx * {T} + lx - 2 AS gx, ty * {T} + ly - 2 AS gy, lx BETWEEN 2 AND {T + 1} AND ly BETWEEN 2 AND {T + 1} AS is_core FROM t, range({T + 4}) c(lx), range({T + 4}) d(ly)),
z AS (SELECT f.*, {', '.join(f'coalesce(p.{c}, 0) AS {c}' for c in 'rgba')} FROM f LEFT JOIN p ON p.gx = f.gx AND p.gy = f.gy)"""
_CORE = "WHERE is_core AND gx < 300 AND gy < (SELECT height FROM h)"


def _tile_rows(r="r", g="g", b="b", a="a", source="z") -> str:
    return S.rows(r, g, b, a, source=f"{source} {_CORE}", keys="gx::INT AS gx, gy::INT AS gy")


def _box(source: str, target: str, names, radius: int) -> str:
    side, w = T + 4, 2 * radius + 1
    step = lambda src, dst, along, across: f"{dst} AS (SELECT * REPLACE (" + ", ".join(f"(sum({c}) OVER (PARTITION BY tx, ty, {across} ORDER BY {along} ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) + greatest(0, {radius} - {along}) * first_value({c}) OVER w + greatest(0, {along} + {radius} - {side - 1}) * last_value({c}) OVER w) / {w}{D} AS {c}" for c in names) + f") FROM {src} WINDOW w AS (PARTITION BY tx, ty, {across} ORDER BY {along} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"
    return step(source, f"{target}_x", "lx", "ly") + ", " + step(f"{target}_x", target, "ly", "lx")


query("src4_decompose", f"WITH {S.E}, {_TILES} SELECT tx::BIGINT AS tx, ty::BIGINT AS ty, lx::INT AS lx, ly::INT AS ly, gx::INT AS gx, gy::INT AS gy, is_core, round(r, 6) AS r, round(a, 6) AS a FROM z")(
    lambda spark, d: tiles.decompose(p := event_raster(spark, d), 300, p.agg(F.max("gy")).first()[0] + 1, T).select("tx", "ty", "lx", "ly", "gx", "gy", "is_core", F.round("r", 6).alias("r"), F.round("a", 6).alias("a"))
)
_PM = "m AS (SELECT * REPLACE (r * a AS r, g * a AS g, b * a AS b) FROM z)"
query("nb1_box_blur", f"WITH {S.E}, {_TILES}, {_PM}, {_box('m', 'k', 'rgba', 3)} " + _tile_rows(*(f"CASE WHEN a <= {S.n(1e-6)} THEN 0 ELSE {S.clamp(f'{c} / a')} END" for c in RGB), source="k"))(in_tiles(lambda t: tiles.blur(t, 0.25, T)))
query("nb2_unsharp", f"WITH {S.E}, {_TILES}, o AS (SELECT *, r AS o_r, g AS o_g, b AS o_b FROM z), {_box('o', 'k', RGB, 2)} " + _tile_rows(*(S.clamp(f"o_{c} + (o_{c} - {c}) * {S.n(1.5 * 0.6)}") for c in RGB), source="k"))(in_tiles(lambda t: tiles.unsharp(t, 0.6, 2, T)))
_GLOW = ", ".join(f"CASE WHEN {S.luma()} >= {S.n(0.55)} THEN {c} ELSE 0{D} END AS m_{c}" for c in RGB)
query("nb3_glow", f"WITH {S.E}, {_TILES}, o AS (SELECT *, {_GLOW} FROM z), {_box('o', 'k', tuple(f'm_{c}' for c in RGB), 2)} " + _tile_rows(*(S.clamp(f"{c} + m_{c} * {S.n(0.8)}") for c in RGB), source="k"))(in_tiles(lambda t: tiles.glow(t, 0.55, 2, 0.8, T)))

_MUL = lambda x, k: f"((({x}::HUGEINT * {k >> 32} % 4294967296 + 4294967296) % 4294967296 * 4294967296 + {x}::HUGEINT * {k & 0xFFFFFFFF}) % {_M64} + {_M64}) % {_M64}"


def _draws(x: str, y: str, count: int, source: str) -> str:
    """Relations d1..dn: source with the numbers u1..un of the generator at (x, y), as 0 to 1; each step is a column once."""
    text = [f"e0 AS MATERIALIZED (SELECT *, ({_MUL(x, G.GLITCH_X)})::UBIGINT AS mx_, ({_MUL(y, G.GLITCH_Y)})::UBIGINT AS my_ FROM {source})"]
    text.append("e1 AS MATERIALIZED (SELECT * EXCLUDE (mx_, my_), xor(xor(7::UBIGINT, mx_), my_) AS s FROM e0)")
    text.append("d0 AS (SELECT * REPLACE (CASE WHEN s = 0 THEN 1::UBIGINT ELSE s END AS s) FROM e1)")
    for k in range(1, count + 1):
        text.append(f"a{k} AS MATERIALIZED (SELECT * REPLACE (xor(s, (s::HUGEINT * 8192 % {_M64})::UBIGINT) AS s) FROM d{k - 1})")
        text.append(f"b{k} AS MATERIALIZED (SELECT * REPLACE (xor(s, s >> 7) AS s) FROM a{k})")
        text.append(f"c{k} AS MATERIALIZED (SELECT * REPLACE (xor(s, (s::HUGEINT * 131072 % {_M64})::UBIGINT) AS s) FROM b{k})")
        text.append(f"d{k} AS MATERIALIZED (SELECT *, (s >> 32){D} / 4294967295{D} AS u{k} FROM c{k})")
    return ", ".join(text)


_OFF = lambda u: f"least(greatest(sign(({u} - {S.n(0.5)}) * 2 * {S.n(2 * 0.8)}) * floor(abs(({u} - {S.n(0.5)}) * 2 * {S.n(2 * 0.8)}) + 0.5{D}), -2), 2)::INT"
# One draw a pixel of the image, and one list a row of a tile to look shifted places up in.
query("nb4_glitch_shift", f"WITH {S.E}, {_TILES}, c AS (SELECT * FROM z WHERE is_core AND gx < 300 AND gy < (SELECT height FROM h)), {_draws('gx', 'gy', 3, 'c')}, l AS (SELECT tx, ty, ly, list(r ORDER BY lx) AS rs, list(g ORDER BY lx) AS gs, list(b ORDER BY lx) AS bs FROM z GROUP BY ALL), w AS (SELECT d3.*, {', '.join(f'least(greatest(lx + {_OFF(f"u{k}")}, 0), {T + 3}) AS l{k}' for k in (1, 2, 3))} FROM d3) " + S.rows("rs[l1 + 1]", "gs[l2 + 1]", "bs[l3 + 1]", "a", keys="gx::INT AS gx, gy::INT AS gy", source="w JOIN l USING (tx, ty, ly)"))(
    in_tiles(lambda t: tiles.glitch_shift(t, 0.8, 7, tile=T))
)
_BX, _BY = f"(floor(gx{D} / 16) * 16)::BIGINT", f"(floor(gy{D} / 16) * 16)::BIGINT"
# One draw a block.
query("nb5_glitch_blocks", f"WITH {S.E}, {_TILES}, k AS (SELECT *, {_BX} AS kx, {_BY} AS ky FROM z), fk AS (SELECT DISTINCT kx, ky FROM k), {_draws('kx', 'ky', 2, 'fk')}, m AS (SELECT tx, ty, lx + {_OFF('u1')} AS mx, ly + {_OFF('u2')} AS my, arg_max({{'r': r, 'g': g, 'b': b, 'a': a}}, ly * 1000 + lx) AS v FROM k JOIN d2 USING (kx, ky) GROUP BY ALL) " + _tile_rows(*(f"coalesce(v.{c}, {c})" for c in "rgba"), source="z LEFT JOIN m ON m.tx = z.tx AND m.ty = z.ty AND m.mx = z.lx AND m.my = z.ly"))(
    in_tiles(lambda t: tiles.glitch_blocks(t, 0.8, 7))
)
SQL["nb5_glitch_blocks"] = SQL["nb5_glitch_blocks"].replace("FROM z LEFT JOIN m", "FROM (SELECT z.*, m.v FROM z LEFT JOIN m").replace(f"m.my = z.ly {_CORE}", f"m.my = z.ly) {_CORE}")
query("nb6_xorshift", f"WITH {S.E}, {_draws('gx', 'gy', 2, 'p')} SELECT gx, gy, round(u1, 6) AS u1, round(u2, 6) AS u2 FROM d2")(
    lambda spark, d: event_raster(spark, d).withColumn("s1", G.xorshift_step(G.xorshift_state(F.col("gx"), F.col("gy"), 7))).withColumn("s2", G.xorshift_step(F.col("s1"))).select("gx", "gy", F.round(G.xorshift_unit(F.col("s1")), 6).alias("u1"), F.round(G.xorshift_unit(F.col("s2")), 6).alias("u2"))
)


# --- layers, pyramids, palettes ----------------------------------------------------------------------------------------

_OVER1 = S.over("multiply", "q", "b0", 0.7)


@query("ag1_composite", f"WITH {S.E}, {S.L2}, z0 AS (SELECT gx, gy, 0{D} AS r, 0{D} AS g, 0{D} AS b, 0{D} AS a FROM p), b0 AS (SELECT gx, gy, {', '.join(f'{x} AS {c}' for x, c in zip(S.over('normal', 'p', 'z0'), 'rgba', strict=True))} FROM p JOIN z0 USING (gx, gy)), o AS (SELECT b0.gx, b0.gy, {', '.join(f'CASE WHEN q.gx IS NULL THEN b0.{c} ELSE {x} END AS {c}' for x, c in zip(_OVER1, 'rgba', strict=True))} FROM b0 LEFT JOIN q ON q.gx = b0.gx AND q.gy = b0.gy) " + S.rows(source="o"))
def _composite(spark, d):
    p = event_raster(spark, d)
    second = mirrored(p).join(p.select("gx", "gy"), ["gx", "gy"], "left_semi")
    return out(compose.composite([compose.Layer(p), compose.Layer(second, mode="multiply", opacity=0.7), compose.Layer(p, visible=False)]))


@query("ag2_group_mask", f"WITH {S.E}, {S.L2}, m AS (SELECT gx, gy, ((((user_id * 37) % 256) + 256) % 256){D} / 255 AS k FROM (SELECT (event_id % 300)::INT AS gx, (event_id // 300)::INT AS gy, user_id FROM events)), z0 AS (SELECT gx, gy, 0{D} AS r, 0{D} AS g, 0{D} AS b, 0{D} AS a FROM p), g0 AS (SELECT q.gx, q.gy, {', '.join(f'{x} AS {c}' for x, c in zip(S.over('normal', 'q', 'z0'), 'rgba', strict=True))} FROM q JOIN z0 USING (gx, gy)), g1 AS (SELECT g0.gx, g0.gy, g0.r, g0.g, g0.b, g0.a * ({S.luma('k', 'k', 'k')}) AS a FROM g0 JOIN m USING (gx, gy)), b0 AS (SELECT p.gx, p.gy, {', '.join(f'{x} AS {c}' for x, c in zip(S.over('normal', 'p', 'z0'), 'rgba', strict=True))} FROM p JOIN z0 USING (gx, gy)), o AS (SELECT b0.gx, b0.gy, {', '.join(f'CASE WHEN g1.gx IS NULL THEN b0.{c} ELSE {x} END AS {c}' for x, c in zip(S.over('screen', 'g1', 'b0', 0.9), 'rgba', strict=True))} FROM b0 LEFT JOIN g1 ON g1.gx = b0.gx AND g1.gy = b0.gy) " + S.rows(source="o"))
def _group(spark, d):
    p = event_raster(spark, d)
    mask = p.select("gx", "gy", F.col("g").alias("r"), "g", F.col("g").alias("b"))
    second = mirrored(p).join(p.select("gx", "gy"), ["gx", "gy"], "left_semi")
    group = compose.Layer(children=[compose.Layer(second)], mode="screen", opacity=0.9, mask=mask)
    return out(compose.composite([compose.Layer(p), group]))


on_events("ag3_pyramid", lambda p: compose.downsample(p, 2), ", l1 AS (SELECT (gx // 2)::INT AS gx, (gy // 2)::INT AS gy, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM p GROUP BY ALL), l2 AS (SELECT (gx // 2)::INT AS gx, (gy // 2)::INT AS gy, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM l1 GROUP BY ALL) " + S.rows(source="l2"))
on_events("ag4_downsample", compose.downsample, ", l1 AS (SELECT (gx // 2)::INT AS gx, (gy // 2)::INT AS gy, avg(r) AS r, avg(g) AS g, avg(b) AS b, avg(a) AS a FROM p GROUP BY ALL) " + S.rows(source="l1"))


def indexed(spark, d):
    return event_raster(spark, d).withColumn("idx", F.col("gy").cast("long") * 300 + F.col("gx"))


_I = "i AS (SELECT *, gy::BIGINT * 300 + gx AS idx FROM p)"


@query("ag5_median_cut", f"WITH {S.E}, {_I}, ax AS (SELECT max(r) - min(r) AS dr, max(g) - min(g) AS dg, max(b) - min(b) AS db, count(*) // 2 AS half FROM i), k AS (SELECT i.*, row_number() OVER (ORDER BY CASE WHEN dr >= dg AND dr >= db THEN r WHEN dg >= db THEN g ELSE b END, idx) AS n, half FROM i, ax) SELECT (CASE WHEN n <= half THEN 0 ELSE 1 END)::INT AS i, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM k GROUP BY 1")
def _median_cut(spark, d):
    from pixelloom.plans.store import scratch

    scratch(spark, "bins")
    return palettes.median_cut(indexed(spark, d), 2).select(F.col("i").cast("int").alias("i"), *(F.round(c, 6).alias(c) for c in RGB))


_MEANS = [(0.2, 0.2, 0.2), (0.8, 0.5, 0.3), (0.3, 0.7, 0.9)]


@query("ag6_k_means_round", f"WITH {S.E}, {S.palette(_MEANS)}, k AS (SELECT p.r, p.g, p.b, i, row_number() OVER (PARTITION BY gx, gy ORDER BY (p.r - pal.r) * (p.r - pal.r) + (p.g - pal.g) * (p.g - pal.g) + (p.b - pal.b) * (p.b - pal.b), i) AS n FROM p, pal) SELECT i::INT AS centre, count(*)::BIGINT AS n, round(avg(r), 6) AS r, round(avg(g), 6) AS g, round(avg(b), 6) AS b FROM k WHERE n = 1 GROUP BY i")
def _k_means_round(spark, d):
    return palettes.assign(event_raster(spark, d), _MEANS).groupBy("centre").agg(F.count("*").alias("n"), *(F.round(F.avg(c), 6).alias(c) for c in RGB))


@query("ag6_k_means")
def _k_means(spark, d):
    centres = palettes.k_means(indexed(spark, d), 4)
    return spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(centres)], "i int, r double, g double, b double")


@query("ag7_distinct_colors", f"WITH {S.E}, {_I}, k AS (SELECT *, row_number() OVER (PARTITION BY {', '.join(f'floor({c} * 255 + 0.5{D})' for c in RGB)} ORDER BY idx) AS n FROM i) SELECT idx, round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b FROM k WHERE n = 1")
def _distinct(spark, d):
    return palettes.distinct_colors(indexed(spark, d)).select("idx", *(F.round(c, 6).alias(c) for c in RGB))


@query("ag8_subsample", f"WITH {S.E}, {_I} SELECT idx, round(r, 6) AS r FROM i WHERE idx % (SELECT greatest(1, ceil(count(*){D} / 700)::BIGINT) FROM p) = 0")
def _subsample(spark, d):
    p = indexed(spark, d)
    return palettes.subsample(p, 700, p.count()).select("idx", F.round("r", 6).alias("r"))


@query("ag9_weighted_cdf", f"WITH {S.E}, {_I}, c AS (SELECT idx, {S.oklab()[0]} AS l, sqrt(pow({S.oklab()[1]}, 2) + pow({S.oklab()[2]}, 2)) AS c FROM i), f AS (SELECT max(c) AS mc, avg(l) AS ml FROM c), x AS (SELECT max(abs(l - ml)) AS md FROM c, f), w AS (SELECT idx, 1 + c / mc * {S.n(0.7)} + abs(l - ml) / md * {S.n(0.4)} AS w FROM c, f, x) SELECT idx, round(w, 6) AS weight, round(sum(w) OVER (ORDER BY idx), 3) AS cdf FROM w")
def _cdf(spark, d):
    return palettes.weighted_cdf(indexed(spark, d), 0.7, 0.4).select("idx", F.round("weight", 6).alias("weight"), F.round("cdf", 3).alias("cdf"))


@query("ag10_channel_ranges", f"WITH {S.E} SELECT {', '.join(f'round(CASE WHEN max({c}) - min({c}) < {S.n(1e-6)} THEN {v} ELSE {f}({c}) END, 6) AS {n}_{c}' for c in RGB for n, f, v in (('lo', 'min', 0), ('hi', 'max', 1)))} FROM p")
def _ranges(spark, d):
    r = palettes.channel_ranges(event_raster(spark, d))
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("ag11_max_level", f"WITH {S.E} SELECT greatest(0, floor(log2(greatest(max(gx) + 1, max(gy) + 1){D} / 16)))::INT AS level, ceil((max(gx) + 1){D} / 16)::BIGINT AS nx, ceil((max(gy) + 1){D} / 16)::BIGINT AS ny FROM p")
def _max_level(spark, d):
    size = event_raster(spark, d).agg((F.max("gx") + 1).alias("w"), (F.max("gy") + 1).alias("h"))
    return size.select(F.greatest(F.lit(0), F.floor(F.log2(F.greatest("w", "h") / 16.0))).cast("int").alias("level"), F.ceil(F.col("w") / 16.0).alias("nx"), F.ceil(F.col("h") / 16.0).alias("ny"))


@query("ag15_statistics", f"SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, {S.n(0.95)}), 6) AS p95, round(quantile_cont(value, {S.n(0.99)}), 6) AS p99, round(stddev_samp(value), 6) AS deviation FROM events GROUP BY event_type")
def _statistics(spark, d):
    p = lambda q: F.round(F.percentile("value", F.lit(q)), 6)
    return table(spark, d, "events").groupBy("event_type").agg(p(0.5).alias("median"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.round(F.stddev_samp("value"), 6).alias("deviation"))


@query("snk3_svg_rectangles")
def _rectangles(spark, d):
    """Greedy rectangles of a dithered image, a band of 64 rows a group."""
    import numpy as np
    import pandas as pd

    from pixelloom.sources.images import greedy_rectangles

    px = ordered.dither(event_raster(spark, d), ordered.Dither(levels=2))
    bytes_ = px.select((F.floor(F.col("gy") / 64)).alias("band"), "gx", "gy", *(C.to_u8(F.col(c)).alias(c) for c in "rgba"))

    def mesh(rows: pd.DataFrame) -> pd.DataFrame:
        y0 = int(rows["band"].iloc[0]) * 64
        image = np.zeros((64, int(rows["gx"].max()) + 1, 4), np.uint8)
        image[rows["gy"] - y0, rows["gx"]] = rows[list("rgba")]
        return pd.DataFrame([(x, y + y0, w, h, "#%02x%02x%02x" % c[:3], c[3] / 255) for x, y, w, h, c in greedy_rectangles(image)], columns=["x", "y", "w", "h", "fill", "opacity"])

    return bytes_.groupBy("band").applyInPandas(mesh, "x int, y int, w int, h int, fill string, opacity double")


@query("ed2_error_diffusion")
def _diffusion(spark, d):
    from pixelloom.operators.diffuse import error_diffusion

    return out(error_diffusion(event_raster(spark, d).withColumn("image", F.lit(0)), levels=4, tile=64).drop("image"))


def _by_mode(mode: str):
    def run(spark, d):
        from pixelloom.operators.diffuse import error_diffusion

        return out(error_diffusion(vector_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64)), palette=PALETTE5, palette_mode=mode, tile=64).drop("image"))

    return run


for _mode in ("strict", "guided", "mixed", "simple"):
    query(f"ed7_{_mode}_diffusion")(_by_mode(_mode))


@query("ed3_serpentine")
def _serpentine(spark, d):
    from pixelloom.operators.diffuse import error_diffusion

    return out(error_diffusion(event_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64)), levels=4, kernel="stucki", serpentine=True, tile=64).drop("image"))


@query("ed9_mega_pixels")
def _mega_pixels(spark, d):
    from pixelloom.operators.diffuse import error_diffusion

    return out(error_diffusion(event_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64)), levels=4, tile=64, pixel_size=4).drop("image"))


@query("ed8_grayscale_diffusion")
def _gray_diffusion(spark, d):
    from pixelloom.operators.diffuse import error_diffusion

    return out(error_diffusion(event_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64)), levels=3, kernel="sierra", grayscale=True, tile=64).drop("image"))


@query("ed11_palette_diffusion")
def _palette_diffusion(spark, d):
    from pixelloom.operators.diffuse import palette_diffusion

    return out(palette_diffusion(vector_raster(spark, d).withColumn("image", F.floor(F.col("gy") / 64)), PALETTE5, kernel="atkinson", tile=64).drop("image"))


@query("wn9_raster_order", f"WITH {S.E} SELECT gx, gy, row_number() OVER (PARTITION BY gy ORDER BY gx)::INT AS n FROM p")
def _raster_order(spark, d):
    return event_raster(spark, d).select("gx", "gy", F.row_number().over(Window.partitionBy("gy").orderBy("gx")).alias("n"))



@query("plan_filter_stack", f"WITH {S.E} SELECT gx, gy, " + ", ".join(f"round({S.clamp(f'{S.clamp(f"({c} - {S.n(0.5)}) + {S.n(0.5)} + {S.n(0.1)}")} * (CASE WHEN gy % 3 < 1 THEN {S.n(0.6)} ELSE 1{D} END) * (CASE WHEN gx % 3 <> {i} THEN {S.n(0.7)} ELSE 1{D} END)')}, 6) AS {c}" for i, c in enumerate(RGB)) + ", round(a, 6) AS a FROM p WHERE a > 0")
def _stack(spark, d):
    """Two filters of a layer: the later of the list runs first."""
    from pixelloom.plans.document import Filter, apply_filters

    stack = [Filter("crt", {"period": 3, "strength": 0.4, "mask": 0.3}), Filter("adjust", {"brightness": 0.1})]
    return out(apply_filters(event_raster(spark, d).where("a > 0"), stack))
