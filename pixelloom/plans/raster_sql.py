"""DuckDB text of the rasters and formulas that the registered queries are held against."""

from __future__ import annotations

import math

D = "::DOUBLE"
E = f"""p AS (SELECT (event_id % 300)::INT AS gx, (event_id // 300)::INT AS gy,
  (((floor(value * 100{D} + 0.5{D})::BIGINT % 256) + 256) % 256){D} / 255{D} AS r,
  ((((user_id * 37) % 256) + 256) % 256){D} / 255{D} AS g, ((event_id * 11) % 256){D} / 255{D} AS b,
  CASE event_id % 10 WHEN 0 THEN 0{D} WHEN 1 THEN 0.5{D} ELSE 1{D} END AS a FROM events)"""
V = f"""v AS (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings),
p AS (SELECT ((vec_id % 64) * 8 + i % 8)::INT AS gx, ((vec_id // 64) * 8 + i // 8)::INT AS gy,
  least(greatest(embedding[i + 1]{D} + 0.5{D}, 0), 1) AS r, least(greatest(embedding[(i + 1) % 64 + 1]{D} + 0.5{D}, 0), 1) AS g,
  least(greatest(embedding[(i + 2) % 64 + 1]{D} + 0.5{D}, 0), 1) AS b, 1{D} AS a FROM v)"""
L2 = "q AS (SELECT (299 - gx)::INT AS gx, gy, g AS r, b AS g, r AS b, a FROM p)"
BAYER4 = "[0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5]"


def n(x: float) -> str:
    return f"({x!r}{D})"


def clamp(x: str, low: float = 0.0, high: float = 1.0) -> str:
    return f"least(greatest({x}, {n(low)}), {n(high)})"


def pmod(x: str, k: int) -> str:
    return f"((({x}) % {k} + {k}) % {k})"


def ediv(x: str, k: int) -> str:
    return f"floor(({x}){D} / {k})::BIGINT"


def luma(r="r", g="g", b="b") -> str:
    return f"({r} * {n(0.2126)} + {g} * {n(0.7152)} + {b} * {n(0.0722)})"


def rows(r="r", g="g", b="b", a="a", source="p", keys="gx, gy") -> str:
    """A result of pixels, rounded."""
    return f"SELECT {keys}, " + ", ".join(f"round({x}, 6) AS {c}" for x, c in zip((r, g, b, a), "rgba", strict=True)) + f" FROM {source}"


def bayer4(x: str, y: str) -> str:
    return f"({BAYER4}[({pmod(y, 4)} * 4 + {pmod(x, 4)} + 1)::INT]{D} / 16)"


def bayer(size: int, x: str, y: str) -> str:
    two = lambda u, v: f"([0, 2, 3, 1][({v} * 2 + {u} + 1)::INT])"
    if size == 2:
        return f"({two(pmod(x, 2), pmod(y, 2))}{D} / 4)"
    if size == 4:
        return bayer4(x, y)
    return f"((4 * {BAYER4}[({pmod(y, 4)} * 4 + {pmod(x, 4)} + 1)::INT] + {two(f'({pmod(x, 8)} // 4)', f'({pmod(y, 8)} // 4)')}){D} / 64)"


def quantise(v: str, t: str, levels: int, scale: float = 1.0) -> str:
    k = n(levels - 1)
    return f"(least(greatest(floor({v} * {k} + ({t} - {n(0.5)}) * {n(scale)} + {n(0.5)}), 0), {k}) / {k})"


def oklab(r="r", g="g", b="b") -> tuple[str, str, str]:
    c = [clamp(x) for x in (r, g, b)]
    lms = [f"cbrt({n(i)} * {c[0]} + {n(j)} * {c[1]} + {n(k)} * {c[2]})" for i, j, k in ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))]
    return tuple(f"({n(i)} * {lms[0]} + {n(j)} * {lms[1]} + {n(k)} * {lms[2]})" for i, j, k in ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660)))


def linear(lab: tuple[str, str, str], clip: bool = True) -> tuple[str, str, str]:
    l, a, b = lab
    lms = [f"pow({l} + {n(i)} * {a} + {n(j)} * {b}, 3)" for i, j in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480))]
    out = [f"({n(i)} * {lms[0]} + {n(j)} * {lms[1]} + {n(k)} * {lms[2]})" for i, j, k in ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))]
    return tuple(clamp(x) if clip else x for x in out)


def to_srgb(x: str) -> str:
    x = clamp(x)
    return f"floor(255{D} * (CASE WHEN {x} <= {n(0.0031308)} THEN {n(12.92)} * {x} ELSE {n(1.055)} * pow({x}, {n(1 / 2.4)}) - {n(0.055)} END) + 0.5{D})::INT"


def blend(mode: str, s: str, d: str) -> str:
    hard = lambda t: f"(CASE WHEN {t} < 0.5{D} THEN 2{D} * {s} * {d} ELSE 1{D} - 2{D} * (1{D} - {s}) * (1{D} - {d}) END)"
    return {
        "normal": s,
        "multiply": f"({s} * {d})",
        "screen": f"({s} + {d} - {s} * {d})",
        "overlay": hard(d),
        "darken": f"least({s}, {d})",
        "lighten": f"greatest({s}, {d})",
        "color_dodge": f"(CASE WHEN {s} >= 1 THEN 1{D} ELSE least({d} / (1{D} - {s}), 1{D}) END)",
        "color_burn": f"(CASE WHEN {s} <= 0 THEN 0{D} ELSE 1{D} - least((1{D} - {d}) / {s}, 1{D}) END)",
        "hard_light": hard(s),
        "soft_light": f"(CASE WHEN {s} <= 0.5{D} THEN {d} - (1{D} - 2{D} * {s}) * {d} * (1{D} - {d}) ELSE {d} + (2{D} * {s} - 1{D}) * ((CASE WHEN {d} <= 0.25{D} THEN ((16{D} * {d} - 12{D}) * {d} + 4{D}) * {d} ELSE sqrt({d}) END) - {d}) END)",
        "difference": f"abs({s} - {d})",
        "exclusion": f"({s} + {d} - 2{D} * {s} * {d})",
    }[mode]


def over(mode: str, src: str, dst: str, opacity: float = 1.0) -> tuple[str, ...]:
    """r, g, b, a of src over dst, both names of relations."""
    sa = f"({src}.a * {n(opacity)})"
    out = [f"({blend(mode, f'{src}.{c}', f'{dst}.{c}')} * {sa} + {dst}.{c} * {dst}.a * (1{D} - {sa}))" for c in "rgb"] + [f"({sa} + {dst}.a * (1{D} - {sa}))"]
    return tuple(f"(CASE WHEN {sa} < {n(1e-6)} THEN {dst}.{c} ELSE {x} END)" for x, c in zip(out, "rgba", strict=True))


def palette(colors, name: str = "pal") -> str:
    """A relation (i, r, g, b)."""
    return f"{name}(i, r, g, b) AS (VALUES " + ", ".join(f"({i}, {n(r)}, {n(g)}, {n(b)})" for i, (r, g, b) in enumerate(colors)) + ")"


def rotation(angle: float) -> tuple[str, str]:
    c, s = n(math.cos(math.radians(angle))), n(math.sin(math.radians(angle)))
    return f"floor(gx * {c} - gy * {s})::BIGINT", f"floor(gx * {s} + gy * {c})::BIGINT"


def far(l: str, a: str, b: str) -> str:
    """Whether a colour is out of gamut."""
    return "(" + " OR ".join(f"{x} < {n(-1e-4)} OR {x} > {n(1 + 1e-4)}" for x in linear((l, a, b), False)) + ")"


def clipped(source: str, keys: str) -> str:
    """Relations halves and clipped(keys, l, a, b) out of source(keys, l, a, b): 32 bisections of the chroma."""
    mid = "((lo + hi) / 2)"
    bad = far("l", f"{mid} * cos(h)", f"{mid} * sin(h)")
    return f"""halves AS (SELECT {keys}, l, a, b, atan2(b, a) AS h, {far('l', 'a', 'b')} AS bad, 0{D} AS lo, sqrt(a * a + b * b) AS hi, 0 AS k FROM {source}
 UNION ALL SELECT {keys}, l, a, b, h, bad, CASE WHEN {bad} THEN lo ELSE {mid} END, CASE WHEN {bad} THEN {mid} ELSE hi END, k + 1 FROM halves WHERE k < 32),
clipped AS (SELECT {keys}, l, CASE WHEN bad THEN lo * cos(h) ELSE a END AS a, CASE WHEN bad THEN lo * sin(h) ELSE b END AS b FROM halves WHERE k = 32)"""
