"""Operators against independent small calculations."""

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.functions import grid as G
from pixelloom.operators import compose, ordered, palettes, point, tiles
from pixelloom.operators import diffuse
from pixelloom.operators.diffuse import KERNELS, Uniform, diffuse_tile, error_diffusion
from pixelloom.sources import palette_files
from pixelloom.sources.images import allowed, decode_png, encode_png, greedy_rectangles, read_images, svg_document, to_png


def image(spark, w=20, h=13, seed=1):
    rng = np.random.default_rng(seed)
    px = rng.random((h, w, 4)).round(3)
    rows = [(x, y, *map(float, px[y, x])) for y in range(h) for x in range(w)]
    return px, spark.createDataFrame(rows, "gx int, gy int, r double, g double, b double, a double")


def grid(df, w, h):
    out = np.zeros((h, w, 4))
    for r in df.collect():
        out[r["gy"], r["gx"]] = [r[c] for c in "rgba"]
    return out


def test_blur_clamps_at_the_tile(spark):
    px, df = image(spark)
    got = grid(tiles.core(tiles.box_blur(tiles.decompose(df, 20, 13, 8), 3, tile=8), 20, 13), 20, 13)
    want, full = np.zeros_like(px), np.zeros((13 + 20, 20 + 20, 4))
    full[2:15, 2:22] = px
    for ty in range(2):
        for tx in range(3):
            t = full[ty * 8 : ty * 8 + 12, tx * 8 : tx * 8 + 12]
            for axis in (1, 0):
                t = np.mean([np.take(t, np.clip(np.arange(12) + d, 0, 11), axis) for d in range(-3, 4)], 0)
            y, x = min(13, ty * 8 + 8), min(20, tx * 8 + 8)
            want[ty * 8 : y, tx * 8 : x] = t[2 : 2 + y - ty * 8, 2 : 2 + x - tx * 8]
    assert np.allclose(got, want)


def test_dither_has_no_seams_and_only_its_levels(spark):
    _, df = image(spark)
    p = ordered.Dither(mode="bayer8", levels=4, dither_alpha=False)
    whole = grid(ordered.dither(df, p), 20, 13)
    cut = grid(tiles.core(ordered.dither(tiles.decompose(df, 20, 13, 8), p), 20, 13), 20, 13)
    assert np.array_equal(whole, cut)
    assert set(np.unique(whole[..., :3].round(6))) <= {0.0, 0.333333, 0.666667, 1.0}


def test_half_opacity_is_the_mean(spark):
    px, df = image(spark)
    df = df.withColumn("a", F.lit(1.0))
    full = grid(point.crt(df, 3, 0.4, 0.3), 20, 13)
    half = grid(point.with_blend(df, lambda x: point.crt(x, 3, 0.4, 0.3), opacity=0.5), 20, 13)
    assert np.allclose(half[..., :3], (full[..., :3] + px[..., :3]) / 2)


def test_parameters_out_of_range():
    for bad in ({"levels": 1}, {"scale": 5}, {"pixel_size": 0}, {"bias": 0.6}, {"angle": float("nan")}, {"wavelength": 1}, {"palette_mode": "none?"}):
        with pytest.raises(ValueError):
            ordered.Dither(**bad)
    with pytest.raises(ValueError):
        C.palette_literal([])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(-(2**20), 2**20), st.integers(-(2**20), 2**20), st.integers(0, 2**40))
def test_generator_equals_plain_numbers(spark, x, y, seed):
    m = 2**64 - 1
    s = (seed ^ (x * G.GLITCH_X & m) ^ (y * G.GLITCH_Y & m)) & m or 1
    want = []
    for _ in range(2):
        s ^= s << 13 & m
        s ^= s >> 7
        s ^= s << 17 & m
        want.append((s >> 32) / (2**32 - 1))
    row = spark.range(1).select(F.lit(x).alias("x"), F.lit(y).alias("y"))
    s1 = G.xorshift_step(G.xorshift_state(F.col("x"), F.col("y"), seed))
    got = row.select(G.xorshift_unit(s1), G.xorshift_unit(G.xorshift_step(s1))).first()
    assert tuple(got) == tuple(want)


def plain_diffusion(px, levels, kernel, core):
    """One tile, written without residual buffers: error beyond two pixels or to the left of the tile is lost."""
    total, taps = KERNELS[kernel]
    h, w, _ = px.shape
    err, out = np.zeros((core + 2, core + 2, 3)), np.zeros_like(px)
    for y in range(h):
        for x in range(w):
            v = np.clip(px[y, x, :3] + err[y, x], 0, 1)
            q = np.clip(np.floor(v * (levels - 1) + 0.5), 0, levels - 1) / (levels - 1)
            out[y, x] = [*q, 1.0] if px[y, x, 3] > 0.5 else [0, 0, 0, 0]
            for dx, dy, k in taps:
                if 0 <= x + dx < core + 2 and y + dy < core + 2:
                    err[y + dy, x + dx] += (v - q) * (k / total)
    return out


@pytest.mark.parametrize("kernel", sorted(KERNELS))
def test_diffusion_of_one_tile(kernel):
    px = np.random.default_rng(3).random((8, 8, 4))
    got, *_ = diffuse_tile(px, 0, Uniform(3), kernel, core=8)
    assert np.allclose(got, plain_diffusion(px, 3, kernel, 8))


def test_wavefront_equals_row_by_row(spark):
    px, df = image(spark, 24, 16)
    got = grid(error_diffusion(df.withColumn("image", F.lit(5)), levels=3, kernel="jarvis_judice_ninke", tile=8), 24, 16)
    left, top, diag, want = {}, {}, {}, np.zeros_like(px)
    for ty in range(2):
        for tx in range(3):
            at = np.s_[ty * 8 : ty * 8 + 8, tx * 8 : tx * 8 + 8]
            want[at], right, bottom, corner = diffuse_tile(px[at], ty * 8, Uniform(3), "jarvis_judice_ninke", left.get((tx, ty)), top.get((tx, ty)), diag.get((tx, ty)), core=8)
            left[tx + 1, ty], top[tx, ty + 1], diag[tx + 1, ty + 1] = right, bottom, corner
    assert np.array_equal(got, want)


def test_k_means_and_median_cut_find_two_clusters(spark):
    rows = [(i, 0.9 + 0.001 * (i % 7), 0.05, 0.0) if i < 50 else (i, 0.0, 0.1, 0.8 + 0.001 * (i % 5)) for i in range(100)]
    px = spark.createDataFrame(rows, "idx long, r double, g double, b double")
    centres = sorted(palettes.k_means(px, 2))
    assert centres[0][2] > 0.79 and centres[1][0] > 0.89
    cut = sorted((r["r"], r["b"]) for r in palettes.median_cut(px, 2).collect())
    assert cut[0][1] > 0.79 and cut[1][0] > 0.89


def test_ramps_stay_in_gamut(spark):
    red = spark.createDataFrame([(1.0, 0.0, 0.0)], "r double, g double, b double")
    rows = palettes.ramp(red, [F.lit(0.0), F.lit(0.0), F.lit(1.0)], 9).orderBy("i").collect()
    assert len(rows) == 9 and all(0 <= r[c] <= 1 for r in rows for c in "rgb")
    assert np.allclose([rows[0][c] for c in "rgb"], (1, 0, 0), atol=2e-3)
    assert palettes.harmony(red, "triadic", 2).count() == 3


def test_groups_fold_apart(spark):
    _, df = image(spark)
    one = grid(compose.composite([compose.Layer(children=[compose.Layer(df)])]), 20, 13)
    flat = grid(compose.composite([compose.Layer(df)]), 20, 13)
    assert one.shape == flat.shape and not np.array_equal(one, flat)  # laid out straight colour is weighted by alpha twice


@pytest.mark.parametrize("kind", sorted(palette_files.WRITERS))
def test_palette_files_round_trip(kind):
    colors = [(0, 128, 255), (1, 2, 3), (255, 255, 255)]
    assert palette_files.parse(palette_files.WRITERS[kind](colors), kind) == colors


def test_palette_files_that_are_none():
    for kind, data in (("gpl", b"x"), ("csv", b"1,2,300\n"), ("ase", b"ASEX"), ("pal", b"RIFF0000XXXX"), ("gpl", b"GIMP Palette\n"), ("xyz", b"")):
        with pytest.raises(palette_files.PaletteError):
            palette_files.parse(data, kind)
    assert palette_files.parse(b'[{"R": 300, "Green": 1.9}, [1, 2, 3, 4]]', "json") == [(255, 1, 0), (1, 2, 3)]


def test_png_round_trip(spark, tmp_path):
    px = np.random.default_rng(4).integers(0, 256, (5, 7, 4)).astype(np.uint8)
    assert np.array_equal(decode_png(encode_png(px)), px)
    (tmp_path / "a.png").write_bytes(encode_png(px))
    read = read_images(spark, str(tmp_path))
    back = to_png(read.withColumn("image", F.lit(1)), "save").first()["png"]
    assert np.array_equal(decode_png(bytes(back)), px)


def test_svg_covers_each_pixel_once():
    px = np.random.default_rng(5).integers(0, 2, (9, 11, 4)).astype(np.uint8) * 255
    seen = np.zeros((9, 11), int)
    for x, y, w, h, c in greedy_rectangles(px):
        assert (px[y : y + h, x : x + w] == c).all()
        seen[y : y + h, x : x + w] += 1
    assert np.array_equal(seen, (px[..., 3] > 0).astype(int))
    assert svg_document(greedy_rectangles(px), 11, 9).startswith("<svg")


def test_paths_stay_inside(tmp_path):
    good = tmp_path / "a.png"
    good.write_bytes(b"")
    assert allowed(str(good), root=str(tmp_path))
    for bad in (str(tmp_path / "a.exe"), "/etc/a.png"):
        with pytest.raises(PermissionError):
            allowed(bad, root=str(tmp_path))


def test_document_edits_and_filter_order(spark):
    from pixelloom.plans import document as doc

    px, df = image(spark)
    nodes = doc.add_layer((), "one", opacity=2.0, mode="nonsense")
    assert nodes[0].opacity == 1.0 and nodes[0].mode == "normal"
    nodes = doc.add_filter(nodes, 1, doc.Filter("crt", {"period": 3}))
    nodes = doc.add_filter(nodes, 1, doc.Filter("adjust", {"brightness": 0.2}))
    assert [f.kind for f in nodes[0].filters] == ["crt", "adjust"]
    want = point.crt(point.adjust(df, brightness=0.2), 3)
    got = doc.apply_filters(df, nodes[0].filters)
    assert np.allclose(grid(got, 20, 13), grid(want, 20, 13))
    nodes = doc.update_filter(nodes, 1, 1, {"contrast": 0.1})
    assert nodes[0].filters[1].params == {"brightness": 0.2, "contrast": 0.1}
    pal = ((0.0, 0.0, 0.0), (1.0, 1.0, 1.0))
    nodes = doc.add_filter(nodes, 1, doc.Filter("palette_quantize", {"palette": pal}))
    with pytest.raises(ValueError):
        doc.remove_palette(nodes, pal)
    assert [f.kind for f in doc.delete_palette(nodes, pal)[0].filters] == ["crt", "adjust"]
    nodes = doc.move_layer(doc.add_layer(nodes, "two", visible=False), 1, 9)
    assert [n.id for n in nodes] == [2, 1]
    assert doc.render(nodes, {1: df, 2: df}).count() == 260
    assert doc.remove_layer(nodes, 1)[0].id == 2


def scalar_diffusion(px, src, pick, kernel, low, high, gain=1.0, serpentine=False, gray=False):
    """One pixel after the other, in plain numbers: colours alone."""
    tall, wide = px.shape[:2]
    total, taps = KERNELS[kernel]
    err, out = np.zeros((tall, wide, 3)), np.zeros((tall, wide, 3))
    for y in range(tall):
        turn = -1 if serpentine and y % 2 else 1
        for x in range(wide)[::turn]:
            start = np.full(3, px[y, x, :3] @ np.array([0.2126, 0.7152, 0.0722])) if gray else src(px[y, x, :3])
            v = np.minimum(np.maximum(start + err[y, x], low), high)
            color, own = pick(v)
            e = (v - (own @ np.array([0.2126, 0.7152, 0.0722])) if gray else v - own) * gain
            out[y, x] = color
            for dx, dy, w in taps:
                if 0 <= x + dx * turn < wide and y + dy < tall:
                    err[y + dy, x + dx * turn] += e * w / total
    return out


PALETTE = [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.9, 0.1, 0.05), (0.1, 0.2, 0.8), (0.2, 0.7, 0.1)]


def lab_of(c):
    from pixelloom.functions.color import oklab_of

    return np.array(oklab_of([min(max(x, 0), 1) for x in c]))


def centre(lab):
    out = []
    for x, low, high in zip(lab, (0.0, -0.4, -0.4), (1.0, 0.4, 0.4)):
        t = min(max((x - low) / (high - low), 0), 1 - 1.1920929e-07)
        out.append(low + (min(int(t * 64), 63) + 0.5) / 64 * (high - low))
    return np.array(out)


def first_nearest(v, spots):
    d = [sum((a - b) ** 2 for a, b in zip(v, s)) for s in spots]
    return d.index(min(d))


def test_diffusion_with_every_quantiser():
    rng = np.random.default_rng(11)
    px = np.concatenate((rng.random((9, 9, 3)), np.ones((9, 9, 1))), 2)
    colors, labs = np.array(PALETTE), [lab_of(c) for c in PALETTE]
    to_bytes = lambda c: np.floor(np.array([12.92 * x if x <= 0.0031308 else 1.055 * x ** (1 / 2.4) - 0.055 for x in c]) * 255 + 0.5)
    spots = [to_bytes(c) for c in PALETTE]
    same = lambda c: (c, c)

    def guided(v):
        out = []
        for x, low, high in zip(v, colors.min(0), colors.max(0)):
            q = min(max((x - low) / (high - low), 0), 1)  # two levels
            out.append(low + (1 if q > 0.5 else 0) * (high - low))
        return np.array(out)

    def at(i, own):
        return colors[i], own[i]

    cases = {
        diffuse.Strict: (lambda c: c, lambda v: same(colors[first_nearest(centre(lab_of(v)), labs)]), 0, 1, 1.0),
        diffuse.Guided: (lambda c: c, lambda v: same(guided(v)), 0, 1, 1.0),
        diffuse.Mixed: (lambda c: c, lambda v: same(colors[first_nearest(lab_of(guided(v)), labs)]), 0, 1, 1.0),
        diffuse.Simple: (to_bytes, lambda v: at(first_nearest(v, spots), spots), 0, 255, 1.0),
        diffuse.InOklab: (lab_of, lambda v: at(first_nearest(centre(v), labs), labs), np.array([0, -0.5, -0.5]), np.array([1, 0.5, 0.5]), 1.0),
    }
    for kind, case in cases.items():
        for kernel in ("floyd_steinberg", "jarvis_judice_ninke"):
            got = diffuse_tile(px, 0, kind(PALETTE, 2) if kind in (diffuse.Guided, diffuse.Mixed) else kind(PALETTE), kernel, core=9)[0]
            assert np.allclose(got[..., :3], scalar_diffusion(px, case[0], case[1], kernel, *case[2:]))
    step = lambda v: same(np.floor(v * 2 + 0.5) / 2)
    for options in ({"serpentine": True}, {"gray": True}, {"serpentine": True, "gray": True}):
        got = diffuse_tile(px, 0, Uniform(3), "stucki", serpentine="serpentine" in options, grayscale="gray" in options, core=9)[0]
        assert np.allclose(got[..., :3], scalar_diffusion(px, lambda c: c, step, "stucki", 0, 1, **options))


def test_palette_diffusion_by_tile(spark):
    rng = np.random.default_rng(13)
    px = np.concatenate((rng.random((12, 20, 3)), rng.random((12, 20, 1))), 2)
    rows = [(3, x, y, *map(float, px[y, x])) for y in range(12) for x in range(20)]
    df = spark.createDataFrame(rows, "image int, gx int, gy int, r double, g double, b double, a double")
    found = {(r.gx, r.gy): (r.r, r.g, r.b, r.a) for r in diffuse.palette_diffusion(df, PALETTE, tile=8).collect()}
    assert len(found) == 240
    labs, padded = [lab_of(c) for c in PALETTE], np.zeros((24, 32, 4))
    padded[2:14, 2:22] = px
    for ty in range(2):
        for tx in range(3):
            part = padded[ty * 8 : ty * 8 + 12, tx * 8 : tx * 8 + 12]
            pick = lambda v: ((i := first_nearest(centre(v), labs)), (np.array(PALETTE[i]), labs[i]))[1]
            want = scalar_diffusion(part, lab_of, pick, "floyd_steinberg", np.array([0, -0.5, -0.5]), np.array([1, 0.5, 0.5]))
            for y in range(8):
                for x in range(8):
                    if (at := (tx * 8 + x, ty * 8 + y)) in found:
                        assert np.allclose(found[at], (*want[y + 2, x + 2], px[at[1], at[0], 3]))


@pytest.mark.parametrize("rule", ["monochromatic", "analogous", "complementary", "triadic", "split"])
def test_harmonies(spark, rule):
    from pixelloom.operators.palettes import harmony

    df = spark.createDataFrame([("x", 0.3, 0.25, 0.2)], "name string, r double, g double, b double")
    for n in (1, 2, 3, 5):
        rows = sorted(harmony(df, rule, n).collect(), key=lambda r: r.i)
        assert len(rows) == max(n, {"complementary": 2, "triadic": 3, "split": 3}.get(rule, 1)) and rows[0].name == "x"
        base, labs = lab_of((0.3, 0.25, 0.2)), [lab_of((r.r, r.g, r.b)) for r in rows]
        assert all(-1e-9 <= c <= 1 + 1e-9 for r in rows for c in (r.r, r.g, r.b))
        turn = [np.angle(complex(*x[1:]) / complex(*base[1:])) for x in labs]
        if rule == "monochromatic":
            assert np.allclose([x[0] for x in labs], [0.15 + 0.75 * (0.5 if n == 1 else i / (n - 1)) for i in range(n)], atol=0.01)
        if rule == "analogous":
            assert np.allclose(turn, [0] if n == 1 else [np.pi / 6 * (2 * i / (n - 1) - 1) for i in range(n)], atol=1e-3)
        if rule == "split":
            assert np.allclose(np.abs(turn[:3]), [0, np.pi - 0.5, np.pi - 0.5], atol=1e-3)


def test_presets_and_threshold_maps(spark):
    import struct
    import zlib

    from pixelloom.sources.images import ImageError
    from pixelloom.sources.presets import PRESETS, find_preset, preset_colors, threshold_map

    assert len(PRESETS) == len({p.id for p in PRESETS}) == 10 and find_preset("none") is None
    assert find_preset("amstrad_cpc").colors[3] == (128, 0, 0) and find_preset("pico_8").colors[1] == (0x1D, 0x2B, 0x53)
    assert preset_colors(spark).count() == sum(len(p.colors) for p in PRESETS)

    def grey(depth, width, height, body):
        chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    rows = threshold_map(grey(8, 2, 2, bytes([0, 0, 51, 0, 102, 255])))
    assert np.allclose(rows, [[0, 0.2], [0.4, 1]])
    assert threshold_map(grey(1, 3, 1, bytes([0, 0b10100000]))) == ((1.0, 0.0, 1.0),)
    px, df = image(spark)
    got = grid(ordered.dither(df, ordered.Dither(mode="map", levels=2, threshold_map=rows, dither_alpha=False)), 20, 13)
    t = np.array(rows)[np.arange(13)[:, None] % 2, np.arange(20)[None] % 2]
    assert np.array_equal(got[..., 0], np.clip(np.floor(px[..., 0] + t - 0.5 + 0.5), 0, 1))
    for bad in (b"", encode_png(np.zeros((2, 2, 4), np.uint8)), grey(8, 4097, 1, b"")):
        with pytest.raises(ImageError):
            threshold_map(bad)


@pytest.mark.parametrize("alpha", [True, False])
def test_diffusion_of_mega_pixels(spark, alpha):
    px, df = image(spark, 11, 8)
    got = grid(error_diffusion(df.withColumn("image", F.lit(2)), levels=3, tile=8, pixel_size=3, dither_alpha=alpha), 11, 8)
    small = np.zeros((8, 8, 4))
    small[:3, :4] = px[::3, ::3]
    want, *_ = diffuse_tile(small, 0, Uniform(3), "floyd_steinberg", dither_alpha=alpha, core=8)
    want = want[np.arange(8)[:, None] // 3, np.arange(11)[None] // 3].copy()
    if not alpha:
        want[..., 3] = px[..., 3]
    assert np.allclose(got, want)


def test_images_do_not_wait_for_each_other(spark):
    px, df = image(spark, 16, 32)
    got = grid(error_diffusion(df.withColumn("image", F.floor(F.col("gy") / 8)), levels=3, tile=8), 16, 32)
    for band in range(4):
        one = grid(error_diffusion(df.where(F.floor(F.col("gy") / 8) == band).withColumn("image", F.lit(0)), levels=3, tile=8), 16, 32)
        assert np.array_equal(got[band * 8 : band * 8 + 8], one[band * 8 : band * 8 + 8])


def test_stencils_in_a_stack_and_moved_filters(spark):
    from pixelloom.plans import document as doc

    _, df = image(spark)
    stack = [doc.Filter("glow", {"threshold": 0.4, "radius": 1.0, "intensity": 0.5}), doc.Filter("adjust", {"brightness": 0.1})]
    want = tiles.core(tiles.glow(tiles.decompose(point.adjust(df, brightness=0.1), 20, 13), 0.4, 1.0, 0.5), 20, 13)
    assert np.allclose(grid(doc.apply_filters(df, stack), 20, 13), grid(want, 20, 13))
    nodes = (doc.Node(1, filters=tuple(stack)),)
    assert [f.kind for f in doc.move_filter(nodes, 1, 0, 9)[0].filters] == ["adjust", "glow"]
    assert [f.kind for f in doc.remove_filter(nodes, 1, 0)[0].filters] == ["adjust"]
