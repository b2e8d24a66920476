"""Tiles that advance together, tables of residuals, and palettes by table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import diffuse, palette_table


def frame(spark, px, image=0):
    rows = [(image, x, y, *map(float, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image int, gx int, gy int, r double, g double, b double, a double")


def placed(rows):
    return {(r.image, r.gx, r.gy): (r.r, r.g, r.b, r.a) for r in rows}


@pytest.mark.parametrize("serpentine", [False, True])
@pytest.mark.parametrize("kernel", list(diffuse.KERNELS))
def test_tiles_together_equal_tiles_alone(kernel, serpentine):
    rng = np.random.default_rng(1)
    px = rng.random((5, 9, 9, 4))
    left, top, diag = rng.normal(0, 0.1, (5, 9, 2, 3)), rng.normal(0, 0.1, (5, 2, 9, 3)), rng.normal(0, 0.1, (5, 2, 2, 3))
    for backward in (False, True):
        both = diffuse.diffuse_tiles(px, diffuse.Uniform(3), kernel, left, top, diag, backward=backward, serpentine=serpentine)
        for i in range(5):
            one = diffuse.diffuse_tile(px[i], int(backward), diffuse.Uniform(3), kernel, left[i], top[i], diag[i], serpentine=serpentine, core=9)
            assert all(np.array_equal(a[i], b) for a, b in zip(both, one, strict=True))


@pytest.mark.parametrize("cuts", [1, 3, 16])
def test_blocks_of_tiles_do_not_matter(spark, monkeypatch, cuts):
    px = np.random.default_rng(2).random((40, 52, 4))
    monkeypatch.setattr(diffuse, "STEPS", cuts)
    found = diffuse.error_diffusion(frame(spark, px).unionByName(frame(spark, px[:9, :20], 7)), levels=3, kernel="stucki", tile=8).collect()
    residuals, want = {}, {}
    for ty in range(5):
        for tx in range(7):
            part = np.zeros((8, 8, 4))
            part[: max(0, min(8, 40 - ty * 8)), : max(0, min(8, 52 - tx * 8))] = px[ty * 8 : ty * 8 + 8, tx * 8 : tx * 8 + 8]
            near = [(residuals.get((tx - dx, ty - dy)) or [None] * 3)[k] for dx, dy, k in ((1, 0, 0), (0, 1, 1), (1, 1, 2))]
            out, *residuals[tx, ty] = diffuse.diffuse_tile(part, ty * 8, diffuse.Uniform(3), "stucki", *near, core=8)
            want |= {(0, tx * 8 + x, ty * 8 + y): tuple(out[y, x]) for y in range(8) for x in range(8)}
    got = placed(found)
    assert len(got) == len(found) == 40 * 52 + 180
    assert all(np.allclose(got[k], want[k]) for k in got if k[0] == 0)


def test_a_change_renews_only_what_it_reaches(spark, tmp_path):
    rng = np.random.default_rng(3)
    px = rng.random((24, 32, 4))
    px[..., 3] = 1
    new = px.copy()
    new[9:12, 17:20] = 1 - px[9:12, 17:20]
    path, how = f"file://{tmp_path}/kept", dict(tile=8, levels=3, kernel="jarvis_judice_ninke")
    other = frame(spark, px, 4)
    diffuse.diffuse_into(path, frame(spark, px).unionByName(other), 0, **how)
    changed = spark.createDataFrame([(0, 2, 1)], "image int, tx int, ty int")
    for _ in range(2):  # a run that is repeated, as after a failure, gives the same
        stale = diffuse.rediffuse(path, frame(spark, new).unionByName(other), changed, 1, **how)
        assert {tuple(r) for r in stale.collect()} == {(0, x, y) for x in (2, 3) for y in (1, 2)}
    assert spark.read.parquet(f"{path}/generation=1").count() == 4
    want = placed(diffuse.error_diffusion(frame(spark, new).unionByName(other), levels=3, kernel="jarvis_judice_ninke", tile=8).collect())
    assert placed(diffuse.to_pixels(diffuse.newest_tiles(spark, path), 8).collect()) == want
    # a tile that was not there before, and the next generation
    wide = np.concatenate((new, rng.random((24, 8, 4))), 1)
    changed = spark.createDataFrame([(0, 4, 0), (0, 4, 1), (0, 4, 2), (0, 0, 2)], "image int, tx int, ty int")
    stale = diffuse.rediffuse(path, frame(spark, wide).unionByName(other), changed, 2, **how)
    assert {tuple(r)[1:] for r in stale.collect()} == {(4, 0), (4, 1), (4, 2), (0, 2), (1, 2), (2, 2), (3, 2)}
    want = placed(diffuse.error_diffusion(frame(spark, wide).unionByName(other), levels=3, kernel="jarvis_judice_ninke", tile=8).collect())
    assert placed(diffuse.to_pixels(diffuse.newest_tiles(spark, path), 8).collect()) == want


def test_diffusion_of_nothing(spark, tmp_path):
    none = frame(spark, np.zeros((1, 1, 4))).limit(0)
    assert diffuse.error_diffusion(none, tile=8).count() == 0


@pytest.mark.parametrize("n", [40, 700])
def test_palette_table(spark, n):
    rng = np.random.default_rng(n)
    palette = [tuple(map(float, c)) for c in rng.random((n, 3)).round(3)]
    table, labs = palette_table.table_of(palette), diffuse.oklab(np.array(palette))
    some = rng.integers(0, palette_table.SIDE, (300, 3))
    at = palette_table.centres(some)
    assert np.array_equal(table[palette_table.numbers(some)], np.square(at[:, None] - labs[None]).sum(2).argmin(1))
    rows = {r.cell: (r.r, r.g, r.b) for r in palette_table.cells(spark, palette).where(F.col("cell") % 97 == 0).collect()}
    assert len(rows) == -(-palette_table.SIDE**3 // 97) and all(rows[c] == palette[table[c]] for c in rows)
    px = rng.random((6, 6, 4))
    scan = diffuse.Strict(palette)
    scan.table = None
    assert np.array_equal(diffuse.diffuse_tile(px, 0, diffuse.Strict(palette), "burkes", core=6)[0], diffuse.diffuse_tile(px, 0, scan, "burkes", core=6)[0])


def test_palette_limits():
    with pytest.raises(ValueError):
        palette_table.table_of([])
    with pytest.raises(ValueError):
        palette_table.table_of([(0.0, 0.0, 0.0)] * 65_536)
