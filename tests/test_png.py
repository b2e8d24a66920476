"""PNG files: bands put together, the data source and its filters."""

import zlib

import numpy as np
import pytest

from pixelloom.sources import png_files
from pixelloom.sources.images import ImageError, decode_png, encode_png


def frame(spark, images):
    rows = [(i, x, y, *(v / 255 for v in px[y, x].tolist())) for i, px in images.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "image int, gx int, gy int, r double, g double, b double, a double")


def test_joined_checksums():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (7, 0), (70000, 123456), (1, 1)):
        a, b = rng.bytes(n), rng.bytes(m)
        assert png_files.joined_adler(zlib.adler32(a), zlib.adler32(b), m) == zlib.adler32(a + b)


def test_bands_make_one_file(spark):
    rng = np.random.default_rng(2)
    images = {1: rng.integers(0, 256, (23, 17, 4), np.uint8), 2: rng.integers(0, 256, (1, 1, 4), np.uint8), 3: np.full((16, 5, 4), 9, np.uint8)}
    df = frame(spark, images)
    found = {r.image: decode_png(bytes(r.png)) for r in png_files.to_png(df, "preview", band=5).collect()}
    assert set(found) == set(images) and all(np.array_equal(found[i], images[i]) for i in images)
    gap = png_files.to_png(df.where("image = 1 AND (gy < 4 OR gy > 16)"), "preview", band=5).first()["png"]
    want = images[1].copy()
    want[4:17] = 0
    assert np.array_equal(decode_png(bytes(gap)), want)
    assert png_files.to_png(df.limit(0)).count() == 0


def test_source_reads_only_what_a_filter_wants(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = {1: rng.integers(0, 256, (6, 4, 4), np.uint8), 2: rng.integers(0, 256, (3, 9, 4), np.uint8)}
    assert png_files.write_png(frame(spark, images), f"file://{tmp_path}/out", "preview") == 2
    broken = encode_png(rng.integers(0, 256, (2, 50, 4), np.uint8))
    (tmp_path / "out/broken.png").write_bytes(broken[:60])  # has a header, but can't be decoded
    source = png_files.read_png(spark, f"file://{tmp_path}/out")
    with pytest.raises(Exception):
        source.count()
    some = source.where("width < 50")
    rows = some.collect()
    assert len(rows) == 6 * 4 + 3 * 9
    for r in rows:
        px = images[int(r.name[6])]
        assert (r.height, r.width) == px.shape[:2] and [round(v * 255) for v in (r.r, r.g, r.b, r.a)] == px[r.gy, r.gx].tolist()
    assert source.where("name = 'image-2.png' AND gx > 4").count() == 12
    assert source.where("name IN ('image-1.png', 'none') AND height >= 6").count() == 24
    assert source.where("height > 6 AND width < 50").count() == 0


def test_sides_are_limited(spark):
    df = spark.createDataFrame([(1, 9000, 0, 0.0, 0.0, 0.0, 1.0)], "image int, gx int, gy int, r double, g double, b double, a double")
    with pytest.raises(Exception, match=ImageError.__name__):
        png_files.to_png(df).collect()
