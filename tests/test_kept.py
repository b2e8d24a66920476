"""What is kept between edits: pyramids, streams of upserts; and palettes by median cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelloom.operators import compose, palettes, pyramid
from pixelloom.streaming import changes


def frame(spark, px):
    rows = [(x, y, *map(float, px[y, x])) for y in range(px.shape[0]) for x in range(px.shape[1])]
    return spark.createDataFrame(rows, "gx int, gy int, r double, g double, b double, a double")


def placed(df):
    return {(r.gx, r.gy): tuple(round(v, 9) for v in (r.r, r.g, r.b, r.a)) for r in df.select("gx", "gy", *"rgba").collect()}


def test_pyramid_is_brought_up_to_date(spark, tmp_path):
    rng = np.random.default_rng(1)
    px = rng.random((22, 37, 4))
    path = f"file://{tmp_path}/pyramid"
    below, above = frame(spark, px), frame(spark, rng.random((22, 37, 4)))
    layers = lambda base, tiles: compose.composite([compose.Layer(pyramid.only(x, tiles, 4) if tiles is not None else x, opacity=o) for x, o in ((base, 1.0), (above, 0.4))])
    top = pyramid.build(path, layers(below, None), 37, 22, tile=4)
    assert top == 3
    # a raw change makes the composite of its tile stale, whatever the layer; nothing else is laid out again
    new = px.copy()
    new[5, 9], new[21, 36] = 0.5, 0.25
    tiles = spark.createDataFrame([(0, n, x, y, stage) for n in (1, 2) for x in range(10) for y in range(6) for stage in ("raw", "processed", "composite")], "doc int, layer int, tx int, ty int, stage string")
    edits = spark.createDataFrame([(0, 1, 2, 1, "raw"), (0, 1, 9, 5, "raw")], "doc int, layer int, tx int, ty int, kind string")
    stale = changes.stale(tiles, edits).where("stage = 'composite'").select("tx", "ty").distinct()
    assert stale.count() == 2
    for _ in range(2):
        pyramid.update(path, layers(frame(spark, new), stale), stale, 1, top, tile=4)
    want = layers(frame(spark, new), None)
    for level in range(top + 1):
        assert placed(pyramid.newest(spark, path, level)) == placed(compose.downsample(want, level))
        made = {tuple(r) for r in spark.read.parquet(f"{path}/index/level={level}/generation=1").select("tx", "ty").collect()}
        assert made == {(2 >> level, 1 >> level), (9 >> level, 5 >> level)}
    assert placed(pyramid.newest(spark, path, 1, before=1)) == placed(compose.downsample(layers(below, None), 1))
    # pixels that go away leave, and a tile may lose all
    gone = frame(spark, new).where("NOT (gx BETWEEN 8 AND 11 AND gy BETWEEN 4 AND 7)")
    pyramid.update(path, gone, spark.createDataFrame([(2, 1)], "tx int, ty int"), 2, top, tile=4)
    now = placed(pyramid.newest(spark, path, 0))
    assert len(now) == 22 * 37 - 16 and (9, 5) not in now


@pytest.mark.parametrize("fan", [3])
def test_upserts_in_many_batches(spark, tmp_path, fan):
    rng = np.random.default_rng(2)
    schema = "doc int, layer int, generation int, value double"
    rows = [(int(rng.integers(0, 40)), 1, int(rng.integers(0, 50)), float(rng.random())) for _ in range(300)]
    for n in range(10):  # late generations come in later batches
        spark.createDataFrame(rows[n * 30 : n * 30 + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    sizes = []
    path = f"file://{tmp_path}/table"
    changes.upsert_stream(stream, path, ["doc", "layer"], f"{tmp_path}/checkpoint", then=lambda t, n: sizes.append((n, t.count() if n == 9 else 0)), fan=fan).awaitTermination()
    assert [n for n, _ in sizes] == list(range(10))
    want = {}
    for doc, layer, g, v in rows:
        want[doc, layer] = max(want.get((doc, layer), (-1, 0.0)), (g, v))
    found = changes.upserted(spark, path, spark.read.schema(schema).parquet(f"{tmp_path}/in").schema, 10, ["doc", "layer"], fan=fan)
    assert {(r.doc, r.layer): (r.generation, r.value) for r in found.collect()} == want
    assert sizes[-1][1] == len(want)
    runs = changes.live_runs(10, fan)
    assert len(runs) <= fan * 4 and sum(fan**level for level, _ in runs) == 10
    # a batch's own run holds no more than the batch
    live = [(level, run) for level, run in runs if level == 0]
    assert all(spark.read.parquet(f"{path}/level=0/run={run}").count() <= 30 for _, run in live)


def test_live_runs():
    assert changes.live_runs(0) == []
    for n in range(1, 200):
        covered = []
        for level, run in changes.live_runs(n, 4):
            covered += range(run * 4**level, (run + 1) * 4**level)
        assert sorted(covered) == list(range(n))


def plain_cut(rows, k):
    bins = [rows]
    while len(bins) < k:
        wide = [(max(max(r[c] for r in b) - min(r[c] for r in b) for c in (1, 2, 3)), i) for i, b in enumerate(bins) if len(b) > 1]
        if not wide:
            break
        b = bins.pop(max(wide)[1])
        axis = max((1, 2, 3), key=lambda c: (max(r[c] for r in b) - min(r[c] for r in b), -c))
        b = sorted(b, key=lambda r: (r[axis], r[0]))
        bins += [b[: len(b) // 2], b[len(b) // 2 :]]
    return [tuple(np.mean([r[c] for r in b]) for c in (1, 2, 3)) for b in bins]


@pytest.mark.parametrize("k", [1, 16])
def test_median_cut(spark, k):
    rng = np.random.default_rng(k)
    rows = [(i, *map(float, rng.integers(0, 4, 3) / 3)) for i in range(150)] + [(200 + i, 0.5, 0.5, 0.5) for i in range(60)] + [(300 + i, *map(float, rng.random(3))) for i in range(30)]
    df = spark.createDataFrame(rows, "idx long, r double, g double, b double").repartition(5)
    found = sorted((r.i, r.r, r.g, r.b) for r in palettes.median_cut(df, k).collect())
    want = plain_cut(rows, k)
    assert [r[0] for r in found] == list(range(len(want))) and np.allclose([r[1:] for r in found], want)


def test_median_cut_of_few(spark):
    df = spark.createDataFrame([(1, 0.1, 0.2, 0.3), (2, 0.1, 0.2, 0.3)], "idx long, r double, g double, b double")
    assert palettes.median_cut(df, 9).count() == 2
    assert palettes.median_cut(df.where(F.col("idx") < 0), 3).count() == 0


def test_median_cut_walks_once(spark, monkeypatch):
    """Boxes come from one Python step over batches; a UDF's column would be computed again for the filter above it."""
    from pyspark.sql import functions as F

    from pixelloom.operators.palettes import median_cut

    def none(*a, **k):
        raise AssertionError("a UDF a row")

    monkeypatch.setattr(F, "pandas_udf", none)
    pixels = spark.range(40).selectExpr("CAST(id AS INT) AS idx", "id / 40.0D AS r", "id % 3 / 3.0D AS g", "0.5D AS b")
    found = sorted(r.r for r in median_cut(pixels, 2).collect())
    assert [round(x, 6) for x in found] == [0.2375, 0.7375]
