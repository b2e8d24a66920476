"""Tiles by URL."""

import pytest

from pixelloom.operators import tile_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('store')}/tiles"
    rows = [(1, 2, s, n, x, y, 7, x == 1, f"{s}{n}{x}{y}") for s in tile_store.STAGES for n in (0, 1) for x in range(3) for y in range(2)] + [(1, 0, "composite", 0, 0, 0, 4, False, "whole")]
    tile_store.write_store(spark.createDataFrame(rows, "doc long, layer long, stage string, level int, tx long, ty long, generation long, dirty boolean, body string"), path)
    return path


def test_answers(spark, store):
    want = {
        "tile://doc/1/layer/2/stage/raw/l/0/0/1": (200, 7, "raw001"), "tile://localhost/doc/1/layer/2/stage/processed/l/1/0/0?g=9": (200, 7, "processed100"), "tile://doc/01/layer/+2//stage/raw/l/0/2/1/": (200, 7, "raw021"),
        "tile://doc/1/layer/2/stage/raw/l/0/1/1": (202, None, None), "tile://doc/1/layer/composite/stage/composite/l/0/0/0": (202, None, None), "tile://doc/1/layer/2/stage/raw/l/0/2/2": (202, None, None),
        "tile://doc/1/layer/2/stage/raw/l/0/3/0": (404, None, None), "tile://doc/9/layer/2/stage/raw/l/0/0/0": (404, None, None), "tile://doc/1/layer/0/stage/raw/l/0/0/0": (404, None, None), "tile://doc/1/layer/2/stage/raw/l/2/1/0": (404, None, None),
        "tile://doc/1/layer/2/stage/cooked/l/0/0/0": (400, None, None), "tile://doc/1/layer/2/stage/raw/l/256/0/0": (400, None, None), "tile://doc/-1/layer/2/stage/raw/l/0/0/0": (400, None, None), "http://doc/1/layer/2/stage/raw/l/0/0/0": (400, None, None),
        "tile://doc/1/layer/2/stage/raw/l/0/0": (400, None, None), "tile://doc/1/layer/4294967296/stage/raw/l/0/0/0": (400, None, None), "tile://doc/1/tier/2/stage/raw/l/0/0/0": (400, None, None), "": (400, None, None), None: (400, None, None),
        "tile://doc/99999999999999999999/layer/2/stage/raw/l/0/0/0": (400, None, None),
    }
    documents = spark.createDataFrame([(1, 40, 40, 5)], "doc long, width int, height int, generation long")
    layers = spark.createDataFrame([(1, 2), (1, 3)], "doc long, layer long")
    requests = spark.createDataFrame([(u,) for u in want], "url string")
    found = tile_store.answered(requests, documents, layers, store, tile=16)
    assert {r.url: (r.status, r.generation, r.body) for r in found.collect()} == want
    assert tile_store.answered(requests.limit(0), documents, layers, store, tile=16).count() == 0


def test_lookups_open_the_folders_that_they_name(spark, store):
    wanted = spark.createDataFrame([("raw", 1)], "stage string, level int")
    plan = tile_store.read_store(spark, store, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "stage#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    found = tile_store.read_store(spark, store, wanted)
    assert {f.split("/tiles/")[1].rsplit("/", 1)[0] for f in found.inputFiles()} >= {"stage=raw/level=1"} and found.select("stage", "level").distinct().collect() == [("raw", 1)]


def test_morton(spark):
    rows = spark.createDataFrame([(x, y) for x in range(8) for y in range(8)], "x long, y long")
    found = {(r.x, r.y): r.m for r in rows.select("x", "y", tile_store.morton(rows.x, rows.y).alias("m")).collect()}
    assert all(m == sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(3)) for (x, y), m in found.items())
