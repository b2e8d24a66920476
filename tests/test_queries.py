"""Registered queries against their SQL."""

import math
import random

import pytest

from tests.conftest import DATA

from pixelloom.plans import raster_queries, shape_queries, state_queries

QUERIES = {**raster_queries.QUERIES, **state_queries.QUERIES, **shape_queries.QUERIES}
SQL = {**raster_queries.SQL, **state_queries.SQL, **shape_queries.SQL}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, found):
    order = sorted(columns)
    at = [list(columns).index(c) for c in order]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, DATA).limit(5).count() > 0


@pytest.mark.parametrize("name", ["src7_palette_ase", "src8_palette_aco", "src10_palette_pal", "src11_palette_csv", "src12_palette_json", "snk8_palette_gpl"])
def test_palettes_beyond_a_format_limit(spark, monkeypatch, name):
    events = spark.range(70000).selectExpr("id AS event_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "id % 7 / 10.0D AS value", "id % 50 AS user_id")
    monkeypatch.setattr(state_queries, "table", lambda *a: events)
    found = QUERIES[name](spark, DATA).collect()
    assert sorted((r.i, r.b) for r in found) == [(i, i * 11 % 256) for i in range(70000)]


@pytest.mark.parametrize("name", ["src8_palette_aco", "src12_palette_json"])
def test_palettes_are_packed_and_parsed_in_turn(spark, name):
    """One Python step a stage: the files lie between; parsing holds one file's colours, not a batch's."""
    import json

    import pyarrow as pa

    from pixelloom.sources import palette_files as P

    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and "MapInArrow" in plan
    colors = [(1, 2, 3), (255, 0, 7)]
    assert json.loads(P.to_json(colors)) == [{"r": 1, "g": 2, "b": 3}, {"r": 255, "g": 0, "b": 7}]
    bodies = pa.record_batch({"name": ["x", None], "kind": ["json", "aco"], "body": [P.to_json(colors), P.to_aco(colors)]})
    first, second = P._rows(iter([bodies]))
    assert first.to_pylist() == [{"name": "x", "i": i, "r": r, "g": g, "b": b} for i, (r, g, b) in enumerate(colors)]
    assert second.column("name").to_pylist() == [None, None] and second.column("r").to_pylist() == [1, 255]


def test_canvas_beyond_a_side_limit(spark, monkeypatch):
    monkeypatch.setattr(state_queries, "event_raster", lambda spark, d: spark.createDataFrame([(1, 9000)], "gx int, gy int"))
    found = QUERIES["src2_blank"](spark, DATA)
    assert found.distinct().count() == 2 * 9001 and found.agg({"gy": "max"}).first()[0] == 9000


def test_gamut_clip_in_batches(spark):
    """Chroma against a bisection row by row; no lambda over steps is left in the plan."""
    from pyspark.sql import functions as F

    from pixelloom.functions import color as C

    rng = random.Random(5)
    lab = [(rng.random(), rng.uniform(-0.4, 0.4), rng.uniform(-0.4, 0.4)) for _ in range(300)] + [(0.5, 0.01, 0.0), (None, 0.3, 0.3), (0.5, None, 0.1), (1.0, 0.0, 0.0)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(lab)], "i int, l double, a double, b double").repartition(3)
    df = df.select("i", *(x.alias(n) for x, n in zip(C.gamut_clip([F.col(c) for c in "lab"]), "lab", strict=True)))

    def out(l, a, b):
        lms = [(l + j * a + k * b) ** 3 for _, j, k in C.FROM_LAB]
        return max(abs(sum(k * x for k, x in zip(row, lms, strict=True)) - 0.5) for row in C.TO_RGB) > 0.5 + 1e-4

    found = {r.i: (r.l, r.a, r.b) for r in df.collect()}
    for i, x in enumerate(lab):
        want = x
        if None not in x and out(*x):
            low, high, h = 0.0, math.hypot(x[1], x[2]), math.atan2(x[2], x[1])
            for _ in range(32):
                mid = (low + high) / 2
                low, high = (low, mid) if out(x[0], mid * math.cos(h), mid * math.sin(h)) else (mid, high)
            want = (x[0], low * math.cos(h), low * math.sin(h))
        assert all((u is None and v is None) or abs(u - v) < 1e-8 for u, v in zip(found[i], want, strict=True))
    assert "aggregate(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
