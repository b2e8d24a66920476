"""The operators on embeddings against brute force, and on nulls, odd lengths, ties, repeated rows and empty tables."""

import collections
import math

import numpy as np
import pytest

from tests.conftest import DATA

VECTORS = "vec_id long, embedding array<float>, label int, q string, node long, x int, rank int"


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]


def fine(x):
    return x is not None and all(c is not None and math.isfinite(c) for c in x)


def floored(x):
    return [math.floor(256 * c) for c in x]


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = (rng.integers(-4, 5, (150, 12)) / 4 + 0.01).tolist()
    rows = [(i, x, i % 4) for i, x in enumerate(base)]
    rows += [(300 + i, (np.array(base[i // 9]) + rng.normal(0, 0.03, 12)).tolist(), i // 9 % 4) for i in range(90)]
    rows += [(500, base[0], 0), (501, base[0], 0), (502, [0.0] * 12, 0), (503, None, 1), (504, [None] * 12, 1), (505, [math.inf] * 12, 1), (506, base[3], None), (507, [1.0, 2.0], 2), (508, [-1.0, -2.0], 2), (509, [], 1), (0, base[0], 0)]
    return spark.createDataFrame([(*r, "q", 1, 2, 3) for r in rows], VECTORS)


def test_bidiagonal_values_and_vectors():
    from pixelloom.llm.bidiagonal import right_vectors

    rng = np.random.default_rng(0)
    cases = [rng.standard_normal((90, 40)), rng.standard_normal((50, 3)) @ rng.standard_normal((3, 12)), np.eye(6), np.zeros((3, 4)), rng.standard_normal((3, 9)), rng.standard_normal((60, 20)) * 10.0 ** -np.arange(20), np.diag([3, 3 - 1e-9, 3 - 2e-9, 1.0]), np.array([[9e18, -100, -200], [-9e18, 100, 200.0]])]
    for a in cases:
        values, vectors = right_vectors(np.linalg.qr(a, mode="r"), 4)
        want = np.square(np.linalg.svd(a, compute_uv=False))
        top = max(want[0], 1e-300)
        assert np.abs(values[: len(want)] - want).max() <= 1e-13 * top
        assert np.abs(vectors @ vectors.T - np.eye(len(vectors))).max() < 1e-12
        assert np.abs(a.T @ (a @ vectors.T) - vectors.T * values[: len(vectors)]).max() <= 1e-13 * top


@pytest.mark.parametrize("source", ["table", "made"])
def test_whitening(spark, vectors, source):
    from pixelloom.llm.whitening import whitened

    df = spark.read.parquet(f"{DATA}/embeddings.parquet") if source == "table" else vectors.unionByName(vectors.where("vec_id = 5").selectExpr("cast(null as long) AS vec_id", "embedding", "label", "q", "node", "x", "rank"))
    rows = [(i, floored(x)) for i, x, _ in rows_of(df) if fine(x) and x]
    want = collections.Counter()
    fits = {}
    for w in {len(x) for _, x in rows}:
        fit = np.array(sorted({tuple(x) for _, x in rows if len(x) == w}))
        n, s = len(fit), fit.sum(0)
        c = fit - s / n
        e, v = np.linalg.eigh(c.T @ c / n)
        fits[w] = (n, s, e[::-1][:4], v[:, ::-1][:, :4].T, e.sum())
    for i, x in rows:
        n, s, e, v, total = fits[len(x)]
        for k in range(min(4, len(x))):
            value = None if e[k] <= 1e-9 * e[0] else round(abs(float((np.array(x) - s / n) @ v[k]) / math.sqrt(e[k])), 8)
            want[(i, k + 1, n, int(((n * np.array(x) - s) ** 2).sum()), value, round(e[k] / total + 0.0, 9))] += 1
    found = whitened(df).collect()
    assert all(r.identity_error < 1e-9 for r in found)
    assert collections.Counter((r.vec_id, r.component, r.n, r.deviation, None if r.whitened is None else round(abs(r.whitened), 8), round(r.explained, 9)) for r in found) == want


def test_whitening_of_extremes(spark):
    from pixelloom.llm import whitening as W

    rows = [(1, [1e30, 1.0, 0.0]), (2, [-1e30, 2.0, 4.0]), (3, [7.0]), (3, [7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {(r.vec_id, r.component): r for r in W.whitened(df).collect()}
    assert found[1, 1].deviation == 2**63 - 1 and abs(found[1, 1].whitened) == pytest.approx(1) and found[1, 2].whitened is None
    assert found[3, 1].n == 1 and found[3, 1].whitened is None and found[3, 1].explained == 0.0
    assert W.whitened(df.limit(0)).count() == 0
    n, s = 3, np.array([2**61, 5], object)
    x = np.array([[2**60, 1], [3, 4]])
    assert W._deviation(x, n, s).tolist() == [min(2**63 - 1, sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s))) for r in x]


def mined(rows, anchors, k=5):
    ok = [(i, label, floored(x)) for i, x, label in rows if i is not None and label is not None and fine(x)]
    out = []
    for anchor in sorted({i for i, _, _ in ok if i in anchors}):
        label, a = min((m, x) for i, m, x in ok if i == anchor)
        scored = sorted((-sum(p * q for p, q in zip(a, x)), i, m) for i, m, x in ok if i != anchor and len(x) == len(a))
        for s, p, _ in [t for t in scored if t[2] == label][:k]:
            found = [t for t in scored if t[2] != label and 80 * -s <= 100 * -t[0] <= 100 * -s][:k]
            out += [(anchor, p, r, n, -s, -t) for r, (t, n, _) in enumerate(found, 1)]
    return sorted(out)


def test_hard_negatives(spark, vectors, monkeypatch):
    from pixelloom.llm import hardneg as H

    rows = rows_of(vectors)
    asked = [i for i in range(0, 600, 6)] + [507, 502]
    some = vectors.where(vectors.vec_id.isin(asked))
    want = mined(rows, set(asked))
    assert len(want) > 300
    assert sorted(map(tuple, H.hard_negatives(vectors, some).collect())) == want
    assert sorted(map(tuple, H.hard_negatives(vectors, some, block_anchors=20).collect())) == want
    assert H.hard_negatives(vectors.limit(0), some.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [1, 10**5, 10**8, 10**15, 2**61])
def test_threshold_stops_early_and_scores_are_exact(scale):
    from pixelloom.llm import hardneg as H

    rng = np.random.default_rng(4)
    rows = rng.integers(-8, 9, (3000, 3)) * scale // 8 if scale > 8 else rng.integers(-8, 9, (3000, 3))
    ids, labels = np.arange(3000), np.zeros(3000, np.int64)
    anchors = np.array([rows[0], rows[1] * 0, np.maximum(rows[2], 1)])
    windows = [H.Windows([H.LEAST], [H.MOST], 4) for _ in anchors]
    H.search_block(ids, labels, rows, np.array([0, 1, 2]), np.zeros(3, np.int64), anchors, windows, True)
    for a, w in zip(anchors, windows, strict=True):
        j = list(anchors.tolist()).index(a.tolist())
        s = sorted((-max(H.LEAST, min(H.MOST, sum(int(p) * int(q) for p, q in zip(a, x)))), i) for i, x in enumerate(rows) if i != j)[:4]
        assert [(-y, x) for x, y in zip(w.ids[0].tolist(), w.scores[0].tolist())] == s
    far = H.Windows([0], [H.MOST], 4)
    spread = rng.permutation(np.arange(30000)).reshape(-1, 1)
    assert H.search_block(np.arange(30000), np.zeros(30000, np.int64), spread, np.array([-1]), np.zeros(1, np.int64), np.array([[5]]), [far], True) < 100


def linked(rows, least=0.98):
    ok = [(i, label, np.array(x, float)) for i, x, label in rows if label is not None and fine(x) and any(x)]
    links = [[n for n, (j, m, y) in enumerate(ok) if n != k and m == label and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= least] for k, (i, label, x) in enumerate(ok)]
    out = [(i, 0, i, True) for i, x, label in rows if not (label is not None and fine(x) and any(x))]
    for k, (i, _, _) in enumerate(ok):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        named = [ok[n][0] for n in seen if ok[n][0] is not None]
        out.append((i, len(links[k]), min(named) if named else None, (min(named) if named else None) == i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("members", [4096, 3])
def test_near_vectors(spark, vectors, members):
    from pixelloom.llm.vectordup import near_vectors

    extra = spark.createDataFrame([(None, [9.0, 1.0], 7, "q", 1, 2, 3), (None, [9.1, 1.0], 7, "q", 1, 2, 3), (900, [-0.0, 3.0], 7, "q", 1, 2, 3), (901, [0.0, 3.0], 7, "q", 1, 2, 3)], VECTORS)
    df = vectors.unionByName(extra)
    want = linked(rows_of(df))
    assert sum(r[1] for r in want) > 200
    found = near_vectors(df, members=members)
    assert sorted(map(tuple, found.collect()), key=repr) == want
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_a_large_group(spark):
    """A third of all rows near one vector, others near the threshold's angle: none of the links is lost."""
    from pixelloom.llm.vectordup import near_vectors

    rng = np.random.default_rng(5)
    heart = rng.normal(0, 1, 24)
    rows = [(i, (heart + rng.normal(0, 0.05, 24)).tolist(), 1) for i in range(400)]
    rows += [(1000 + i, (heart + rng.normal(0, 0.16, 24)).tolist(), 1) for i in range(120)]
    rows += [(2000 + i, rng.normal(0, 1, 24).tolist(), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = linked(rows_of(df))
    assert sorted(map(tuple, near_vectors(df, members=100).collect()), key=repr) == want


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_near_dedup"])
def test_query_equals_sql(spark, duck, name):
    from pixelloom.llm import queries as Q

    df = Q.queries()[name](spark, DATA)
    result = duck.execute(Q.oracle_sql()[name])
    names = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in sorted(names)) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall())
