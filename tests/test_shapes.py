"""Outlines of regions against a flood fill and the even-odd rule."""

import numpy as np

from pixelloom.operators import regions


def flood(colour):
    """The first pixel, by row, of each pixel's region; -1 outside of all."""
    h, w = colour.shape
    root = np.full(colour.shape, -1)
    for y, x in np.argwhere(colour >= 0):
        if root[y, x] >= 0:
            continue
        todo, root[y, x] = [(y, x)], y * w + x
        while todo:
            a, b = todo.pop()
            for p, q in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                if 0 <= p < h and 0 <= q < w and root[p, q] < 0 and colour[p, q] == colour[y, x]:
                    root[p, q] = y * w + x
                    todo.append((p, q))
    return root


def filled(rings, h, w):
    sides = np.zeros((h, w + 1), int)
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            assert (x1 == x2) != (y1 == y2)
            if x1 == x2:
                sides[min(y1, y2) : max(y1, y2), x1] ^= 1
    return np.cumsum(sides, 1)[:, :w] % 2


def frame(spark, colours):
    rows = [(i, int(x), int(y), int(c) if c >= 0 else 0, 0, 7, 255 if c >= 0 else 0) for i, colour in colours.items() for (y, x), c in np.ndenumerate(colour)]
    return spark.createDataFrame(rows, "image int, gx int, gy int, r int, g int, b int, a int")


def shapes():
    rng = np.random.default_rng(0)
    donut = np.zeros((9, 9), int)
    donut[2:7, 2:7] = 1
    donut[4, 4] = 0
    donut[0, 8] = -1
    snake = np.ones((24, 24), int)
    snake[1::4, :-1] = 0
    snake[3::4, 1:] = 0
    noise, sponge, small = rng.integers(-1, 2, (30, 33)), (rng.random((40, 50)) < 0.62).astype(int), rng.integers(0, 2, (4, 3))
    return dict(enumerate([np.zeros((10, 10), int), np.indices((8, 8)).sum(0) % 2, donut, snake, noise, sponge, small, np.full((3, 3), -1)], 3))


def test_outlines_fill_their_regions(spark):
    found = regions.outlines(frame(spark, shapes()), 6)
    rows, paths = found.collect(), {(r.image, r.region): r for r in regions.svg_paths(found).collect()}
    for image, colour in shapes().items():
        h, w = colour.shape
        root = flood(colour)
        rings = {}
        for r in sorted((r for r in rows if r.image == image), key=lambda r: (r.region, r.loop, r.part)):
            at = (r.region >> 28) * w + r.region % (1 << 28)
            assert r.colour >> 24 == colour[divmod(at, w)]
            rings.setdefault(at, {}).setdefault((r.hole, r.loop), []).extend(zip(r.points[::2], r.points[1::2], strict=True))
        assert set(rings) == set(root[root >= 0].tolist())
        for region, own in rings.items():
            assert sum(not hole for hole, _ in own) == 1
            for ring in own.values():
                assert all(not (a[0] == b[0] == c[0] or a[1] == b[1] == c[1]) for a, b, c in zip(ring, ring[1:] + ring[:1], ring[2:] + ring[:2], strict=True))
            assert (filled(list(own.values()), h, w) == (root == region)).all()
            path = paths[image, region // w << 28 | region % w]
            assert path.d == " ".join("M" + " L".join(f"{x} {y}" for x, y in own[k]) + " Z" for k in sorted(own))
    assert paths[3, 0].d == "M0 0 L10 0 L10 10 L0 10 Z" and paths[3, 0].fill == "#000007" and paths[3, 0].opacity == 1.0


def test_outlines_of_nothing(spark):
    assert regions.outlines(frame(spark, shapes()).limit(0), 2).count() == 0


def test_least_label():
    assert regions.least_label(6, np.array([4, 2, 5]), np.array([2, 1, 3])).tolist() == [0, 1, 1, 3, 1, 3]


def plain_mesh(px, tolerance):
    """The whole image at once, pixel by pixel."""
    h, w, _ = px.shape
    px, taken, out = px.astype(int), np.zeros((h, w), bool), []
    for y in range(h):
        for x in range(w):
            c = px[y, x]
            fits = lambda a, b: not taken[b, a] and (abs(px[b, a] - c) <= tolerance).all()
            if taken[y, x] or c[3] == 0:
                continue
            rw = 1
            while x + rw < w and fits(x + rw, y):
                rw += 1
            rh = 1
            while y + rh < h and all(fits(x + i, y + rh) for i in range(rw)):
                rh += 1
            taken[y : y + rh, x : x + rw] = True
            out.append((x, y, rw, rh, *map(int, c)))
    return out


def test_rectangles_equal_those_of_the_whole_image(spark):
    from pixelloom.operators.mesh import rectangles

    rng = np.random.default_rng(6)
    blocks = np.kron(rng.integers(0, 3, (6, 5)), np.ones((4, 3), int)) * 40
    images = {1: blocks + rng.integers(0, 3, blocks.shape), 2: rng.integers(0, 2, (9, 11)) * 9, 3: np.full((17, 4), 7), 4: rng.integers(0, 2, (3, 3)) * 100}
    full = {}
    for i, v in images.items():
        alpha = np.where(rng.random(v.shape) < 0.1, 0, 255) if i != 3 else np.full(v.shape, 255)
        full[i] = np.stack([v, v // 2, np.full(v.shape, 5), alpha], 2)
        full[i][-1, -1, 3] = 255
    rows = [(i, x, y, *map(int, px[y, x])) for i, px in full.items() for y in range(px.shape[0]) for x in range(px.shape[1])]
    df = spark.createDataFrame(rows, "image int, gx int, gy int, r int, g int, b int, a int")
    for tolerance in (0, 2):
        clear = {i: np.where(px[..., 3:] > 0, px, 0) for i, px in full.items()}
        want = sorted((i, *r) for i, px in clear.items() for r in plain_mesh(px, tolerance))
        assert sorted(map(tuple, rectangles(df, tolerance, band=4).collect())) == want
    assert rectangles(df.limit(0)).count() == 0
