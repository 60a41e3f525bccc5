"""Cells, unions and chains against plain computations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import chains, cover, spatial
from locusmill.scratch import Scratch

RNG = np.random.default_rng(8)


def star(cx, cy, r, n, rough=0.4):
    a = np.sort(RNG.uniform(0, 2 * math.pi, n))
    d = r * RNG.uniform(1 - rough, 1, n)
    p = [(float(cx + x), float(cy + y)) for x, y in zip(d * np.cos(a), d * np.sin(a))]
    return [*p, p[0]]


def box(x0, y0, x1, y1):
    return [(float(x), float(y)) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def odd(rings, x, y):
    inside = np.zeros(np.broadcast(x, y).shape, bool)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            if ay != by:
                inside ^= ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return inside


def test_points_find_their_polygon(spark):
    """Holes, parts, thousands of edges, polygons that overlap, touch borders of cells and lie beyond zero."""
    shapes = [
        (3, [star(0.3, 0.2, 0.4, 3000), star(0.3, 0.2, 0.15, 500), star(0.3, 0.2, 0.05, 7)]),
        (1, [star(0.1, -0.1, 0.3, 40), star(1.2, 0.9, 0.2, 60)]),
        (2, [box(-0.5, -0.5, 0.0, 0.0), box(-0.25, -0.375, -0.125, -0.125)]),
        (5, [box(-0.9, -0.9, 1.5, 1.5)]),
        (9, []),
        (8, [[(0.0, 0.0)]]),
    ]
    xy = [*RNG.uniform(-1, 1.6, (2500, 2)).tolist(), *[[i / 16 - 0.5, j / 16 - 0.5] for i in range(9) for j in range(9)], [0.3, 0.2], [0.3, 0.2], [None, 1.0]]
    points = spark.createDataFrame([(i, x, y, "own") for i, (x, y) in enumerate(xy)], "n int, lng double, lat double, id string")
    polygons = spark.createDataFrame([(f"p{o}", o, r) for o, r in shapes], "id string, ord int, rings " + cover.POLYGON)
    want = {}
    for i, (x, y) in enumerate(xy):
        held = [o for o, r in shapes if x is not None and r and odd(r, np.float64(x), np.float64(y))]
        want[i] = f"p{min(held)}" if held else None
    assert len(set(want.values())) == 5
    for levels, most in ((1, 24), (3, 6)):
        got = cover.located(points, polygons, levels=levels, most=most)
        assert got.columns == ["n", "lng", "lat", "id", "area"]
        found = got.collect()
        assert {r["n"]: r["area"] for r in found} == want and len(found) == len(xy)
    inside = spatial.in_union(points, polygons).select("n").collect()
    assert sorted(r["n"] for r in inside) == sorted(i for i, a in want.items() if a)
    sizes = cover.cells(polygons, 0.0625, 4, 3, 24).where("not whole").agg(F.max(F.size("edges"))).first()[0]
    assert sizes < 200


def test_union_and_holes(spark):
    """Overlapping, adjacent, nested and touching polygons; areas by a fine grid of points and by hand."""
    a = [(1, [star(0.2, 0.2, 0.15, 30)]), (1, [star(0.3, 0.25, 0.15, 50)]), (1, [star(0.7, 0.7, 0.1, 20), star(0.7, 0.7, 0.03, 9)])]
    frame = [(2, [box(0, 0, 0.5, 0.125)]), (2, [box(0, 0.375, 0.5, 0.5)]), (2, [box(0, 0, 0.125, 0.5)]), (2, [box(0.375, 0, 0.5, 0.5)]), (2, [box(0.2, 0.2, 0.3, 0.3)])]
    touching = [(3, [box(0, 0, 0.25, 0.25)]), (3, [box(0.25, 0.25, 0.5, 0.5)]), (3, [box(0.25, 0, 0.5, 0.25)]), (3, [box(0.25, 0, 0.5, 0.25)]), (4, [])]
    corner = [(5, [box(0, 0, 0.25, 0.25)]), (5, [box(0.25, 0.25, 0.5, 0.5)])]
    p = spark.createDataFrame(a + frame + touching + corner, "area int, rings " + cover.POLYGON)
    got = {r["area"]: r for r in cover.sizes(p, Scratch(spark, "test"), 1.0, 1.0).collect()}
    g = (np.arange(2000) + 0.5) / 2000
    x, y = np.meshgrid(g, g)
    inside = np.logical_or.reduce([odd(r, x, y) for _, r in a])
    filled = np.logical_or.reduce([odd(r[:1], x, y) for _, r in a])
    assert sorted(got) == [1, 2, 3, 5]
    assert abs(got[1]["km2"] - inside.mean()) < 2e-4 and abs(got[1]["filled_km2"] - filled.mean()) < 2e-4
    assert got[2]["km2"] == pytest.approx(0.25 - 0.0625 + 0.01, abs=1e-9) and got[2]["filled_km2"] == pytest.approx(0.25, abs=1e-9)
    assert got[3]["km2"] == pytest.approx(3 / 16, abs=1e-9) and got[5]["filled_km2"] == pytest.approx(1 / 8, abs=1e-9)
    rings = cover.united(p.where("area <> 1"), Scratch(spark, "test")).collect()
    assert sorted((r["area"], r["outer"]) for r in rings) == [(2, False), (2, True), (2, True), (3, True), (5, True), (5, True)]
    assert all(r["points"][0] == r["points"][-1] for r in rings)
    assert [r["outer"] for r in cover.united(p.where("area = 2"), Scratch(spark, "test"), filled=True).collect()] == [True]


def test_lines_are_merged(spark):
    """A line of 10 000 shuffled segments in either direction, a ring, a fork, repeats and loose ends."""
    n = 10_000
    long = [("long", i, 0.0, i + 1, 0.0) if i % 3 else ("long", i + 1, 0.0, i, 0.0) for i in range(n)]
    ring = [("ring", 0.0, 0.0, 1.0, 0.0), ("ring", 1.0, 1.0, 1.0, 0.0), ("ring", 1.0, 1.0, 0.0, 0.0)]
    fork = [("fork", 0.0, 0.0, 1.0, 0.0), ("fork", 1.0, 0.0, 2.0, 0.0), ("fork", 1.0, 0.0, 1.0, 1.0), ("fork", 1.0, 1.0, 1.0, 2.0), ("fork", 1.0, 2.0, 1.0, 1.0), ("fork", 5.0, 5.0, 5.0, 5.0), ("fork", None, 1.0, 1.0, 1.0)]
    rows = [(k, *[None if v is None else float(v) for v in s]) for k, *s in [*long, *ring, *fork]]
    df = spark.createDataFrame([rows[i] for i in RNG.permutation(len(rows))], "key string, x1 double, y1 double, x2 double, y2 double")
    found = chains.merged_lines(df, Scratch(spark, "test"))
    got = {}
    for r in found.withColumn("m", chains.length_m(F.col("points"), 2.0, 1.0)).withColumn("half", chains.along(F.col("points"), F.lit(0.5))).collect():
        got.setdefault(r["key"], []).append(r)
    (line,) = got["long"]
    xs = [p["x"] for p in line["points"]]
    assert xs in (list(range(n + 1)), list(range(n, -1, -1))) and not line["closed"] and line["m"] == 2 * n and line["half"]["x"] == n / 2
    (loop,) = got["ring"]
    assert loop["closed"] and len(loop["points"]) == 4 and loop["points"][0] == loop["points"][-1]
    assert sorted(len(r["points"]) for r in got["fork"]) == [2, 2, 3]
    bent = spark.range(1).select(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0.0), (1, 0.01), (2, 0.5), (3, 0.0), (4, 0.0))]).alias("p"))
    assert [v["x"] for v in bent.select(chains.simplified(F.col("p"), 0.3).alias("p")).first()["p"]] == [0, 2, 4]


@pytest.mark.parametrize("n", [1, 9])
def test_paths_and_rings_are_ranked(spark, n):
    ids = RNG.permutation(4 * n).tolist()
    path, ring = ids[: 2 * n], ids[2 * n :]
    links = [(a, b) for a, b in zip(path, [*path[1:], None])] + [(a, b) for a, b in zip(ring, [*ring[1:], ring[0]])]
    got = {r["node"]: (r["chain"], r["rank"]) for r in chains.ranked(spark.createDataFrame(links, "node long, next long"), Scratch(spark, "test")).collect()}
    turned = ring[ring.index(min(ring)) :] + ring[: ring.index(min(ring))]
    assert got == {k: (c, i) for p, c in ((path, path[-1]), (turned, min(ring))) for i, k in enumerate(p)}
