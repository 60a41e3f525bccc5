"""Ordered passes against their plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from locusmill.operators import sequential, spatial
from locusmill.scratch import Scratch

STEP = 1 / 111194.9


def metres(a, b, c, d):
    a, c = math.radians(a), math.radians(c)
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def plain_duplicates(rows, limit):
    alive, dup = [], {}
    for i, core, lat, lng in sorted(rows):
        dup[i] = None
        for j, other, y, x in alive:
            short, long = sorted((core or "", other or ""), key=len)
            if None not in (lat, lng, y, x) and len(short) >= 2 and short in long and metres(y, x, lat, lng) <= limit:
                dup[i] = j
                break
        if dup[i] is None:
            alive.append((i, core, lat, lng))
    return dup


def awkward(n):
    """A chain in which each conflicts with the one before, a hub, copies, dense names and rows with nulls."""
    rng = random.Random(12)
    rows = [("chain", 10 + i * 20 * STEP, 5.0) for i in range(n // 3)]
    rows += [("hub" + "x" * (i % 3), 20.0, 5.0 + rng.random() * 20 * STEP) for i in range(n // 6)]
    rows += [("copy", 30.0, 5.0)] * (n // 6) + [("a", 30.0, 5.0)] * 5
    rows += [(rng.choice(("blue", "blue cafe", "cafe", "red", "")), 40 + rng.random() * 300 * STEP, 7 + rng.random() * 300 * STEP) for _ in range(n // 3)]
    rows += [(None, 30.0, 5.0), ("copy", None, 5.0), ("copy", 30.0, None), ("edge", 50.0, 180.0), ("edge", 50.0, -180 + 5 * STEP)]
    ids = rng.sample(range(10 * n), len(rows))
    ids[: n // 3] = sorted(ids[: n // 3])
    return [(i, *r) for i, r in zip(ids, rows)]


@pytest.mark.parametrize("most", [200_000, 40])
def test_duplicates_are_the_plain_loops(spark, most):
    rows = awkward(2000)
    df = spark.createDataFrame([(*r, "own") for r in rows], "row_id long, core string, lat double, lng double, owner string").repartition(5)
    if most == 40:  # rounds as well: every component above 40 conflicts
        df = df.where("core <> 'chain' or row_id % 4 > 0")
        rows = [r for r in rows if r[1] != "chain" or r[0] % 4]
        rows = [r for r in rows if r[1] is not None]
        df = df.where("core is not null")
    got = sequential.greedy_duplicates(df, 30.0, most)
    assert got.columns == ["row_id", "core", "lat", "lng", "owner", "dup_of"]
    assert {r["row_id"]: r["dup_of"] for r in got.collect()} == plain_duplicates(rows, 30.0)


def plain_merges(rows, limit):
    kept, into = {}, {}
    for name, o, lat, lng, n in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        into[name, o] = o
        if lat is None or lng is None:
            continue
        for k in kept.setdefault(name, []):
            if metres(k[1], k[2], lat, lng) <= limit:
                k[1], k[2], k[3] = (k[1] * k[3] + lat * n) / (k[3] + n), (k[2] * k[3] + lng * n) / (k[3] + n), k[3] + n
                into[name, o] = k[0]
                break
        else:
            kept[name].append([o, lat, lng, n])
    return into


def test_merges_are_the_plain_loops(spark):
    """Chains that drift, a ring whose centre comes near what no member is near, names across 180 degrees and near a pole."""
    rng = random.Random(3)
    rows = [("chain", i, 10 + i * 400 * STEP, 5.0, 1.0) for i in range(200)]
    rows += [("ring", i, 10 + 600 * STEP * math.sin(i), 5 + 600 * STEP * math.cos(i), 1.0 + i % 3) for i in range(60)] + [("ring", 99, 10.0, 5.0, 1.0)]
    rows += [("often", i, rng.uniform(-60, 60), rng.uniform(-179, 179), 1.0) for i in range(600)]
    rows += [("often", 1000 + i, 20 + rng.random() * 0.1, 20 + rng.random() * 0.1, 1.0) for i in range(600)]
    rows += [("edge", i, 10 + rng.random() * 0.01, (-1) ** i * (180 - rng.random() * 0.01), 1.0) for i in range(60)]
    rows += [("pole", i, 89.99 + rng.random() * 0.009, rng.uniform(-170, 170), 1.0) for i in range(60)]
    rows += [(None, i, 1 + i * 300 * STEP, 1.0, 2.0) for i in range(10)] + [("lost", 1, None, 1.0, 1.0), ("lost", 2, 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "name string, ord long, lat double, lng double, n double").repartition(6)
    got = {(r["name"], r["ord"]): r["into"] for r in sequential.merged_groups(df).collect()}
    assert got == plain_merges(rows, 500.0)
    deg = math.degrees(500 / 6371000) * 1.001
    cells = df.where("name = 'often'").select("name", F.floor(F.col("lat") / deg).alias("cy"), F.floor((F.col("lng") + 180) / 0.01).alias("cx"))
    parts = sequential._parts(cells, Scratch(spark, "test"), deg)
    assert parts.select("part").distinct().count() > 550  # a frequent name is many tasks


def test_pairs_everywhere(spark):
    """All pairs within a radius, beside the poles and across 180 degrees too."""
    rng = random.Random(5)
    spots = [(0.0, 0.0), (89.9995, 10.0), (-89.9995, -100.0), (70.0, 179.999), (-45.0, -179.999), (85.0, 50.0), (90.0, 0.0)]

    def near(k):
        out = []
        for i in range(k):
            lat, lng = rng.choice(spots)
            lat = max(-90.0, min(90.0, lat + rng.uniform(-0.01, 0.01)))
            lng = (lng + rng.uniform(-0.01, 0.01) / max(math.cos(math.radians(lat)), 1e-4) + 180) % 360 - 180
            out.append((i, lat, lng))
        return out

    a, b = near(150), near(300)
    got = spatial.cell_pairs(spark.createDataFrame([*a, (999, None, 1.0)], "s int, lat double, lng double"), spark.createDataFrame([*b, (999, 1.0, None)], "v int, lat double, lng double"), 700.0)
    want = {(i, j) for i, y, x in a for j, v, u in b if metres(y, x, v, u) <= 700}
    assert {(r["s"], r["v"]) for r in got.collect()} == want and len(want) > 500
