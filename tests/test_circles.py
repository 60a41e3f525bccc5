"""Circle tallies against all distances."""

import math
import random

import numpy as np
import pytest

from locusmill.operators import circles


@pytest.mark.parametrize("spots", [[(35.6, 139.7)], [(10.0, 180.0), (-20.0, -179.99), (89.98, 20.0), (90.0, 0.0), (-89.99, 0.0), (0.0, 0.0)]])
def test_tallies_are_the_pairs(spark, spots):
    rng = random.Random(2)

    def near(n, spread):
        out = []
        for i in range(n):
            lat, lng = rng.choice(spots)
            lat = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
            out.append((i, lat, (lng + rng.uniform(-spread, spread) / max(math.cos(math.radians(lat)), 1e-3) + 180) % 360 - 180))
        return out

    few, many = near(25, 0.02), near(1500, 0.05)
    many += [(9000 + i, *few[0][1:]) for i in range(500)]  # a full place
    rows = [(lat, lng, "ab"[i % 2], None if i % 5 == 0 else "m", 0.5 + i % 3) for i, lat, lng in many]
    v = spark.createDataFrame([*rows, (None, 1.0, "a", "m", 1.0)], "lat double, lng double, major string, mid string, weight double")
    c = spark.createDataFrame([*few, (99, None, 1.0)], "centre long, lat double, lng double")
    radii = [300, 1000, 4000]
    got = {(r["centre"], r["radius"], r["major"], r["mid"]): (r["n"], round(r["n_w"], 6)) for r in circles.tallies(c, v, radii, ["major", "mid"], "weight").collect()}
    lat, lng = (np.array([r[k] for r in rows]) for k in (0, 1))
    want = {}
    for i, y, x in few:
        m = circles._metres(y, x, lat, lng)
        for radius in radii:
            for k in np.flatnonzero(m <= radius):
                n, w = want.get(key := (i, radius, rows[k][2], rows[k][3]), (0, 0.0))
                want[key] = n + 1, w + rows[k][4]
    assert got == want and len(want) > 100


def test_rims_are_thin():
    """A circle of many cells takes most of its area from few large ones."""
    found = circles.circle_cells(35.6, 139.7, 5000, 2.0**-10)
    whole, rim = (sum(len(r) for _, r, _, w in found if w is k) for k in (True, False))
    area = sum(len(r) * 16**level for level, r, _, w in found if w)
    assert whole + rim < 1300 and area > 4 * rim


def test_centres_at_one_place_share_circles(spark, monkeypatch):
    written = {}

    class Kept(circles.Scratch):
        def table(self, df, name):
            written[name] = super().table(df, name)
            return written[name]

    monkeypatch.setattr(circles, "Scratch", Kept)
    centres = spark.range(500).selectExpr("id as centre", "35.6 + id % 2 * 0.01 as lat", "139.7D as lng")
    rows = spark.range(900).selectExpr("35.6 + id % 30 * 0.001 as lat", "139.7D as lng", "'a' as major")
    got = circles.tallies(centres, rows, [1000], ["major"]).collect()
    assert written["cover"].count() < 2 * 400 and len(got) == 500
    assert {(r["centre"] % 2, r["n"]) for r in got} == {(0, 9 * 30), (1, 18 * 30 - 30)}
