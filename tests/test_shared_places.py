"""Stations at one place share their tallies and all that follows from these."""

import duckdb
import pytest

from locusmill import catalog, catalog_more  # noqa: F401 - adds its queries
from locusmill.operators import circles, stats

from test_catalog import SF, rows


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Ten suppliers at a place each 40 times under keys of their own, and some rows twice."""
    folder = tmp_path_factory.mktemp("shared")
    c = duckdb.connect()
    for t in ("part", "customer"):
        c.sql(f"copy (from '{SF}/{t}.parquet') to '{folder}/{t}.parquet'")
    many = f"select s.* replace (s_suppkey + i * 10000 as s_suppkey) from '{SF}/supplier.parquet' s, range(40) r(i)"
    c.sql(f"copy ({many} union all select * from ({many}) where s_suppkey % 7 = 3) to '{folder}/supplier.parquet'")
    for t in ("part", "customer", "supplier"):
        c.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", ["station_tally", "ring_lq", "ranked_by_lq", "lq_pivot", "notable_genres", "per_10k", "completion_edges", "completion_zeros", "area_row"])
def test_repeated_stations_match_sql(spark, shared, name):
    folder, duck = shared
    df, want = catalog.QUERIES[name](spark, folder), duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    assert rows(map(tuple, df.collect())) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_rings_are_made_by_place(spark, shared, monkeypatch):
    folder, duck = shared
    given = []
    monkeypatch.setattr(stats, "rings", lambda r, *a, made=stats.rings: given.append(r) or made(r, *a))
    n = catalog.QUERIES["ring_difference"](spark, folder).count()
    (stations,) = duck.sql("select count(distinct s_suppkey) from supplier").fetchall()[0]
    assert n > stations and given[0].count() < n / 10


def test_large_circles_have_larger_cells(spark, monkeypatch):
    """Rows are written once by place, and a circle of 16 times the radius has about as many cells."""
    written = {}

    class Kept(circles.Scratch):
        def table(self, df, name):
            written[name] = super().table(df, name)
            return written[name]

    monkeypatch.setattr(circles, "Scratch", Kept)
    centres = spark.createDataFrame([(1, 35.6, 139.7)], "centre long, lat double, lng double")
    v = spark.range(20_000).selectExpr("35.4 + id % 500 * 0.001 as lat", "139.7D as lng", "'a' as major")
    got = {r["radius"]: r["n"] for r in circles.tallies(centres, v, [1000, 16000], ["major"]).collect()}
    assert got == {1000: 40 * 17, 16000: 40 * 287}  # a thousandth of a degree is 111.19 m
    cells = {r["radius"]: r["count"] for r in written["cover"].groupBy("radius").count().collect()}
    assert written["places"].count() == 500 and cells[16000] < 3 * cells[1000]
