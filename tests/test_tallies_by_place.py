"""Tally queries: what is made by place, and stations and parts with nulls."""

import duckdb
import pytest

from locusmill import catalog, catalog_more  # noqa: F401 - adds its queries
from locusmill.operators import circles, stats

from test_catalog import SF, rows


def tables(folder, supplier, part="from s"):
    c = duckdb.connect()
    for t, sql in (("part", part), ("supplier", supplier), ("customer", "from s")):
        c.sql(f"copy (with s as (from '{SF}/{t}.parquet') {sql}) to '{folder}/{t}.parquet'")
        c.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    return str(folder), c


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    """Ten suppliers at a place each 40 times under keys of their own, and some rows twice."""
    many = "select s.* replace (s_suppkey + i * 10000 as s_suppkey) from s, range(40) r(i)"
    return tables(tmp_path_factory.mktemp("by-place"), f"{many} union all select * from ({many}) where s_suppkey % 7 = 3")


@pytest.fixture(scope="module")
def holes(tmp_path_factory):
    supplier = "from s union all select s.* replace (null as s_suppkey) from s where s_suppkey < 3 union all select s.* replace (null as s_acctbal) from s where s_suppkey % 3 = 1"
    part = "select s.* replace (case when p_partkey % 50 <> 7 then p_partkey end as p_partkey, case when p_partkey % 11 <> 3 then p_name end as p_name, case when p_partkey % 13 <> 5 then p_type end as p_type) from s"
    return tables(tmp_path_factory.mktemp("holes"), supplier, part)


def matches(spark, given, name):
    folder, duck = given
    df, want = catalog.QUERIES[name](spark, folder), duck.sql(catalog.ORACLES[name])
    at = [want.columns.index(c) for c in df.columns]
    return rows(map(tuple, df.collect())) == rows(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["station_totals", "ring_difference", "compared_stations"])
def test_repeated_stations(spark, shared, name):
    assert matches(spark, shared, name)


@pytest.mark.parametrize("name", ["completion_edges", "completion_zeros", "per_10k"])
def test_nulls(spark, holes, name):
    assert matches(spark, holes, name)


@pytest.mark.parametrize("name, step", [("station_totals", "totals"), ("station_tally", "tally"), ("lq_pivot", "wide")])
def test_made_by_place(spark, shared, monkeypatch, name, step):
    given, made = [], getattr(stats, step)
    monkeypatch.setattr(stats, step, lambda r, *a, **k: given.append(r) or made(r, *a, **k))
    catalog.QUERIES[name](spark, shared[0])
    assert {"spot"} <= set(given[0].columns) and "station" not in given[0].columns
    assert given[0].select("spot").distinct().count() <= 20  # ten places, each once or twice


def test_only_compared_stations_have_circles(spark, shared, monkeypatch):
    written = {}

    class Kept(circles.Scratch):
        def table(self, df, name):
            written[name] = super().table(df, name)
            return written[name]

    monkeypatch.setattr(circles, "Scratch", Kept)
    assert catalog.QUERIES["compared_stations"](spark, shared[0]).count() > 0
    (asked,) = shared[1].sql("select count(distinct s_suppkey) from supplier where s_suppkey <= 5").fetchall()[0]
    assert written["spots"].count() == asked < 10
    assert {r["radius"] for r in written["cover"].select("radius").distinct().collect()} == {5000}
