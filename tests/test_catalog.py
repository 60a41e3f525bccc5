"""Every query with SQL gives what DuckDB gives."""

import math

import duckdb
import numpy as np
import pytest

from locusmill import catalog, catalog_more  # noqa: F401 - adds its queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents labels embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found):
    def value(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else round(x, 5) if isinstance(x, float) else x

    return sorted((tuple(map(value, r)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert rows(tuple(r[c] for c in cols) for r in df.collect()) == rows(tuple(r[i] for i in at) for r in want.fetchall())


def test_mesh_coverage_of_every_part(spark, duck):
    """Brute force over all stations, parts and grid points."""

    def place(k):
        return 35.6 + k * 7919 % 2000 / 1e4, 139.6 + k * 104729 % 2500 / 1e4

    parts = np.array([k for (k,) in duck.sql("select p_partkey from part").fetchall()])
    lat, lng = (x[:, None, None] for x in place(parts))
    grid = (np.arange(10) + 0.5) / 10
    lat, lng = np.radians(lat + grid[:, None] * 0.01), np.radians(lng + grid * 0.0125)
    want = []
    for (s,) in duck.sql("select s_suppkey from supplier").fetchall():
        a, b = map(math.radians, place(s * 37 + 11))
        h = np.sin((lat - a) / 2) ** 2 + math.cos(a) * np.cos(lat) * np.sin((lng - b) / 2) ** 2
        hits = (2 * 6371000 * np.arcsin(np.sqrt(h)) <= 2000).sum((1, 2))
        if hits.any():
            want.append((s, (int((hits * (parts % 97)).sum()) + 50) // 100, int((hits > 0).sum())))
    assert len(set(parts[parts % 20 != 0].tolist())) > 0 and sum(n for _, _, n in want) > 20
    got = catalog.QUERIES["mesh_coverage"](spark, SF).select("station", "people", "cells").collect()
    assert sorted(map(tuple, got)) == sorted(want)
