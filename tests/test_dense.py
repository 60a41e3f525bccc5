"""Queries on tables that fill every place, or have many rows at each, against DuckDB."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from locusmill import catalog, catalog_more  # noqa: F401 - adds its queries
from locusmill.operators import spatial

NAMES = [f"{a} {b}" for a in ("small", "hot", "old", "blue", "new") for b in ("ring", "bolt", "gear", "gizmo", "anvil")]
TYPES = ["PROMO", "LARGE", "SMALL", "ECONOMY", "MEDIUM"]


def written(folder, parts, stations):
    """Tables of parts (customers have the same keys) and suppliers."""
    c = duckdb.connect()
    c.sql(f"create table part as select CAST(k AS BIGINT) AS p_partkey, {NAMES}[1 + k * 7 % 23 % {len(NAMES)}] AS p_name, {TYPES}[1 + k % 11 % {len(TYPES)}] AS p_type from (select unnest({parts}) AS k)")
    c.sql("create table customer as select p_partkey AS c_custkey, CAST(p_partkey % 25 AS INTEGER) AS c_nationkey, 0e0 AS c_acctbal, ['BUILDING', 'MACHINERY', 'OTHER'][1 + p_partkey % 3] AS c_mktsegment from part")
    c.sql(f"create table supplier as select CAST(k AS BIGINT) AS s_suppkey, CAST(k % 2 AS INTEGER) AS s_nationkey, CAST(k % 7 AS DOUBLE) AS s_acctbal from (select unnest({stations}) AS k)")
    for t in ("part", "customer", "supplier"):
        c.sql(f"copy {t} to '{folder}/{t}.parquet'")
    return c, str(folder)


@pytest.fixture(scope="module")
def full(tmp_path_factory):
    return written(tmp_path_factory.mktemp("full"), list(range(10_000)), [1])


@pytest.fixture(scope="module")
def dense(tmp_path_factory):
    """Some places with several rows each: keys that differ by 10 000 have one place."""
    return written(tmp_path_factory.mktemp("dense"), [i + 10_000 * j for i in range(0, 600, 7) for j in range(4)], [i + 10_000 * j for i in range(30) for j in range(3)] + [7 + 10_000 * j for j in range(3, 9)])


def same_as_sql(spark, tables, name):
    duck, sf = tables
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(f"select {', '.join(cols)} from ({catalog.ORACLES[name]})").fetchall()
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and want
    return got


@pytest.mark.parametrize("name", ["point_in_polygon", "point_in_union"])
def test_points_on_borders(spark, full, name):
    same_as_sql(spark, full, name)


def test_routes_pass_one_place_often(spark, dense):
    same_as_sql(spark, dense, "merged_routes")


@pytest.mark.parametrize("name", ["nearest_match", "nearest_k", "mesh_coverage", "fuzzy_nearest", "scored_nearest", "name_filter"])
def test_full_places_meet_once(spark, dense, name, monkeypatch):
    """Only distinct places are paired, whatever their rows."""
    met, plain = [], spatial.cell_pairs

    def counted(few, many, radius):
        met.append((few.count(), many.count()))
        return plain(few, many, radius)

    monkeypatch.setattr(spatial, "cell_pairs", counted)
    same_as_sql(spark, dense, name)
    assert met and all(a <= 86 and b <= 86 for a, b in met)


@pytest.mark.parametrize("name", ["near_pairs", "dedupe_components", "representatives", "venue_clusters", "representative_rows"])
def test_near_classes(spark, dense, name, monkeypatch):
    """Names meet once a class and place: far fewer are compared than there are pairs of rows."""
    from locusmill.operators import link

    seen, plain = [], link._classes

    def counted(rows, *args):
        members, pairs = plain(rows, *args)
        seen.append((pairs.count(), members.groupBy("cls").count().selectExpr("sum(count * count)").first()[0]))
        return members, pairs

    monkeypatch.setattr(link, "_classes", counted)
    same_as_sql(spark, dense, name)
    assert seen and all(n < m for n, m in seen)


def test_pairs_are_spelled_out_from_places(spark, dense, monkeypatch):
    """Lists of ids at distinct places meet, and lists longer than a block are several."""
    lists, plain = [], spatial._blocks

    def counted(rows, key):
        found = plain(rows, key)
        lists.append((found.count(), rows.count(), found.agg({"n": "max"}).first()[0]))
        return found

    monkeypatch.setattr(spatial, "_blocks", counted)
    got = same_as_sql(spark, dense, "station_range_join")
    assert all(a * 2 < b for a, b, _ in lists) and len(lists) == 2
    monkeypatch.setattr(spatial, "BLOCK", 2)
    lists.clear()
    assert sorted(same_as_sql(spark, dense, "station_range_join")) == sorted(got)
    assert max(n for *_, n in lists) < 9


def test_a_full_cell_is_many_tasks(spark, monkeypatch):
    """Rows at one place are dealt to many tasks, and every pair is met once; a key that comes often is in many lists."""
    monkeypatch.setattr(spatial, "BLOCK", 8)
    monkeypatch.setattr(spatial, "MEETINGS", 2000)
    a = spark.createDataFrame([(i if i < 200 else 7, 35.6, 139.7) for i in range(400)], "s int, lat double, lng double")
    b = spark.createDataFrame([(i, 35.6, 139.7) for i in range(300)], "v int, lat double, lng double")
    got = spatial.id_pairs(a, b, [1000, 5000], "s", "v")
    per = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 400 * 300 * 2 and len(per) > 15 and max(per) < 40_000
    times = {(r["s"], r["n"]): r["count"] for r in got.groupBy("s", "v", "radius").agg(F.count("*").alias("n")).groupBy("s", "n").count().collect()}
    assert times == {(i, 201 if i == 7 else 1): 600 for i in range(200)}
    assert spatial._blocks(a, "s").agg(F.max("n")).first()[0] < 32


def test_pairs_are_spelled_out_list_by_list(spark, dense):
    """The join hands on what it meets before pairs are spelled out: they are not compiled into one step, which would hold all pairs of a list
    with its cell."""
    df = catalog.QUERIES["station_range_join"](spark, dense[1])
    assert df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    met, spelled = ({m for m in re.findall(rf"\*\((\d+)\) {step}", plan)} for step in (r"\w*Join", r"Generate explode\((?:station|id)#"))
    assert met and spelled and not met & spelled


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_pairs_in_cells_of_any_width(spark, parts, monkeypatch):
    """Beside a pole, across 180 degrees and at the equator; null places are in no pair."""
    import random

    from locusmill.operators.circles import _metres

    rng, radius = random.Random(parts), 700
    spots = [(0.0, 0.0), (60.0, 179.999), (-60.0, -179.999), (89.999, 10.0), (-89.999, 0.0), (35.6, 139.7)]
    a, b = ([(i, max(-90.0, min(90.0, y + rng.uniform(-0.01, 0.01))), (x + rng.uniform(-1, 1) * (180 if abs(y) > 89 else 0.02) + 180) % 360 - 180) for i in range(120) for y, x in [spots[i % 6]]] for _ in range(2))
    want = {(i, j) for i, y, x in a for j, v, u in b if _metres(y, x, v, u) <= radius}
    monkeypatch.setattr(spatial, "PARTS", parts)
    got = spatial.id_pairs(spark.createDataFrame([*a, (999, None, 1.0)], "s int, lat double, lng double"), spark.createDataFrame([*b, (999, 1.0, None)], "v int, lat double, lng double"), [radius], "s", "v").collect()
    assert {(r["s"], r["v"]) for r in got} == want and len(got) == len(want) > 100
