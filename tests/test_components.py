"""Alternating stars against union-find."""

import random

import pytest

from locusmill.operators.components import components
from locusmill.scratch import SALT, Scratch, beside


def union_find(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    return {x: root(x) for x in list(parent)}


def shapes():
    rng = random.Random(3)
    ids = rng.sample(range(100_000), 2000)
    yield "chain", list(zip(ids, ids[1:])), 22
    yield "star", [(ids[0], x) for x in ids[1:]] + [(x, ids[0]) for x in ids[1:9]], 3
    yield "tree", [(ids[i], ids[(i - 1) // 2]) for i in range(1, 2000)], 16
    yield "many", [tuple(rng.sample(ids, 2)) for _ in range(900)] + [(5, 5)], 16


@pytest.mark.parametrize("name, edges, rounds", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_components(spark, name, edges, rounds):
    written = []

    class Counting(Scratch):
        def table(self, df, table):
            written.append(table)
            return super().table(df.coalesce(1), table)

    got = components(spark.createDataFrame(edges, "a long, b long"), Counting(spark, "test"))
    want = union_find([e for e in edges if e[0] != e[1]])
    assert {r["node"]: r["comp"] for r in got.collect()} == want and got.count() == len(want)
    assert sum(t.endswith("-least") for t in written) <= rounds


def test_no_edges_and_strings(spark):
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0
    got = components(spark.createDataFrame([("b", "a"), ("c", "b"), (None, "z")], "a string, b string"), Scratch(spark, "test"))
    assert {tuple(r) for r in got.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}


def test_both_ways_beside_a_small_table(spark):
    rows = spark.range(300).selectExpr("id", "id % 7 as g")
    small = spark.createDataFrame([(i, f"x{i}") for i in range(5)], "g long, x string")
    for how in ("left", "inner"):
        broadcast, salted = (sorted(map(tuple, beside(rows, small, "g", how, limit=n).collect()), key=str) for n in (10, 2))
        assert broadcast == salted and len(salted) == (300 if how == "left" else 215) and SALT > 1


@pytest.mark.parametrize("name, edges, rounds", list(shapes()), ids=lambda x: x if isinstance(x, str) else "")
def test_one_task(spark, name, edges, rounds):
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a long, b long").repartition(3)
    got = {r["node"]: r["comp"] for r in components(df, Scratch(spark, "test"), one_task=10_000).collect()}
    want = union_find([(a, b) for a, b in edges if a != b])
    assert got == want
