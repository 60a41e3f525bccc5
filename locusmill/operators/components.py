"""Connected components of a graph of any shape, in a number of rounds that grows with the logarithm of its nodes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, Scratch, ship

#: Edges that one task holds, at least.
ROWS = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over all edges of a task."""
    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for x, y in zip(batch["a"].to_pylist(), batch["b"].to_pylist()):
            x, y = root(x), root(y)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    if nodes:
        kind = batch.schema.field("a").type
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["node", "comp"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components", one_task: int = 0) -> DataFrame:
    """node, comp: the least node of each component, for every node with an edge (a, b).  Loops, repeated edges and either direction
    are allowed; edges with a null end are ignored.

    Alternating stars: large-star ties every node's greater neighbours to its least one, small-star its lesser neighbours
    and itself.  Both keep the components and move edges towards the least nodes until each component is one star.  Minima are
    partial before the shuffle, and the edges of a hub meet a table with one row per node, a join whose hot keys Spark can split.  Each round
    is written, so a lost executor costs no earlier round; there is no cap on rounds.

    Once at most `one_task` edges are left, which is not more than a task holds anyway, that task joins them at once."""
    ship(edges.sparkSession)
    a, b = F.col("a"), F.col("b")
    pairs = edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    pairs, k = scratch.table(pairs, f"{name}-0"), 0
    while True:
        n = pairs.count()
        if n <= one_task:
            kind = pairs.schema["a"].dataType.simpleString()
            return scratch.table(pairs.coalesce(1).mapInArrow(_joined, f"node {kind}, comp {kind}"), f"{name}-joined")
        parts = n // ROWS + 1  # a small graph needs no more tasks than these, whatever the session says

        def joined(rows: DataFrame, minima: DataFrame, key: str, n: int = n) -> DataFrame:
            return rows.join(F.broadcast(minima) if n <= BROADCAST_ROWS else minima, key)  # minima has at most 2 n rows

        ends = pairs.select(a.alias("node"), b.alias("other"), F.lit(True).alias("lesser")).unionByName(pairs.select(b.alias("node"), a.alias("other"), F.lit(False).alias("lesser")))
        lesser = F.col("lesser")
        least = ends.groupBy("node").agg(F.min("other").alias("m"), F.count_if(lesser).alias("up"), F.count_if(~lesser).alias("down")).coalesce(parts)
        least = scratch.table(least.select("node", F.least("node", "m").alias("m"), ((F.col("up") + F.least(F.col("down"), F.lit(1))) > 1).alias("open")), f"{name}-{k}-least")
        if least.where("open").isEmpty():  # every node is a centre, or has one edge, to a centre
            return least.select("node", F.col("m").alias("comp"))
        large = scratch.table(joined(pairs, least.select(F.col("node").alias("b"), "m"), "b").select("a", F.col("m").alias("b")), f"{name}-{k}-large")
        inner = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = joined(large, inner, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        small = scratch.table(lower.unionByName(inner.select("a", F.col("m").alias("b"))).distinct().coalesce(parts), f"{name}-{k + 1}")
        scratch.drop(f"{name}-{k}", f"{name}-{k}-least", f"{name}-{k}-large")
        pairs, k = small, k + 1
