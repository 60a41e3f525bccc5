"""Passes whose outcome depends on the order of rows, split so that no task replays a whole name, block or table.

The results are those of the plain loops over the rows in order."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..scratch import Scratch
from . import spatial
from .components import ROWS, components

#: Conflicts of a component up to which one task decides it; larger ones lose their clear cases in rounds first.
MOST = 200_000


def overruled(conflicts: DataFrame, scratch: Scratch, most: int = MOST) -> DataFrame:
    """node: the nodes that the ordered pass drops, for conflicts (later, earlier).  In order, a node is dropped if an earlier one that stays
    conflicts with it; this is the lexicographically first independent set, seen from its outside.

    Components of at most `most` conflicts are decided in order within tasks that hold many of them.  In larger ones, nodes without an earlier
    conflict stay and what conflicts with them is dropped, with all its conflicts; a few such rounds cut them into smaller components, and so on
    until nothing is left.  Every round is written."""
    edges = scratch.table(conflicts.select("later", "earlier").distinct(), "conflicts-0")
    found, k = [], 0

    def decided(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dropped: set[int] = set()
        for f in frames:
            out = []
            for later, earlier in zip(f["later"].tolist(), f["earlier"].tolist()):
                if earlier not in dropped and later not in dropped:
                    dropped.add(later)  # rows come by later, so all that is known of earlier ones is final
                    out.append(later)
            yield pd.DataFrame({"node": pd.Series(out, dtype="int64")})

    while not edges.isEmpty():
        comps = components(edges.select(F.col("later").alias("a"), F.col("earlier").alias("b")), scratch, f"components-{k}", ROWS)
        named = scratch.table(edges.join(comps.withColumnRenamed("node", "later"), "later"), f"named-{k}")
        size = named.groupBy("comp").agg(F.count("*").alias("n"))
        small = named.join(size.where(F.col("n") <= most), "comp", "left_semi")
        found.append(scratch.table(small.repartition("comp").sortWithinPartitions("later", "earlier").select("later", "earlier").mapInPandas(decided, "node long"), f"small-{k}"))
        rest = scratch.table(named.join(size.where(F.col("n") > most), "comp", "left_semi").select("later", "earlier"), f"large-{k}")
        for j in range(3):
            if rest.isEmpty():
                break
            clear = rest.select(F.col("earlier")).distinct().join(rest.select(F.col("later").alias("earlier")), "earlier", "left_anti")
            hit = scratch.table(rest.join(clear, "earlier", "left_semi").select(F.col("later").alias("node")).distinct(), f"hit-{k}-{j}")
            found.append(hit)
            rest = scratch.table(rest.join(hit.withColumnRenamed("node", "later"), "later", "left_anti").join(hit.withColumnRenamed("node", "earlier"), "earlier", "left_anti"), f"rest-{k}-{j}")
        edges, k = rest, k + 1
    out = conflicts.sparkSession.createDataFrame([], "node long")
    for f in found:
        out = out.unionByName(f)
    return out


def greedy_duplicates(rows: DataFrame, limit: float = 30.0, most: int = MOST) -> DataFrame:
    """rows (row_id, core, lat, lng, ...) with dup_of: the earliest earlier record that is no duplicate itself, lies within `limit` metres and
    whose core holds or is held in this one's (the shorter has two characters or more), else null.

    Of rows with the same core and place only the first takes part: its copies conflict with it and with just what it conflicts with, so they
    are duplicates of it if it stays, else of what it is one of.  Cores of fewer characters and rows with a null have no duplicates; row_id is unique."""
    scratch = Scratch(rows.sparkSession, "greedy")
    kept = (F.length("core") >= 2) & F.col("lat").isNotNull() & F.col("lng").isNotNull()
    firsts = scratch.table(rows.where(kept).groupBy("core", "lat", "lng").agg(F.min("row_id").alias("first")), "firsts")
    other = firsts.select(F.col("first").alias("later"), F.col("core").alias("__core"), "lat", "lng")
    pairs = spatial.cell_pairs(other, firsts.withColumnRenamed("first", "earlier"), limit).where("earlier < later")
    held = F.col("core").contains(F.col("__core")) | F.col("__core").contains(F.col("core"))
    conflicts = scratch.table(pairs.where(held).select("later", "earlier"), "conflicts")
    dropped = scratch.table(overruled(conflicts, scratch, most).distinct(), "dropped")
    owners = conflicts.join(dropped.withColumnRenamed("node", "earlier"), "earlier", "left_anti").groupBy(F.col("later").alias("first")).agg(F.min("earlier").alias("owner"))
    known = firsts.join(owners, "first", "left").select("core", "lat", "lng", F.col("first").alias("__first"), F.col("owner").alias("__owner"))
    dup = F.coalesce("__owner", F.when(F.col("row_id") > F.col("__first"), F.col("__first")))
    return rows.join(known, ["core", "lat", "lng"], "left").withColumn("dup_of", dup).select(*rows.columns, "dup_of")


def _parts(points: DataFrame, scratch: Scratch, deg: float) -> DataFrame:
    """name, cy, cx, part for the occupied cells of each name: parts with an empty row or column of cells between them.

    Cells are wider than the limit.  A merged centre stays within the box of its members, so nothing merges across an empty row or column, in
    whatever order merges come.  Splitting by rows and by columns goes on until no part splits.  A window holds a name's distinct rows or columns,
    whose number the earth bounds."""
    cells = scratch.table(points.select("name", "cy", "cx").distinct().withColumn("part", F.lit(0).cast("long")), "cells-0")
    n, k = -1, 0
    while n != (n := cells.select("name", "part").distinct().count()):
        for axis in ("cy", "cx"):
            w = Window.partitionBy("name", "part").orderBy(axis)
            lines = cells.select("name", "part", axis).distinct().withColumn("gap", (F.col(axis) - F.lag(axis).over(w) > 1).cast("long"))
            lines = lines.withColumn("run", F.coalesce(F.sum("gap").over(w), F.lit(0)))
            split = cells.join(lines.select(F.col("name").alias("__name"), F.col("part").alias("__part"), F.col(axis).alias("__at"), "run"), F.col("name").eqNullSafe(F.col("__name")) & (F.col("part") == F.col("__part")) & (F.col(axis) == F.col("__at")))
            k += 1
            # Equal hashes of different parts would only join them, which is safe.
            cells = scratch.table(split.select("name", "cy", "cx", F.xxhash64("part", F.lit(axis), "run").alias("part")), f"cells-{k}")
    return cells


def merged_groups(groups: DataFrame, limit: float = 500.0) -> DataFrame:
    """name, ord, into: same-named groups (name, ord, lat, lng, n) merged in order into the first earlier one whose centre lies within `limit`
    metres; the centre, a mean weighted by n, moves with each merge.  into is the ord of the group it joins, its own if none.

    A name is split into parts that no sequence of merges can bridge, and only a part is replayed in order, as a stream with the centres in a
    grid; a frequent name is many parts in many tasks.  ord is unique in a name; groups without a place join none; null is a name like others."""
    scratch = Scratch(groups.sparkSession, "merged")
    deg = math.degrees(limit / geo.EARTH_M) * 1.001
    placed = groups.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).select("name", "ord", "lat", "lng", "n")
    facts = placed.groupBy("name").agg(F.max(F.abs("lat")).alias("most"), F.min("lng").alias("west"), F.max("lng").alias("east"))
    narrow = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.lit(math.sin(limit / 2 / geo.EARTH_M)) / F.greatest(F.cos(F.radians("most")), F.lit(1e-12))))) * 1.001
    around = (F.col("west") < -180 + narrow) & (F.col("east") > 180 - narrow)  # the name's points meet across 180 degrees: no columns
    facts = facts.select(F.col("name").alias("__name"), F.when(around | (narrow > 90), 1000.0).otherwise(narrow).alias("wide"))
    points = placed.join(facts, F.col("name").eqNullSafe(F.col("__name"))).drop("__name")
    points = scratch.table(points.withColumns({"cy": F.floor(F.col("lat") / deg), "cx": F.floor((F.col("lng") + 180) / F.col("wide"))}), "points")
    parts = _parts(points, scratch, deg).select(F.col("name").alias("__name"), F.col("cy").alias("__cy"), F.col("cx").alias("__cx"), "part")
    at = F.col("name").eqNullSafe(F.col("__name")) & (F.col("cy") == F.col("__cy")) & (F.col("cx") == F.col("__cx"))
    dealt = points.join(parts, at).select("name", "part", "ord", "lat", "lng", "n", "wide").repartition("name", "part").sortWithinPartitions("name", "part", "ord")

    def replay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, kept, grid = None, [], {}
        for f in frames:
            into = []
            for name, part, o, lat, lng, n, wide in zip(*(f[c].tolist() for c in ("name", "part", "ord", "lat", "lng", "n", "wide"))):
                if here != (name, part):
                    here, kept, grid = (name, part), [], {}
                cy, cx = math.floor(lat / deg), math.floor((lng + 180) / wide)
                near = sorted(i for a in (cy - 1, cy, cy + 1) for b in (cx - 1, cx, cx + 1) for i in grid.get((a, b), ()))
                for i in near:
                    k = kept[i]
                    a, b = math.radians(k[1]), math.radians(lat)
                    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lng - k[2]) / 2) ** 2
                    if 2 * geo.EARTH_M * math.asin(math.sqrt(h)) <= limit:
                        grid[k[4]].remove(i)
                        k[1], k[2], k[3] = (k[1] * k[3] + lat * n) / (k[3] + n), (k[2] * k[3] + lng * n) / (k[3] + n), k[3] + n
                        k[4] = (math.floor(k[1] / deg), math.floor((k[2] + 180) / wide))
                        grid.setdefault(k[4], set()).add(i)
                        into.append(k[0])
                        break
                else:
                    grid.setdefault((cy, cx), set()).add(len(kept))
                    kept.append([o, lat, lng, n, (cy, cx)])
                    into.append(o)
            yield pd.DataFrame({"name": f["name"], "ord": f["ord"], "into": pd.Series(into, dtype="int64")})

    kind = groups.schema["name"].dataType.simpleString()
    found = dealt.mapInPandas(replay, f"name {kind}, ord long, into long")
    lost = groups.where(F.col("lat").isNull() | F.col("lng").isNull()).select("name", F.col("ord").cast("long").alias("ord"), F.col("ord").cast("long").alias("into"))
    return found.unionByName(lost)
