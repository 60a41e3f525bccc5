"""Tallies in circles from pre-summed cells: what lies wholly in a circle is added as sums, only cells on its rim meet rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..scratch import Scratch, ship
from . import spatial

#: Levels of cells, each four times as wide as the one below; fine cells across the smallest radius, about.
LEVELS, ACROSS = 4, 8
#: Latitude beyond which columns are too narrow to count in: circles there are joined with rows.
POLAR = 85.0
#: Places of centres that a task cuts to cells: some seconds of work, while their rows alone would fit one task.
SPOTS = 250


def _metres(lat: float, lng: float, lats: np.ndarray, lngs: np.ndarray) -> np.ndarray:
    a, b = math.radians(lat), np.radians(lats)
    h = np.sin((b - a) / 2) ** 2 + math.cos(a) * np.cos(b) * np.sin(np.radians(lngs - lng) / 2) ** 2
    return 2 * geo.EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def circle_cells(lat: float, lng: float, radius: float, size: float, levels: int = LEVELS) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """(level, rows, columns, whole): cells wholly within a circle, as large as they come, and the fine cells (level 0, whole false) of its rim.

    A cell is within if its corners are: at a fixed latitude distance grows with the difference in longitude, and at a fixed one it is largest at
    one end of the latitudes.  Its nearest point has the least difference in longitude, and the latitude where the way turns, or the nearest it has.  Columns go around the earth, so they may lie beyond its range."""
    top = size * 4 ** (levels - 1)
    up = math.degrees(radius / geo.EARTH_M) * 1.001
    far = min(90.0, abs(lat) + up)
    reach = math.sin(radius / 2 / geo.EARTH_M) / max(math.cos(math.radians(far)), 1e-12)
    across = 180.0 if far >= 90 or reach >= 1 else min(180.0, math.degrees(2 * math.asin(reach)) * 1.001)
    rows, cols = np.meshgrid(np.arange(math.floor((lat - up) / top), math.floor((lat + up) / top) + 1), np.arange(math.floor((lng - across) / top), math.floor((lng + across) / top) + 1), indexing="ij")
    rows, cols = rows.ravel(), cols.ravel()
    out = []
    for level in range(levels - 1, -1, -1):
        s = size * 4**level
        earth = (rows * s <= 90) & ((rows + 1) * s >= -90) & (cols * s < lng + 180) & ((cols + 1) * s > lng - 180)  # once around, no more
        rows, cols = rows[earth], cols[earth]
        south, north, left, right = np.maximum(rows * s, -90), np.minimum((rows + 1) * s, 90), cols * s, (cols + 1) * s
        corners = np.stack([_metres(lat, lng, a, b) for a in (south, north) for b in (left, right)])
        # Beyond half the earth distances turn back, so a cell that reaches there is never whole; its part beyond is at the other end, too.
        whole = (corners.max(initial=0, axis=0) <= radius * (1 - 1e-9)) & (np.abs(np.stack([left, right]) - lng).max(0) <= 180)
        beside = np.where((left <= lng) & (lng <= right), 0, np.minimum(np.abs((left - lng + 180) % 360 - 180), np.abs((right - lng + 180) % 360 - 180)))
        turn = np.degrees(np.arctan2(math.sin(math.radians(lat)), math.cos(math.radians(lat)) * np.cos(np.radians(beside))))  # the nearest latitude at this difference
        outside = _metres(lat, 0.0, np.clip(turn, south, north), beside) > radius * (1 + 1e-9)
        if whole.any():
            out.append((level, rows[whole], cols[whole], True))
        rows, cols = rows[~whole & ~outside], cols[~whole & ~outside]
        if level:
            i, j = np.meshgrid(np.arange(4), np.arange(4), indexing="ij")
            rows, cols = (rows[:, None] * 4 + i.ravel()).ravel(), (cols[:, None] * 4 + j.ravel()).ravel()
    if len(rows):
        out.append((0, rows, cols, False))
    return out


def tallies(centres: DataFrame, rows: DataFrame, radii: list[int], keys: list[str], weight: str | None = None) -> DataFrame:
    """centre, radius, keys, n[, n_w]: how many rows (lat, lng, keys[, weight]) lie within each radius of each centre (centre, lat, lng).
    centre is unique."""
    own, per = place_tallies(centres, rows, radii, keys, weight)
    return own.join(per, "spot").select("centre", "radius", *keys, "n", *(["n_w"] if weight else []))


def place_tallies(centres: DataFrame, rows: DataFrame, radii: list[int], keys: list[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """centres with their spot, which those at one place share (null without a place), and spot, radius, keys, n[, n_w]: how many rows (lat, lng,
    keys[, weight]) lie within each radius of it.  What follows from these sums alone is best made by spot, before centres are joined with it.

    Rows are read once and summed up by place and keys, then by fine cell and by the larger cells, before anything is joined; a circle then needs
    some hundred cells, whatever the rows, and its finest ones grow with its radius.  On a rim a place is one row with its sums in a list, so
    neither a full cell nor a full place meets a circle row by row.
    Rows and centres with a null place count nowhere."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "circles")
    ship(spark)
    size = 2.0 ** min(-3, math.floor(math.log2(math.degrees(min(radii) / geo.EARTH_M) / ACROSS)))  # all levels then go around the earth
    around = round(360 / size)
    sums = [F.sum("n").alias("n")] + ([F.sum("n_w").alias("n_w")] if weight else [])
    ones = [F.count("*").alias("n")] + ([F.sum(weight).alias("n_w")] if weight else [])
    finest = {r: min(LEVELS - 1, int(math.log(r / min(radii), 4) + 1e-9)) for r in radii}
    placed = scratch.table(rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull()).groupBy("lat", "lng", *keys).agg(*ones), "places")
    placed = placed.withColumns({"cy": F.floor(F.col("lat") / size), "cx": F.pmod(F.floor(F.col("lng") / size), F.lit(around))})
    level = fine = scratch.table(placed.groupBy("cy", "cx", *keys).agg(*sums), "cells-0")
    cells = fine.withColumn("level", F.lit(0))
    for k in range(1, LEVELS):
        level = level.groupBy(F.floor(F.col("cy") / 4).alias("cy"), F.floor(F.col("cx") / 4).alias("cx"), *keys).agg(*sums)
        cells = cells.unionByName(level.withColumn("level", F.lit(k)))
    cells = scratch.table(cells, "cells")

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = list(zip(b["few_lat"].to_pylist(), b["few_lng"].to_pylist()))
            for begin in range(0, len(places), 64):
                parts = [(i, radius, low + k, *found) for i in range(begin, min(begin + 64, len(places))) for radius, low in finest.items() for k, *found in circle_cells(*places[i], radius, size * 4**low, LEVELS - low)]
                n = [len(p[3]) for p in parts]
                which = [np.repeat([p[k] for p in parts], n) for k in (0, 1, 2, 5)]
                cy, cx = (np.concatenate([p[k] for p in parts]) for k in (3, 4))
                rows = np.stack([*which, cy, cx % (around // 4 ** which[2])])
                if (cx != rows[5]).any():  # beyond 180 degrees a cell of the rim can come twice
                    rows = np.unique(rows, axis=1)
                own = b.take(pa.array(rows[0]))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(rows[1].astype(np.int32)), pa.array(rows[2].astype(np.int32)), pa.array(rows[4]), pa.array(rows[5]), pa.array(rows[3] == 1)], ["spot", "few_lat", "few_lng", "radius", "level", "cy", "cx", "whole"])

    at = {"few_lat": F.col("lat").cast("double"), "few_lng": F.col("lng").cast("double")}
    known = centres.withColumns(at).where(F.col("few_lat").isNotNull() & F.col("few_lng").isNotNull())
    spots = scratch.table(known.select("few_lat", "few_lng").distinct().select(F.monotonically_increasing_id().alias("spot"), "few_lat", "few_lng"), "spots")
    polar = F.abs("few_lat") > POLAR
    dealt = spots.where(~polar).repartition(spots.count() // SPOTS + 1)
    covered = scratch.table(dealt.mapInArrow(cover, "spot long, few_lat double, few_lng double, radius int, level int, cy long, cx long, whole boolean"), "cover")
    inside = covered.where("whole").join(cells, ["level", "cy", "cx"]).groupBy("spot", "radius", *keys).agg(*sums)
    rim = covered.where("not whole").drop("whole")
    of = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col("cy") / 4**k).alias("cy"), F.floor(F.col("cx") / 4**k).alias("cx")) for k in sorted(set(finest.values()))]))
    edge = placed.groupBy("lat", "lng", "cy", "cx").agg(F.collect_list(F.struct(*keys, "n", *(["n_w"] if weight else []))).alias("own")).withColumn("of", of).select("of.*", "lat", "lng", "own")
    near = edge.join(rim, ["level", "cy", "cx"]).where(geo.haversine(F.col("few_lat"), F.col("few_lng"), F.col("lat"), F.col("lng")) <= F.col("radius"))
    near = near.select("spot", "radius", F.explode("own").alias("own")).select("spot", "radius", "own.*")
    out = inside.unionByName(near.groupBy("spot", "radius", *keys).agg(*sums))
    beyond = spots.where(polar).withColumnsRenamed({"few_lat": "lat", "few_lng": "lng"})
    if not beyond.isEmpty():
        pairs = spatial.by_radius(spatial.cell_pairs(beyond, placed.drop("cy", "cx"), max(radii)), radii)
        out = out.unionByName(pairs.groupBy("spot", "radius", *keys).agg(*sums))
    per = scratch.table(out.groupBy("spot", "radius", *keys).agg(*sums), "tallies")
    return centres.withColumns(at).join(spots, ["few_lat", "few_lng"], "left").drop("few_lat", "few_lng"), per
