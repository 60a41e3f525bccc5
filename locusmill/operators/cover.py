"""Polygons with holes and parts as cells: points find their polygon by their cell, and unions are made cell by cell.

A polygon is a list of closed rings, array<array<struct<x, y>>>; what an odd number of rings hold is inside, so holes and further parts are just
rings.  A cell is marked as inside, or keeps the edges that touch it and whether its lower left corner is inside.  A path from that corner, up
and then to the right, meets no other edges, so a point needs only its cell.  Cell sizes are powers of two, so that borders are exact numbers."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch, ship
from . import chains

POLYGON = "array<array<struct<x: double, y: double>>>"
_EDGES = "array<struct<ax: double, ay: double, bx: double, by: double>>"


def _edges(rings: list) -> np.ndarray:
    parts = [np.array([(v["x"], v["y"]) for v in r], float).reshape(-1, 2) for r in rings]
    pieces = [np.hstack([p[:-1], p[1:]]) for p in parts if len(p) > 1]
    e = np.concatenate(pieces) if pieces else np.empty((0, 4))
    return e[(e[:, :2] != e[:, 2:]).any(1)]


def _touched(e, size: float):
    """(edge, row, column) of all cells that edges come near."""
    def spread(which, lo, hi):
        n = (hi - lo + 1).astype(np.int64)
        at = np.repeat(np.arange(len(n)), n)
        return which[at], at, lo[at] + np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)

    slack = 1e-12 * (1 + np.abs(e).max(initial=0))
    low, high = np.minimum(e[:, 1], e[:, 3]) - slack, np.maximum(e[:, 1], e[:, 3]) + slack
    which, _, row = spread(np.arange(len(e)), np.floor(low / size).astype(np.int64), np.floor(high / size).astype(np.int64))
    ax, ay, bx, by = e[which].T
    with np.errstate(divide="ignore", invalid="ignore"):
        at = [np.clip((y * size - ay) / (by - ay), 0, 1) for y in (row, row + 1)]
    xs = [np.where(ay == by, v, ax + (bx - ax) * t) for v, t in zip((ax, bx), at)]
    steep = slack * (1 + np.abs(bx - ax) / np.maximum(np.abs(by - ay), slack))
    left = np.maximum(np.minimum(*xs) - steep, np.minimum(ax, bx) - slack)
    right = np.minimum(np.maximum(*xs) + steep, np.maximum(ax, bx) + slack)
    edge, at, col = spread(which, np.floor(left / size).astype(np.int64), np.floor(right / size).astype(np.int64))
    return edge, row[at], col


def _odd(e, x0, y0, x, y):
    """Whether paths from corner(s) (x0, y0) up to y and right to x cross an odd number of edges; x and y broadcast against edges' last axis."""
    ax, ay, bx, by = e.T
    with np.errstate(divide="ignore", invalid="ignore"):
        xc, yc = (bx - ax) * (y - ay) / (by - ay) + ax, (by - ay) * (x0 - ax) / (bx - ax) + ay
    level = ((ay > y) != (by > y)) & (xc > x0) & (xc <= x)
    upright = ((ax > x0) != (bx > x0)) & (yc > y0) & (yc <= y)
    return (level.sum(-1) + upright.sum(-1)) % 2 == 1


def _grouped(keys, values):
    """The runs of equal keys of sorted rows: (key, values)."""
    order = np.lexsort(keys.T[::-1])
    keys, values = keys[order], values[order]
    starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])) if len(keys) else []
    return [(tuple(keys[a]), values[a:b]) for a, b in zip(starts, np.append(starts[1:], len(keys)))]


def _cells(e, size: float, fan: int, levels: int, most: int) -> Iterator[tuple]:
    """(level, row, column, whole, corner, edges' numbers) of one polygon.  A cell with more than `most` edges is split in fan x fan, at
    most to `levels` levels; cells without edges stay as large as they are."""
    if not len(e):
        return
    near, row, col = _touched(e, size)
    held = {(int(r), int(c)): ids for (r, c), ids in _grouped(np.stack([row, col], 1), near)}
    todo = []
    rows = sorted({r for r, _ in held})
    for r in range(rows[0], rows[-1] + 1):
        y = r * size
        spans = (e[:, 1] > y) != (e[:, 3] > y)
        ax, ay, bx, by = e[spans].T
        xs = np.sort((bx - ax) * (y - ay) / (by - ay) + ax)
        cols = [c for q, c in held if q == r]
        lo, hi = (min(cols), max(cols)) if cols else (0, -1)
        if len(xs):
            lo, hi = min(lo, int(np.floor(xs[0] / size))) if cols else int(np.floor(xs[0] / size)), max(hi, int(np.floor(xs[-1] / size)))
        for c in range(lo, hi + 1):
            corner = bool(np.searchsorted(xs, c * size, side="right") % 2)
            if (r, c) in held:
                todo.append((0, r, c, corner, held[r, c]))
            elif corner:
                yield 0, r, c, True, True, ()
    while todo:
        level, r, c, corner, ids = todo.pop()
        if len(ids) <= most or level + 1 == levels:
            yield level, r, c, False, corner, ids
            continue
        own, sub = e[ids], size / fan ** (level + 1)
        x0, y0 = c * fan * sub, r * fan * sub
        k, row, col = _touched(own, sub)
        inside = (row // fan == r) & (col // fan == c)
        kids = {(int(a), int(b)): ids[v] for (a, b), v in _grouped(np.stack([row[inside], col[inside]], 1), k[inside])}
        ys, xs = np.meshgrid(np.arange(r * fan, r * fan + fan), np.arange(c * fan, c * fan + fan), indexing="ij")
        corners = _odd(own, x0, y0, (xs * sub)[..., None], (ys * sub)[..., None]) ^ corner
        for i in range(fan):
            for j in range(fan):
                at = (r * fan + i, c * fan + j)
                if at in kids:
                    todo.append((level + 1, *at, bool(corners[i, j]), kids[at]))
                elif corners[i, j]:
                    yield level + 1, *at, True, True, ()


def cells(polygons: DataFrame, size: float, fan: int = 4, levels: int = 3, most: int = 24, shift: float = 0.0) -> DataFrame:
    """id, level, cy, cx, whole, corner, edges: the cells of polygons (id, rings), one row per polygon and cell.  size: a power of two, for
    exact borders; shift moves the cells' origin.  A polygon is one row and is cut by itself, so neither its cells nor others' meet in a task."""
    ship(polygons.sparkSession)
    kind = polygons.schema["id"].dataType.simpleString()
    schema = f"id {kind}, level int, cy long, cx long, whole boolean, corner boolean, edges {_EDGES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n, rings in enumerate(b["rings"]):
                e = _edges(rings.as_py() or []) - shift
                found = _cells(e, size, fan, levels, most)
                while part := list(itertools.islice(found, 1000)):
                    level, row, col, whole, corner, ids = zip(*part)
                    ends = pa.array([0, *itertools.accumulate(map(len, ids))], pa.int32())
                    flat = e[[i for x in ids for i in x]]
                    edges = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(4)], ["ax", "ay", "bx", "by"]))
                    key = b["id"].take(pa.array([n] * len(part)))
                    yield pa.RecordBatch.from_arrays([key, pa.array(level, pa.int32()), pa.array(row, pa.int64()), pa.array(col, pa.int64()), pa.array(whole), pa.array(corner), edges], ["id", "level", "cy", "cx", "whole", "corner", "edges"])

    return polygons.select("id", "rings").mapInArrow(run, schema)


def _holds(x0: Column, y0: Column, x: Column, y: Column):
    """Whether a cell's polygon (whole, corner, edges) holds a point of the cell, by the path from the cell's corner."""

    def crosses(e: Column) -> Column:
        xc = (e["bx"] - e["ax"]) * F.try_divide(y - e["ay"], e["by"] - e["ay"]) + e["ax"]
        yc = (e["by"] - e["ay"]) * F.try_divide(x0 - e["ax"], e["bx"] - e["ax"]) + e["ay"]
        level = ((e["ay"] > y) != (e["by"] > y)) & (xc > x0) & (xc <= x)
        upright = ((e["ax"] > x0) != (e["bx"] > x0)) & (yc > y0) & (yc <= y)
        return F.coalesce(level, F.lit(False)) != F.coalesce(upright, F.lit(False))

    def held(c: Column) -> Column:
        return c["whole"] | (c["corner"] != (F.size(F.filter(c["edges"], crosses)) % 2 == 1))

    return held


def located(points: DataFrame, polygons: DataFrame, size: float = 0.0625, fan: int = 4, levels: int = 3, most: int = 24) -> DataFrame:
    """points (lng, lat, ...) with `area`: the id of the polygon, first by ord, that holds them, or null.  polygons: id, ord, rings.

    Each level is a join of points with one row per cell, so no point is copied or compared with what is not in its cell.  A point on a border
    counts as just right of and above it.  Points with a null coordinate are in no polygon.  Repeated points stay."""
    both = polygons.select(F.struct("ord", "id").alias("id"), "rings")
    cover = Scratch(points.sparkSession, "cover").table(cells(both, size, fan, levels, most), "cells")
    entry = F.struct(F.col("id.ord").alias("ord"), F.col("id.id").alias("id"), "whole", "corner", "edges")
    out, best = points, []
    for level in range(levels):
        s = size / fan**level
        per = cover.where(F.col("level") == level).groupBy(F.col("cy").alias("__cy"), F.col("cx").alias("__cx")).agg(F.array_sort(F.collect_list(entry)).alias(f"__c{level}"))
        out = out.withColumns({"__cy": F.floor(F.col("lat") / s), "__cx": F.floor(F.col("lng") / s)}).join(per, ["__cy", "__cx"], "left")
        x0, y0 = F.col("__cx") * F.lit(s), F.col("__cy") * F.lit(s)
        found = F.filter(F.col(f"__c{level}"), _holds(x0, y0, F.col("lng"), F.col("lat")))
        out = out.withColumn(f"__f{level}", F.transform(found, lambda c: F.struct(c["ord"].alias("ord"), c["id"].alias("id")))).drop("__cy", "__cx", f"__c{level}")
        best.append(F.get(F.col(f"__f{level}"), 0))
    return out.withColumn("area", (F.least(*best) if len(best) > 1 else best[0])["id"]).drop(*[f"__f{level}" for level in range(levels)])


#: Coordinates of a union's border are whole multiples of this part of a degree.
GRAIN = 1e-9


def _border(members, size: float, x0: float, y0: float):
    """Directed pieces (x1, y1, x2, y2 in grains from the corner) of the border of a union within one cell, its inside on the left.
    members: (corner, edges) of each polygon with edges here."""
    owners = [(corner, np.array([(v["ax"], v["ay"], v["bx"], v["by"]) for v in edges], float).reshape(-1, 4)) for corner, edges in members]
    e = np.concatenate([x for _, x in owners])
    a, d = e[:, :2], e[:, 2:] - e[:, :2]
    low, high = np.zeros(len(e)), np.ones(len(e))
    for k, lo in ((0, x0), (1, y0)):  # clip to the cell
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (lo - a[:, k]) / d[:, k], (lo + size - a[:, k]) / d[:, k]
        flat = d[:, k] == 0
        out = flat & ((a[:, k] < lo) | (a[:, k] > lo + size))
        low = np.where(flat, np.where(out, 2, low), np.maximum(low, np.minimum(t, u)))
        high = np.where(flat, high, np.minimum(high, np.maximum(t, u)))
    e, a, d, low, high = (v[low < high] for v in (e, a, d, low, high))
    cuts = [[lo, hi] for lo, hi in zip(low, high)]
    for i in range(len(e)):  # where edges meet
        det = d[i, 0] * d[:, 1] - d[i, 1] * d[:, 0]
        rel = a - a[i]
        with np.errstate(divide="ignore", invalid="ignore"):
            t, u = (rel[:, 0] * d[:, 1] - rel[:, 1] * d[:, 0]) / det, (rel[:, 0] * d[i, 1] - rel[:, 1] * d[i, 0]) / det
        size_i = np.hypot(*d[i])
        skew = np.abs(det) > 1e-12 * size_i * np.hypot(d[:, 0], d[:, 1])
        hit = skew & (u >= -1e-9) & (u <= 1 + 1e-9)
        cuts[i] += t[hit & (t > low[i]) & (t < high[i])].tolist()
        q = np.concatenate([a[~skew], (a + d)[~skew]]) - a[i]  # along one line: the others' ends cut this one
        on = np.abs(q[:, 0] * d[i, 1] - q[:, 1] * d[i, 0]) <= GRAIN * size_i
        t = q[on] @ d[i] / size_i**2
        cuts[i] += t[(t > low[i]) & (t < high[i])].tolist()
    pieces = set()
    for i, ts in enumerate(cuts):
        ends = np.rint((a[i] + np.array(sorted(set(ts)))[:, None] * d[i]) / GRAIN).astype(np.int64)
        for p, q in zip(ends.tolist(), ends[1:].tolist()):
            if p != q:
                pieces.add((min(tuple(p), tuple(q)), max(tuple(p), tuple(q))))
    if not pieces:
        return np.empty((0, 4), np.int64)
    s = np.array([[*p, *q] for p, q in sorted(pieces)], np.int64)
    mid, way = (s[:, :2] + s[:, 2:]) * (GRAIN / 2), (s[:, 2:] - s[:, :2]).astype(float)
    side = np.stack([-way[:, 1], way[:, 0]], 1) / np.hypot(*way.T)[:, None] * (4 * GRAIN)

    def covered(p):
        out = np.zeros(len(p), bool)
        for corner, own in owners:
            out |= _odd(own, x0, y0, p[:, :1], p[:, 1:]) ^ corner
        return out

    left, right = covered(mid + side), covered(mid - side)
    s = np.where(right[:, None], s[:, [2, 3, 0, 1]], s)
    return s[left != right]


def union_border(polygons: DataFrame, size: float = 0.0625) -> DataFrame:
    """area, x1, y1, x2, y2: the directed border, in grains, of the union of each area's polygons (area, rings); its inside is on the left.

    Polygons are cut to cells; a cell that one polygon fills has no border, in any other the edges that touch it are cut where they meet, and a
    piece stays if the union lies on one side of it only.  Borders that polygons share cancel.  So the work of a task is a cell's, not an area's."""
    shift = 0.0137 * size  # polygons often lie on round coordinates; cell borders then do not
    named = polygons.select(F.struct("area", F.monotonically_increasing_id().alias("n")).alias("id"), "rings")
    cover = cells(named, size, 1, 1, 1 << 30, shift)
    per = cover.groupBy(F.col("id.area").alias("area"), "cy", "cx").agg(F.bool_or("whole").alias("whole"), F.collect_list(F.when(~F.col("whole"), F.struct("corner", "edges"))).alias("members"))
    kind = polygons.schema["area"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for n in range(b.num_rows):
                cy, cx, members = b["cy"][n].as_py(), b["cx"][n].as_py(), b["members"][n].as_py()
                s = _border([(m["corner"], m["edges"]) for m in members], size, cx * size, cy * size) + round(shift / GRAIN)
                if len(s):
                    yield pa.RecordBatch.from_arrays([b["area"].take(pa.array([n] * len(s))), *[pa.array(s[:, k]) for k in range(4)]], ["area", "x1", "y1", "x2", "y2"])

    return per.where(~F.col("whole")).select("area", "cy", "cx", "members").mapInArrow(run, f"area {kind}, x1 long, y1 long, x2 long, y2 long")


def enclosed(border: DataFrame) -> DataFrame:
    """area, size: what a directed border encloses, in square degrees, by sums over its pieces alone (exact in grains)."""
    x, y = [F.col(c).cast("decimal(19,0)") for c in ("x1", "x2")], [F.col(c).cast("decimal(19,0)") for c in ("y1", "y2")]
    return border.groupBy("area").agg((F.sum(x[0] * y[1] - x[1] * y[0]) / 2).cast("double").alias("__g")).select("area", (F.col("__g") * F.lit(GRAIN * GRAIN)).alias("size"))


def rings(border: DataFrame, scratch: Scratch, name: str = "rings") -> DataFrame:
    """area, ring, outer, points: the border's pieces chained into closed rings; outer ones run to the left around their inside, holes do not.
    Where rings touch, a piece goes on to the one farthest to its left, so that each ring is simple."""
    pieces = scratch.table(border.withColumn("node", F.monotonically_increasing_id()), f"{name}-pieces")
    dx, dy = [(F.col(f"x2{s}") - F.col(f"x1{s}")).cast("double") for s in ("", "b")], [(F.col(f"y2{s}") - F.col(f"y1{s}")).cast("double") for s in ("", "b")]
    after = pieces.select("area", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x1").alias("x1b"), F.col("y1").alias("y1b"), F.col("x2").alias("x2b"), F.col("y2").alias("y2b"), F.col("node").alias("next"))
    turn = F.atan2(dx[0] * dy[1] - dy[0] * dx[1], dx[0] * dx[1] + dy[0] * dy[1])
    links = pieces.join(after, ["area", "x2", "y2"], "left").groupBy("node").agg(F.max_by("next", F.struct(turn, "next")).alias("next"))
    chained = pieces.join(chains.ranked(links, scratch, name), "node")
    x, y = [F.col(c).cast("decimal(19,0)") for c in ("x1", "x2")], [F.col(c).cast("decimal(19,0)") for c in ("y1", "y2")]
    at = F.array_sort(F.collect_list(F.struct("rank", (F.col("x1") * F.lit(GRAIN)).alias("x"), (F.col("y1") * F.lit(GRAIN)).alias("y"))))
    found = chained.groupBy("area", F.col("chain").alias("ring")).agg((F.sum(x[0] * y[1] - x[1] * y[0]) > 0).alias("outer"), at.alias("p"))
    open_ = F.transform("p", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return found.select("area", "ring", "outer", F.concat(open_, F.slice(open_, 1, 1)).alias("points"))


def united(polygons: DataFrame, scratch: Scratch, size: float = 0.0625, filled: bool = False) -> DataFrame:
    """area, ring, outer, points of the union of each area's polygons (area, rings); with `filled`, without holes and what lies in them."""
    found = rings(scratch.table(union_border(polygons, size), "border"), scratch)
    if not filled:
        return found
    outer = scratch.table(found.where("outer").select("area", F.array("points").alias("rings")), "outer")
    return rings(scratch.table(union_border(outer, size), "filled"), scratch, "filled-rings")


def sizes(polygons: DataFrame, scratch: Scratch, km_x: float, km_y: float, size: float = 0.0625) -> DataFrame:
    """area, km2, filled_km2: of the union of each area's polygons, and of it with its holes filled; km_x, km_y: kilometres per degree."""
    border = scratch.table(union_border(polygons, size), "border")
    outer = scratch.table(rings(border, scratch).where("outer").select("area", F.array("points").alias("rings")), "outer")
    km = F.col("size") * km_x * km_y
    return enclosed(border).select("area", km.alias("km2")).join(enclosed(union_border(outer, size)).select("area", km.alias("filled_km2")), "area")
