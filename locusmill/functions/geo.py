"""Distances, boxes, cells, mesh codes and polygons as Column expressions (all inside whole-stage code generation)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0
M_PER_DEG = 111320.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle metres."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2.0))
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def planar(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular metres, scaled at the first point."""
    return F.hypot((lat2 - lat1) * M_PER_DEG, (lng2 - lng1) * M_PER_DEG * F.cos(F.radians(lat1)))


def circle_bbox(lat: float, lng: float, radius: float, margin: float = 1.05) -> tuple[float, float, float, float]:
    """min lng, min lat, max lng, max lat around a circle."""
    import math

    dlat = radius * margin / M_PER_DEG
    dlng = dlat / math.cos(math.radians(lat))
    return lng - dlng, lat - dlat, lng + dlng, lat + dlat


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(float(size))).cast("long")


def neighbours(c: Column, reach: int = 1) -> Column:
    return F.array(*[c + k for k in range(-reach, reach + 1)])


def mesh_bounds(code: Column) -> Column:
    """struct<lat, lng, dlat, dlng> of a 4- to 11-digit mesh code: 4 digits, then 2, 2, and one quadrant digit per level."""

    def d(i: int, n: int = 1) -> Column:
        return F.try_to_number(F.substring(code, i, n), F.lit("9" * n)).cast("double")

    n = F.length(code)
    lat, lng = d(1, 2) / 1.5, d(3, 2) + 100
    dlat, dlng = F.lit(2.0 / 3), F.lit(1.0)
    for at, parts, step in ((5, 8.0, 6), (7, 10.0, 8)):
        has = n >= step
        lat = F.when(has, lat + d(at) * dlat / parts).otherwise(lat)
        lng = F.when(has, lng + d(at + 1) * dlng / parts).otherwise(lng)
        dlat, dlng = F.when(has, dlat / parts).otherwise(dlat), F.when(has, dlng / parts).otherwise(dlng)
    for at in (9, 10, 11):
        has = n >= at
        q = d(at) - 1
        dlat, dlng = F.when(has, dlat / 2).otherwise(dlat), F.when(has, dlng / 2).otherwise(dlng)
        lat = F.when(has, lat + F.floor(q / 2) * dlat).otherwise(lat)
        lng = F.when(has, lng + F.pmod(q, F.lit(2.0)) * dlng).otherwise(lng)
    return F.struct(lat.alias("lat"), lng.alias("lng"), dlat.alias("dlat"), dlng.alias("dlng"))


def coverage(lat: Column, lng: Column, dlat: Column, dlng: Column, c_lat: Column, c_lng: Column, radius: Column, n: int = 10) -> Column:
    """Share of an n x n grid of a cell's sub-centres that lie within radius of a point."""

    def at(k: Column) -> Column:
        i, j = F.floor(k / n), k % n
        return haversine(c_lat, c_lng, lat + (i + 0.5) * dlat / n, lng + (j + 0.5) * dlng / n) <= radius

    return F.size(F.filter(F.sequence(F.lit(0), F.lit(n * n - 1)), at)) / F.lit(float(n * n))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: whether (x, y) lies in a closed ring, array<struct<x, y>> whose last vertex repeats the first."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * F.try_divide(y - a["y"], b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(edges, crosses)) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Planar (shoelace) area of a closed ring, in squared units of its coordinates."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))
    return F.abs(F.aggregate(edges, F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])) / 2


def edge_distance(ring: Column, x: Column, y: Column, mx: float, my: float) -> Column:
    """Least metres from a point to a ring's edges; mx, my: metres per unit of x and y."""
    edges = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("a"), F.slice(ring, 2, F.size(ring) - 1).alias("b"))

    def to(e: Column) -> Column:
        ax, ay = (e["a"]["x"] - x) * mx, (e["a"]["y"] - y) * my
        dx, dy = (e["b"]["x"] - e["a"]["x"]) * mx, (e["b"]["y"] - e["a"]["y"]) * my
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(ax + t * dx, ay + t * dy)

    return F.array_min(F.transform(edges, to))


def map_xy(lng: Column, lat: Column, lng0: float, lat0: float, sx: float, sy: float) -> Column:
    """Linear map coordinates from a top-left origin."""
    return F.struct(((lng - lng0) * sx).alias("x"), ((lat0 - lat) * sy).alias("y"))


def fixed_point(x: Column) -> Column:
    return F.round(x * 1e5).cast("long")


def crosses_box(x1: Column, y1: Column, x2: Column, y2: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a segment meets a closed box (min x, min y, max x, max y), by clipping it to the box's slabs."""
    enter, leave, inside_slab = F.lit(0.0), F.lit(1.0), F.lit(True)
    for a, d, lo, hi in ((x1, x2 - x1, box[0], box[2]), (y1, y2 - y1, box[1], box[3])):
        t, u = F.try_divide(lo - a, d), F.try_divide(hi - a, d)
        flat = d == 0
        inside_slab = inside_slab & F.when(flat, (a >= lo) & (a <= hi)).otherwise(True)
        enter = F.greatest(enter, F.when(flat, 0.0).otherwise(F.least(t, u)))
        leave = F.least(leave, F.when(flat, 1.0).otherwise(F.greatest(t, u)))
    return inside_slab & (enter <= leave)


def line_crosses_box(line: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether any segment of a polyline, array<struct<x, y>>, meets a closed box."""
    edges = F.arrays_zip(F.slice(line, 1, F.size(line) - 1).alias("a"), F.slice(line, 2, F.size(line) - 1).alias("b"))
    return F.exists(edges, lambda e: crosses_box(e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"], box))


def centroid(vertices: Column) -> Column:
    """struct<x, y>: the mean of the vertices."""
    n = F.size(vertices)

    def mean(c: str) -> Column:
        return (F.aggregate(F.transform(vertices, lambda v: v[c]), F.lit(0.0), lambda a, x: a + x) / n).alias(c)

    return F.struct(mean("x"), mean("y"))


def area_km2(parts: Column, km_x: float, km_y: float) -> Column:
    """Square kilometres of an area of several outer rings, array<array<struct<x, y>>>; holes are filled, parts do not overlap."""
    return F.aggregate(F.transform(parts, ring_area), F.lit(0.0), lambda a, x: a + x) * km_x * km_y


def near_edge(parts: Column, x: Column, y: Column, mx: float, my: float, radius: Column) -> Column:
    """Whether a point lies closer than radius to the outer border, on either side of it."""
    return F.array_min(F.transform(parts, lambda ring: edge_distance(ring, x, y, mx, my))) < radius


def column_circle_bbox(lat: Column, lng: Column, radius: Column, margin: float = 1.05) -> Column:
    """struct<x0, y0, x1, y1>: the box around a circle."""
    dlat = radius * margin / M_PER_DEG
    dlng = dlat / F.cos(F.radians(lat))
    return F.struct((lng - dlng).alias("x0"), (lat - dlat).alias("y0"), (lng + dlng).alias("x1"), (lat + dlat).alias("y1"))
