"""Places on disk along a space-filling curve, so that a box of the map is a few row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import spatial

#: Bytes of a row group, about: small enough for a box to leave most of them out.
GROUP_BYTES = 8 << 20


def _spread(x: Column) -> Column:
    """The low 16 bits of x at the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def curve(lng: Column, lat: Column) -> Column:
    """The place of a point on a Z curve of 2**16 x 2**16 cells over the earth; null for null."""
    x, y = (F.greatest(F.lit(0), F.least(F.lit(65535), F.floor((v + half) / (2 * half) * 65536))).cast("long") for v, half in ((lng, 180.0), (lat, 90.0)))
    return F.when(lng.isNotNull() & lat.isNotNull(), _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1)))


def write(places: DataFrame, path: str, bbox: str = "bbox", group_bytes: int = GROUP_BYTES, mode: str = "errorifexists") -> None:
    """Parquet of places with a nested box (xmin, xmax, ymin, ymax), dealt and sorted along the curve of the boxes' middles, equal ones by the box;
    each row group then spans a small part of the map, which its nested minima and maxima tell a reader.  Rows without a box come first."""
    middle = curve((F.col(f"{bbox}.xmin") + F.col(f"{bbox}.xmax")) / 2, (F.col(f"{bbox}.ymin") + F.col(f"{bbox}.ymax")) / 2)
    order = [F.col("__curve"), *[F.col(f"{bbox}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]]
    laid = places.withColumn("__curve", middle).repartitionByRange(*order).sortWithinPartitions(*order).drop("__curve")
    laid.write.mode(mode).option("parquet.block.size", group_bytes).option("parquet.page.size", max(1024, min(1 << 20, group_bytes // 8))).option("compression", "zstd").parquet(path)


def read(spark, path: str, box: tuple[float, float, float, float], bbox: str = "bbox") -> DataFrame:
    """The places whose box lies in `box`; the comparisons of nested fields reach the scan, which skips files' row groups by them."""
    return spatial.in_bbox(spark.read.parquet(path), box, bbox)
