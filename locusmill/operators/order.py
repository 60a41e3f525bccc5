"""Total orders over tables of any size: places, chunks, ranks and running sums, from ranges of rows and not from one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..scratch import Scratch


def _ranged(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """rows dealt by ranges of the order and sorted within, written with `__at`: part and place within it.  What follows reads the table, so
    counts and places speak of the same parts, however often either is computed."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    return scratch.table(ranged.withColumn("__part", F.shiftright("__at", 33)), "ranged")


def _before(parts: DataFrame, value: str) -> DataFrame:
    """parts (a row per part) with the sum of `value` over earlier parts in place of it."""
    total = F.sum(value).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    return parts.withColumn(value, F.coalesce(total, F.lit(0)))


def numbered(rows: DataFrame, *order: Column, out: str = "place", start: int = 1) -> DataFrame:
    """rows with their place (from `start`) in a total order.

    A part's first place is the number of rows before it; a row's is that plus its distance from the part's first row.  Only a row per part
    goes through one task.  Rows that the order does not tell apart share a part, so the last of its columns should be an id."""
    scratch = Scratch(rows.sparkSession, "numbered")
    ranged = _ranged(rows, list(order), scratch)
    parts = ranged.groupBy("__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    parts = scratch.table(_before(parts, "__n").select("__part", (F.col("__n") - F.col("__first") + start).alias("__base")), "parts")
    return ranged.join(parts, "__part").withColumn(out, F.col("__base") + F.col("__at")).drop("__base", "__at", "__part")


def chunked(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with chunk and pos, by key order: `size` consecutive rows make a chunk."""
    at = F.col("__place")
    return numbered(rows, F.col(key), out="__place", start=0).withColumns({"chunk": F.floor(at / size), "pos": (at % size).cast("int")}).drop("__place")


def ranked(rows: DataFrame, value: str, out: str = "place") -> DataFrame:
    """rows with the rank of their value, largest first: 1 and the number of rows with a larger value; ties share it.  Null values, which have
    no rank, are dropped.  Equal values are counted before they are put in order, so a frequent value is one row."""
    scratch = Scratch(rows.sparkSession, "ranked")
    kept = rows.where(F.col(value).isNotNull())
    counts = _ranged(kept.groupBy(value).agg(F.count("*").alias("__n")), [F.col(value).desc()], scratch)
    parts = scratch.table(_before(counts.groupBy("__part").agg(F.sum("__n").alias("__base")), "__base"), "parts")
    within = F.coalesce(F.sum("__n").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.withColumn("__within", within).join(parts, "__part").select(value, (F.col("__base") + F.col("__within") + 1).alias(out))
    return kept.join(places, value)


def dictionary(rows: DataFrame, value: str, ord_col: str) -> DataFrame:
    """value, code: codes from 0 in order of first appearance; one row per distinct value."""
    first = rows.groupBy(value).agg(F.min(ord_col).alias("__f"))
    return numbered(first, F.col("__f"), F.col(value), out="code", start=0).select(value, "code")
