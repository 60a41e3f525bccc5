"""The driver's tables seen as places: parts are venues, suppliers stations, nations wards.  Rules and taxonomy are examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import RulePack, rolled_up

PACK = RulePack(
    rules=(("machinery", "gear|widget"), ("joining", "bolt|rod"), ("tableware", "plate|ring"), ("novelty", "(new|hot) gizmo")),
    by_category={"LARGE": "bulk", "ECONOMY": "plain"},
    excluded_categories=("PROMO",),
    excluded_names="old anvil",
)
TAXONOMY = {"machinery": ("industry", "moving"), "joining": ("industry", "fixing"), "bulk": ("industry", "heavy"), "tableware": ("home", "table"), "novelty": ("home", "fancy"), "plain": ("home", "basic")}
MIDS = [m for _, m in TAXONOMY.values()]
RADII = [1000, 2000, 5000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(key: Column) -> tuple[Column, Column]:
    k = key.cast("long")
    return (F.lit(35.6) + ((k * 7919) % 2000) / F.lit(1e4)).alias("lat"), (F.lit(139.6) + ((k * 104729) % 2500) / F.lit(1e4)).alias("lng")


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, name, category, lat, lng, ward, label, method, major, mid of every part."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("category"), *place(F.col("p_partkey")), (F.col("p_partkey") % 25).alias("ward"))
    c = p.withColumn("c", PACK.classify(F.col("name"), F.col("category"))).select("*", "c.label", "c.method", "c.evidence").drop("c")
    major, mid = rolled_up(F.col("label"), TAXONOMY)
    return c.withColumns({"major": major, "mid": mid})


def counted(v: DataFrame) -> DataFrame:
    """Venues that count: excluded ones do not."""
    return v.where(F.col("label") != "excluded")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("station"), *place(F.col("s_suppkey") * 37 + 11), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("passengers"))


# The same in SQL, as common table expressions.
PLACE = "35.6e0 + ((CAST({k} AS BIGINT)*7919) % 2000)/1e4 AS lat, 139.6e0 + ((CAST({k} AS BIGINT)*104729) % 2500)/1e4 AS lng"
SQL_VENUES = (
    """venues0 AS (SELECT p_partkey AS id, p_name AS name, p_type AS category, """
    + PLACE.format(k="p_partkey")
    + """, p_partkey % 25 AS ward,
  CASE WHEN p_type = 'PROMO' OR regexp_matches(p_name, 'old anvil') THEN 'excluded' WHEN regexp_matches(p_name, 'gear|widget') THEN 'machinery'
    WHEN regexp_matches(p_name, 'bolt|rod') THEN 'joining' WHEN regexp_matches(p_name, 'plate|ring') THEN 'tableware' WHEN regexp_matches(p_name, '(new|hot) gizmo') THEN 'novelty'
    WHEN p_type = 'LARGE' THEN 'bulk' WHEN p_type = 'ECONOMY' THEN 'plain' ELSE 'unresolved' END AS label,
  CASE WHEN p_type = 'PROMO' OR regexp_matches(p_name, 'old anvil') THEN 'excluded' WHEN regexp_matches(p_name, 'gear|widget|bolt|rod|plate|ring|(new|hot) gizmo') THEN 'name'
    WHEN p_type IN ('LARGE', 'ECONOMY') THEN 'category' ELSE 'unresolved' END AS method FROM part),
venues AS (SELECT *, CASE WHEN label IN ('machinery', 'joining', 'bulk') THEN 'industry' WHEN label IN ('tableware', 'novelty', 'plain') THEN 'home' ELSE 'unknown' END AS major,
  CASE label WHEN 'machinery' THEN 'moving' WHEN 'joining' THEN 'fixing' WHEN 'bulk' THEN 'heavy' WHEN 'tableware' THEN 'table' WHEN 'novelty' THEN 'fancy' WHEN 'plain' THEN 'basic' ELSE 'unknown' END AS mid FROM venues0)"""
)
SQL_STATIONS = "stations AS (SELECT s_suppkey AS station, " + PLACE.format(k="s_suppkey*37+11") + ", CASE WHEN s_acctbal > 0 THEN s_acctbal END AS passengers FROM supplier)"


def sql_haversine(a_lat: str, a_lng: str, b_lat: str, b_lng: str) -> str:
    return f"2*6371000.0e0*asin(sqrt(pow(sin((radians({b_lat})-radians({a_lat}))/2),2)+cos(radians({a_lat}))*cos(radians({b_lat}))*pow(sin(radians({b_lng}-{a_lng})/2),2)))"
