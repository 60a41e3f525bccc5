"""Places, chunks and ranks over more rows than one part holds."""

from pyspark.sql import functions as F

from locusmill.operators import order


def test_every_row_gets_its_place(spark):
    n = 400_000
    rows = spark.range(0, n, 1, 8).select(F.col("id").alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v"), F.repeat(F.lit("wide "), 8).alias("extra"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = order.numbered(rows, F.col("v").desc(), F.col("k"))
        assert set(got.columns) == {"k", "v", "extra", "place"}
        found = got.select("v", "k", "place").toPandas().sort_values("place")
        assert found["place"].tolist() == list(range(1, n + 1))
        assert found.sort_values(["v", "k"], ascending=[False, True])["k"].tolist() == found["k"].tolist()
        chunks = order.chunked(rows, "k", 100).groupBy("chunk").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b"), F.count_distinct("pos").alias("p"))
        bad = chunks.where("n <> 100 or p <> 100 or a <> chunk * 100 or b <> a + 99").count()
        assert chunks.count() == n // 100 and bad == 0
        ranks = order.ranked(rows.select("k", "v"), "v").groupBy("v").agg(F.min("place").alias("place"), F.max("place").alias("same"), F.count("*").alias("n")).toPandas().sort_values("v", ascending=False)
        assert ranks["place"].tolist() == (1 + ranks["n"].cumsum() - ranks["n"]).tolist() == ranks["same"].tolist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_orders_of_little(spark):
    none = spark.createDataFrame([], "k long, v long")
    assert order.numbered(none, F.col("k")).collect() == [] and order.chunked(none, "k", 3).collect() == [] and order.ranked(none, "v").collect() == []
    some = spark.createDataFrame([(1, 5), (2, None), (3, 5), (4, 1)], "k long, v long")
    assert sorted((r["k"], r["place"]) for r in order.ranked(some, "v").collect()) == [(1, 1), (3, 1), (4, 3)]
    assert sorted((r["v"], r["code"]) for r in order.dictionary(some.where("v is not null"), "v", "k").collect()) == [(1, 1), (5, 0)]
