"""A store from which a chunk, recipe or part was taken, or in which one was altered, doesn't read back."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("locusmill.llm")
from locusmill.llm import idstore, queries  # noqa: E402
from locusmill.llm.common import Scratch  # noqa: E402


@pytest.fixture(scope="module")
def whole(spark):
    rows = [(i, f"document {i} " + " ".join(f"w{(i * k) % 97}" for k in range(900))) for i in range(24)] + [(None, None)]
    store = idstore.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), queries.vocabulary("byte_bpe_50k.json"), Scratch(spark, "damage"))
    return store, sorted(idstore.digests(store).collect(), key=str)


def damaged(spark, store, name, change):
    """A copy of the store whose table `name` went through `change`."""
    other = Scratch(spark, "damaged")
    for table in ("recipes", "parts", "manifest", "chunks"):
        df = spark.read.parquet(store.path(table))
        other.table(change(df) if table == name else df, table)
    return other


CHANGES = {
    "nothing": ("chunks", lambda df: df),
    "a chunk lost": ("chunks", lambda df: df.orderBy("digest").offset(1)),
    "a chunk altered": ("chunks", lambda df: df.withColumn("payload", F.when(F.col("digest") == df.agg(F.min("digest")).first()[0], F.concat("payload", F.lit(b"xy"))).otherwise(F.col("payload")))),
    "a recipe lost": ("recipes", lambda df: df.where("doc_id is null or doc_id <> 5")),
    "a recipe twice": ("recipes", lambda df: df.unionAll(df.where("doc_id = 5"))),
    "an id altered": ("recipes", lambda df: df.withColumn("doc_id", F.when(F.col("doc_id") == 5, 99).otherwise(F.col("doc_id")))),
    "lengths altered": ("recipes", lambda df: df.withColumn("n_tokens", F.col("n_tokens") + 1)),
    "ends altered": ("recipes", lambda df: df.withColumn("ends", F.transform("ends", lambda e: e + 1))),
    "chunks swapped": ("recipes", lambda df: df.withColumn("digests", F.reverse("digests"))),
    "a place altered": ("recipes", lambda df: df.withColumn("start_in_part", F.when(F.col("doc_id") == 5, 0).otherwise(F.col("start_in_part")))),
    "all recipes lost": ("recipes", lambda df: df.limit(0)),
    "a part lost": ("parts", lambda df: df.orderBy("part").offset(1)),
    "a part altered": ("parts", lambda df: df.withColumn("n", F.col("n") + 1)),
    "the manifest lost": ("manifest", lambda df: df.limit(0)),
    "the manifest altered": ("manifest", lambda df: df.withColumn("seal", F.col("seal") + 1)),
}


@pytest.mark.parametrize("what", CHANGES)
def test_damage_is_an_error(spark, whole, what):
    store, want = whole
    other = damaged(spark, store, *CHANGES[what])
    if what == "nothing":
        assert sorted(idstore.digests(other).collect(), key=str) == want and len(want) == 25
        return
    with pytest.raises(Exception, match="missing|match|differ"):
        idstore.digests(other).collect()
    with pytest.raises(Exception, match="missing|match|differ"):
        idstore.read_ids(other).collect()
