"""The queries opN_<name> over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import asof, chat, cluster, decontaminate, html, idstore, neardup, packing, quality, rules, secrets, sharding, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(spark, _table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idstore.query(spark, _table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.query(spark, _table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.query(spark, _table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.query(spark, _table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.query(spark, _table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(spark, _table(spark, sf_dir, "conversations"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.query(spark, _table(spark, sf_dir, "pages"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.query(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.query(spark, _table(spark, sf_dir, "documents"))


def op12_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.query(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.query(spark, _table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secret_scan, op2_quality_classifier, op3_id_store, op4_near_duplicates, op5_quality_rules, op6_packing, op7_main_text, op8_chat_format, op9_url_filter, op10_decontamination, op11_sharding, op12_as_of, op13_centroids)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat.SQL, "op9_url_filter": urls.SQL, "op11_sharding": sharding.SQL, "op12_as_of": asof.SQL, "op13_centroids": cluster.SQL}
