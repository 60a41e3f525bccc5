"""Chat formatting after cumulative-snapshot collapse.

A log often holds a conversation several times, each record longer than the last.  Every turn gets a rolling hash of the
turns up to it; a conversation whose last hash is the hash of an earlier turn of a longer conversation is a snapshot of
it, and one with the same turns as another is a copy.  Anti-joins keep the maximal conversations, of copies that with the least conv_id,
and these are rendered turn by turn.

The prefix hash is a pair of running exclusive ors of 64-bit turn hashes that contain the turn's position: 128 bits, so that among 1e10
conversations a false match has a probability below 1e-18.  It is made
in two steps (blocks of turns, then turns within a block): no task holds a whole conversation however long it is, and the
output has a row per turn, joined by conversation only in transcripts().

Turns are ordered by turn (null first), then role, then text; nulls in role or text count as empty; repeated rows are turns
of their own.  A null conv_id is one conversation.  An empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Turns in a block of the two-step running hashes.
BLOCK = 256

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _beside(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    same = F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.block") == F.col("b.block"))
    return rows.alias("r").join(blocks.alias("b"), same)


def texts(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """A written table of the turns as they come: uid (a number for each row), conv_id, turn, role, text."""
    rows = conversations.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return scratch.table(rows, "texts")


def turns(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """uid, conv_id, position (from 0), prefix_a, prefix_b (the rolling hash of the turns up to this one) of the rows of texts().

    Roles and texts are hashed as they are scanned and don't travel; where a conversation repeats a turn's number, only the texts of these rows
    do, as their order needs them."""
    block = F.floor(F.coalesce("turn", F.lit(-(1 << 62))) / BLOCK).alias("block")
    narrow = rows.select("uid", "conv_id", "turn", block, *[F.xxhash64(F.lit(seed), "role", "text").alias(f"text_{c}") for seed, c in ((1, "a"), (2, "b"))])
    ties = scratch.table(narrow.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "ties")
    order = [F.col("turn").asc_nulls_first()]
    if not ties.isEmpty():
        same = F.col("r.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("r.turn").eqNullSafe(F.col("t.turn"))
        tied = rows.alias("r").join(ties.alias("t"), same, "left_semi").select("uid", "role", "text")
        narrow, order = narrow.join(tied, "uid", "left"), [*order, F.col("role"), F.col("text")]
    sizes = narrow.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("conv_id", "block").orderBy(*order, "uid")
    placed = _beside(narrow, sizes).select("r.*", "first")
    placed = placed.withColumn("position", F.col("first") + F.row_number().over(within) - 1)
    placed = placed.select("uid", "conv_id", "block", "position", *[F.xxhash64(F.lit(seed), "position", "text_a", "text_b").alias(c) for seed, c in ((3, "a"), (4, "b"))])
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("a").alias("sum_a"), F.bit_xor("b").alias("sum_b"))
    sums = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"sum_{c}").over(before), F.lit(0)).alias(f"before_{c}") for c in "ab"])
    upto = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    placed = _beside(placed, sums).select("r.*", "before_a", "before_b")
    prefix = [F.col(f"before_{c}").bitwiseXOR(F.bit_xor(c).over(upto)).alias(f"prefix_{c}") for c in "ab"]
    return scratch.table(placed.select("uid", "conv_id", "position", *prefix), "turns")


def collapse(rows: DataFrame) -> DataFrame:
    """conv_id and n_turns of the conversations to keep.  rows: turns()."""
    key = ["position", "prefix_a", "prefix_b"]
    sizes = rows.groupBy("conv_id").agg(F.max("position").alias("position"))
    same = F.col("r.conv_id").eqNullSafe(F.col("s.conv_id"))
    ends = rows.alias("r").join(sizes.alias("s"), same & (F.col("r.position") == F.col("s.position")), "left_semi").select("conv_id", *key)
    least = ends.groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNull()).alias("has_null"))
    least = least.select(*key, F.when(~F.col("has_null"), F.col("conv_id")).alias("conv_id"))  # a null conv_id comes first
    inner = rows.alias("r").join(sizes.alias("s"), same & (F.col("r.position") < F.col("s.position")), "left_semi").select(*key).distinct()
    kept = least.join(inner, key, "left_anti")
    return kept.select("conv_id", (F.col("position") + 1).alias("n_turns"))


def rendered() -> Column:
    return F.concat(F.lit(OPEN), F.col("role"), F.lit("\n"), F.col("text"), F.lit(CLOSE + "\n"))


def format_chats(conversations: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, position, n_turns, segment: the rendered turns of the maximal conversations.  Texts are shuffled once, to meet their places."""
    scratch = scratch or Scratch(conversations.sparkSession, "chat")
    said = texts(conversations, scratch)
    rows = turns(said, scratch)
    kept = rows.alias("r").join(collapse(rows).alias("k"), F.col("r.conv_id").eqNullSafe(F.col("k.conv_id"))).select("r.uid", "r.position", "k.n_turns")
    return said.join(kept, "uid").select("conv_id", "position", "n_turns", rendered().alias("segment"))


def transcripts(segments: DataFrame) -> DataFrame:
    """conv_id, n_turns, chat: one string per conversation, for conversations that fit a row."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    return segments.groupBy("conv_id", "n_turns").agg(joined.alias("chat"))


def query(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return format_chats(conversations)


SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS position,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT conv_id, position, role, text,
    sha256(string_agg(role || chr(31) || text, chr(30)) OVER (PARTITION BY conv_id ORDER BY position)) AS prefix,
    count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
ends AS (SELECT min(conv_id) AS conv_id, prefix, n_turns FROM p WHERE position = n_turns - 1 GROUP BY prefix, n_turns),
kept AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n_turns - 1))
SELECT conv_id, position, n_turns, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS segment FROM p WHERE conv_id IN (SELECT conv_id FROM kept)
"""
