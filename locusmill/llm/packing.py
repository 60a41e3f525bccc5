"""Packing by shortest-pack-first over the length histogram.

A document's ids (with the end id) are cut into full pieces of `limit` and a rest.  The histogram of rest lengths,
at most `limit` numbers, is all that reaches the driver.  Lengths are placed longest first, each into the open
pattern whose sum is smallest among those where it fits; patterns carry counts, so the work depends on
the number of distinct lengths, not of documents.  Pieces then find their place by rank among
pieces of equal length.

Nulls: a null text is empty, so its document is its end id alone; a null id is kept.  Repeated rows are separate
documents.  An empty table gives no pieces.  Other columns are ignored."""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, releasing, ship, slices
from .tokens import encoder

LIMIT, END_ID = 2048, 1

PIECES = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """One row per piece of at most `limit` ids: every whole text, encoded, with the end id, cut at multiples of `limit`."""
    ship(docs.sparkSession)
    tail = end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer)
        for b in batches:
            uids, parts, ids, texts = (b.column(i).to_pylist() for i in range(4))
            for lo, hi in slices(texts):
                rows: list[tuple] = []
                for i in range(lo, hi):
                    raw = enc.encode(texts[i]) + tail
                    n = len(raw) // 4
                    rows += [(uids[i], parts[i], ids[i], s, min(limit, n - s), n, raw[4 * s : 4 * (s + limit)]) for s in range(0, n, limit)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    SCHEMA = pa.schema([("uid", pa.int64()), ("part", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(run), PIECES)


def patterns(histogram: dict[int, int], limit: int = LIMIT) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) for every packing pattern; the counts use up the histogram exactly.

    Longest length first.  The open patterns lie in buckets by their sum; a length goes to the smallest sum, that is
    the largest room, as long as it fits; as many packs as there are pieces (or packs) move together."""
    by_sum: dict[int, list[list]] = defaultdict(list)  # sum -> [count, lengths]
    sums: list[int] = []

    def put(count: int, lengths: tuple[int, ...]) -> None:
        s = sum(lengths)
        if s not in by_sum or not by_sum[s]:
            heapq.heappush(sums, s)
        for slot in by_sum[s]:
            if slot[1] == lengths:
                slot[0] += count
                return
        by_sum[s].append([count, lengths])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        moved: list[tuple[int, tuple[int, ...]]] = []
        while left:
            while sums and not by_sum[sums[0]]:
                heapq.heappop(sums)
            if not sums or sums[0] + length > limit:
                moved.append((left, (length,)))
                break
            slot = by_sum[sums[0]][-1]
            n = min(left, slot[0])
            moved.append((n, (*slot[1], length)))
            left -= n
            slot[0] -= n
            if not slot[0]:
                by_sum[sums[0]].pop()
        for n, lengths in moved:
            put(n, lengths)
    return [(n, lengths) for s in sorted(by_sum) for n, lengths in by_sum[s]]


def place(parts: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """The rows of pieces() (or of a projection that keeps uid, part, start and length) with sequence_id and offset.

    Ranks among equal lengths come in two steps, counts per task of the scan and numbers within one, so that
    no task holds all pieces of a frequent length."""
    spark = parts.sparkSession
    parts = scratch.table(parts, "pieces")
    counts = scratch.table(parts.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` rows
    slots, used, first = [], dict.fromkeys(histogram, 0), 0
    for count, lengths in patterns(histogram, limit):
        offset = 0
        for length in lengths:
            slots.append((length, used[length], used[length] + count, first, offset))
            used[length] += count
            offset += length
        first += count
    slots = spark.createDataFrame(slots, "length long, rank_from long, rank_to long, first_sequence long, offset long")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    ranks = (
        parts.select("uid", "part", "start", "length")
        .withColumn("k", F.row_number().over(Window.partitionBy("part", "length").orderBy("uid", "start")))
        .join(before.select("part", "length", F.coalesce("before", F.lit(0)).alias("before")), ["part", "length"])
        .select("uid", "start", "length", (F.col("before") + F.col("k") - 1).alias("rank"))
    )
    # The slots are bounded by the number of distinct lengths, whatever the number of documents.
    found = ranks.join(F.broadcast(slots), "length").where((F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    where = found.select("uid", "start", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
    return parts.join(where, ["uid", "start"])


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, end_id: int = END_ID, scratch: Scratch | None = None) -> DataFrame:
    """Every piece with its ids, sequence and offset."""
    return place(pieces(docs, tokenizer, limit, end_id), scratch or Scratch(docs.sparkSession, "packing"), limit)


def sequences(packed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """sequence_id, n_ids, padded (the length to pad to: `limit`, or n_ids where that is a power of two), ids, doc_ids,
    offsets.  A sequence holds at most `limit` ids, which bounds each group."""
    row = F.struct("offset", "ids", "doc_id")
    grouped = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(row)).alias("p"), F.sum("length").alias("n_ids"))
    power = F.col("n_ids") == F.shiftleft(F.lit(1), (F.length(F.bin("n_ids")) - 1).cast("int"))
    ids = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return grouped.select("sequence_id", "n_ids", F.when(power, F.col("n_ids")).otherwise(F.lit(limit)).alias("padded"), ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"))


def query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    parts = pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return place(parts, Scratch(spark, "packing")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
