"""Fixed virtual slots: records hash into some thousands of slots, and a versioned map says which shard holds each slot.

A record's slot never changes; only the map is edited.  Each version is a table of `slots` rows and is written once, so that readers of an
older version keep a consistent view and the moves between two versions are a join of two small tables.  All of it is DataFrame functions.

Null keys hash by their text.  A null text is empty.  Repeated rows are separate records, and as their key is one, so is their slot: a key that
holds more than a shard's share is a shard of its own beside what the map leaves there.  An empty table gives maps without bytes and no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Virtual slots; a map of this many rows is broadcast and balanced in one row.
SLOTS = 4096


def slot_of(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record: the first 32 bits of the SHA-256 of its key, modulo `slots`."""
    name = F.coalesce(key.cast("string"), F.concat(F.lit("null:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    return (F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long") % slots).cast("int")


class SlotMap:
    """The versions of a slot-to-shard map: version, slot, shard, bytes.  bytes is the load by which the version was made."""

    def __init__(self, scratch: Scratch, slots: int = SLOTS):
        self.scratch, self.spark, self.slots, self.last = scratch, scratch.spark, slots, -1

    def _write(self, rows: DataFrame) -> int:
        self.last += 1
        self.scratch.table(rows.select(F.lit(self.last).alias("version"), F.col("slot").cast("int").alias("slot"), F.col("shard").cast("int").alias("shard"), F.col("bytes").cast("long").alias("bytes")).coalesce(1), f"map-{self.last}")
        return self.last

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.scratch.path(f"map-{self.last if version is None else version}"))

    def create(self, shards: int) -> int:
        """The first version: equal runs of slots, before any load is known."""
        slot = F.col("id")
        return self._write(self.spark.range(0, self.slots, 1, 1).select(slot.alias("slot"), F.floor(slot * shards / self.slots).alias("shard"), F.lit(0).alias("bytes")))

    def rebalance(self, loads: DataFrame, shards: int) -> int:
        """The last version edited for the loads (slot, bytes) and this number of shards.

        Slots are gone through by falling bytes.  A slot stays where it is if its shard then holds at most the mean, else it goes to the shard
        that holds least, so few slots move and shards differ by about the smallest slots.  Slots without bytes stay, unless their shard is gone.
        The fold is over `slots` entries in one row, whatever the data."""
        rows = self.read().select("slot", "shard").join(loads, "slot", "left").select(F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"), "slot", "shard")
        entry = F.struct((-F.col("bytes")).alias("low"), "slot", "shard", "bytes")
        one = rows.groupBy().agg(F.array_sort(F.collect_list(entry)).alias("all"), F.sum("bytes").alias("total"))
        start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("held"), F.array().cast("array<int>").alias("picks"))

        def place(state: Column, s: Column) -> Column:
            held = state["held"]
            least = F.array_position(held, F.array_min(held)).cast("int") - 1
            own = F.least(s["shard"], F.lit(shards - 1))
            stays = (s["shard"] < shards) & ((s["bytes"] == 0) | ((F.get(held, own) + s["bytes"]) * shards <= F.col("total")))

            def put(pick: Column) -> Column:
                return F.struct(F.transform(held, lambda x, i: F.when(i == pick, x + s["bytes"]).otherwise(x)).alias("held"), F.concat(state["picks"], F.array(pick)).alias("picks"))

            return F.get(F.transform(F.array(F.when(stays, own).otherwise(least)), put), 0)  # a list of one, so that the choice is made once

        picked = one.select("all", F.aggregate("all", start, place)["picks"].alias("picks"))
        return self._write(picked.select(F.explode(F.arrays_zip("all", "picks")).alias("x")).select("x.all.slot", F.col("x.picks").alias("shard"), "x.all.bytes"))

    def moves(self, before: int, after: int) -> DataFrame:
        """slot, bytes, shard, to: what an edit moved."""
        a, b = self.read(before).select("slot", "shard"), self.read(after).select("slot", F.col("shard").alias("to"), "bytes")
        return a.join(F.broadcast(b), "slot").where(F.col("shard") != F.col("to")).select("slot", "bytes", "shard", "to")


def measured(docs: DataFrame, key: str, text: str, scratch: Scratch, slots: int = SLOTS) -> DataFrame:
    """A written table of key, size (UTF-8 bytes and 1), text_crc32, virtual_slot and uid, a number for each row."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), slot_of(F.col(key), F.col(text), slots).alias("virtual_slot"), F.monotonically_increasing_id().alias("uid"))
    return scratch.table(rows, "measured")


def loads(rows: DataFrame) -> DataFrame:
    """slot, bytes; sums are partial before the shuffle."""
    return rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"))


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """rows with the shard of their slot.  The map has a fixed number of rows, so no record moves."""
    return rows.join(F.broadcast(slot_map.select(F.col("slot").alias("virtual_slot"), "shard")), "virtual_slot")


def numbered(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows (key, uid, shard, ...) with `place`, from 0 without gaps in each shard by key (nulls first; equal keys by uid).

    Rows are dealt by ranges of (key, uid), so that no key is too large for a part, and sorted by shard within a part; a row's place is its
    distance from its shard's first row of the part, and what earlier parts hold.  Only a row per part and shard is summed up in order."""
    ranged = rows.repartitionByRange("key", "uid").sortWithinPartitions("shard", "key", "uid").withColumn("__at", F.monotonically_increasing_id())
    ranged = scratch.table(ranged.withColumn("__part", F.shiftright("__at", 33)), "ranged")
    starts = ranged.groupBy("shard", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = scratch.table(starts.withColumn("__base", before - F.col("__first")).drop("__first", "__n"), "starts")
    return ranged.join(starts, ["shard", "__part"]).withColumn("place", F.col("__base") + F.col("__at")).drop("__base", "__at", "__part")


def write_shards(docs: DataFrame, slot_map: DataFrame, path: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> None:
    """The documents themselves as Parquet, a folder `shard=k` for each shard; rows go from scan to file without a shuffle.  An own column
    named shard is kept as __shard."""
    own = docs.withColumnRenamed("shard", "__shard")
    placed(own.withColumn("virtual_slot", slot_of(F.col(key), F.col(text), slots)), slot_map).drop("virtual_slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, version.  Sizes of shards are near equal."""
    scratch = Scratch(spark, "sharding")
    rows = measured(docs, key, text, scratch)
    slot_map = SlotMap(scratch)
    slot_map.create(shards)
    version = slot_map.rebalance(loads(rows), shards)
    out = numbered(placed(rows, slot_map.read()), scratch)
    return out.select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("place").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("version"))


def _advanced(state: int, n: int) -> int:
    """A CRC-32 register after n bytes of zero."""
    for _ in range(8 * n):
        state = (state >> 1) ^ (0xEDB88320 if state & 1 else 0)
    return state


#: Bytes that the SQL takes at once: DuckDB has no CRC-32, so it is folded over bytes of a block and over blocks.
_BLOCK = 256
_BYTE = [_advanced(i, 1) for i in range(256)]
_JUMP = [_advanced(1 << i, _BLOCK) for i in range(32)]
_CRC = f"""h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(h) // 2 AS n FROM documents),
b AS (SELECT doc_id, k, CASE WHEN k = 0 THEN h[1:2 * (n % {_BLOCK})] ELSE h[2 * (n % {_BLOCK}) + (k - 1) * {2 * _BLOCK} + 1:2 * (n % {_BLOCK}) + k * {2 * _BLOCK}] END AS x FROM (SELECT *, unnest(range(n // {_BLOCK} + 1)) AS k FROM h)),
r AS (SELECT doc_id, k, list_reduce(list_prepend(CAST(CASE WHEN k = 0 THEN 4294967295 ELSE 0 END AS BIGINT), [CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT) FOR i IN range(length(x) // 2)]), lambda s, y: xor(s >> 8, CAST({_BYTE} AS BIGINT[])[(xor(s, y) & 255) + 1])) AS r FROM b),
c AS (SELECT doc_id, xor(list_reduce(list(r ORDER BY k), lambda s, y: xor(list_bit_xor([CASE WHEN (s >> i) & 1 = 1 THEN CAST({_JUMP} AS BIGINT[])[i + 1] ELSE 0 END FOR i IN range(32)]), y)), 4294967295) AS crc FROM r GROUP BY doc_id)"""
#: The query in SQL; the fold over slots is a recursion with a row for each slot that holds bytes.
SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, CAST(('0x' || sha256(coalesce(CAST(doc_id AS VARCHAR), 'null:' || sha256(coalesce(text, ''))))[1:8]) AS BIGINT) % {SLOTS} AS v FROM documents),
l AS (SELECT v, CAST(sum(size) AS BIGINT) AS b, CAST(floor(v * 16 / {SLOTS}) AS BIGINT) AS own FROM d GROUP BY v),
o AS (SELECT *, row_number() OVER (ORDER BY b DESC, v) AS k FROM l), total AS (SELECT CAST(sum(b) AS BIGINT) AS t FROM l),
f AS (SELECT CAST(0 AS BIGINT) AS k, [CAST(0 AS BIGINT) FOR x IN range(16)] AS held, CAST(-1 AS BIGINT) AS v, CAST(-1 AS BIGINT) AS pick
UNION ALL SELECT k, [h + CASE WHEN i - 1 = p THEN b ELSE 0 END FOR h, i IN held], v, p FROM (SELECT o.k, f.held, o.v, o.b, CASE WHEN (f.held[o.own + 1] + o.b) * 16 <= t THEN o.own ELSE list_position(f.held, list_min(f.held)) - 1 END AS p FROM f JOIN o ON o.k = f.k + 1, total)),
{_CRC}
SELECT d.doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, CAST(pick AS INTEGER) AS shard, row_number() OVER (PARTITION BY pick ORDER BY d.doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(d.v AS INTEGER) AS virtual_slot, 1 AS version FROM d JOIN f ON f.v = d.v JOIN c ON c.doc_id = d.doc_id"""
