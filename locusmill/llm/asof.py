"""Point-in-time join by an iterative as-of walk.

Each ask (a key and a time) starts at the latest version of its key that is not after it, and follows predecessor pointers while the version
found is not usable, until one is or the version is older than the longest lifetime.  Versions of a key are ordered by event, then by falling
arrival, then by id, so the first usable one on the walk has the latest event, of these the earliest arrival, of these the largest id.

Versions and asks are dealt together by ranges of (key, time, ...) down to single rows, so neither a key nor a moment is too large for a part.
Within a part the rows stream by in order and the walk is vectorised; only asks whose walk leaves the front of their part go on to the versions
of the part before, block by block, in further rounds.  Nothing is broadcast or collected, and every round reads written tables.

Nulls: asks without key or time and versions without key, event, arrival, expiry or id find and give nothing.  Repeated versions are one version;
if they differ in other columns the largest wins.  Repeated asks are answered each.  Empty tables give no rows or no winners."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, releasing, ship

#: Versions that an ask looks at in one round beyond its own part.
BLOCK = 256
#: Asks that stand for one label id's repetitions, at most so many each.
COPIES = 1000


class _Recent:
    """The versions of the current key that can still be found, in order."""

    def __init__(self, schema: pa.Schema):
        self.rows = schema.empty_table()
        self.run = np.empty(0, np.int64)
        self.cut = -1  # the run of which versions were let go

    def add(self, rows: pa.Table, run: np.ndarray) -> None:
        self.rows = pa.concat_tables([self.rows, rows])
        self.run = np.concatenate([self.run, run])

    def forget(self, run: int, before: int) -> None:
        """Keep what lies in this run and after this time."""
        keep = self.run == run
        late = self.rows["time"].to_numpy() > before
        if (keep & ~late).any():
            self.cut = run
        self.rows = self.rows.filter(pa.array(keep & late)).combine_chunks()
        self.run = self.run[keep & late]


def _walk(lifetime: int, features: list[str]):
    """Batches of ordered versions and asks -> the same rows, `pos` (versions of the part before an ask, or before and with a version), and for
    asks `winner`, `event`, the winner's features, and `open` for those that have to go on in the part before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent, seen, run_no, last = None, 0, 0, None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            recent = recent or _Recent(t.schema)
            key = t["key"].combine_chunks()
            new = np.ones(len(key), bool)
            new[1:] = pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is not None and last != key[0].as_py()
            last = key[-1].as_py()
            runs = run_no + np.cumsum(new)
            run_no = int(runs[-1])
            ask = t["ask"].to_numpy().astype(bool)
            held = len(recent.run)
            recent.add(t.filter(pa.array(~ask)), runs[~ask])
            before = np.cumsum(~ask)
            at = np.flatnonzero(ask)
            ptr, now, own = held + before[at] - 1, t["time"].to_numpy()[at], runs[at]
            event, arrival, expiry = (recent.rows[c].to_numpy() for c in ("time", "arrival", "expiry"))
            found, opened = np.full(len(at), -1, np.int64), np.zeros(len(at), bool)
            live = np.arange(len(at))
            while len(live):
                p, n = ptr[live], now[live]
                off = p < 0
                opened[live[off]] = (own[live[off]] == 0) & (recent.cut != 0)  # the part's first key may go on in the part before
                live, p, n = live[~off], p[~off], n[~off]
                same = (recent.run[p] == own[live]) & (n - event[p] < lifetime)
                live, p, n = live[same], p[same], n[same]
                good = (arrival[p] <= n) & (n < expiry[p])
                found[live[good]] = p[good]
                live = live[~good]
                ptr[live] -= 1
            take = np.full(len(ask), -1, np.int64)
            take[at] = found
            index = pa.array(take, mask=take < 0)
            flag = np.zeros(len(ask), bool)
            flag[at] = opened
            out = {name: t[name] for name in t.schema.names if name not in features}
            out |= {name: pc.if_else(pa.array(ask), recent.rows[name].combine_chunks().take(index) if len(recent.run) else pa.nulls(len(ask), t.schema.field(name).type), t[name].combine_chunks()) for name in features}
            out["winner"] = recent.rows["id"].combine_chunks().take(index) if len(recent.run) else pa.nulls(len(ask), pa.int64())
            out["event"] = recent.rows["time"].combine_chunks().take(index) if len(recent.run) else pa.nulls(len(ask), pa.int64())
            out["pos"] = pa.array(seen + before)
            out["open"] = pa.array(flag)
            seen += int(before[-1])
            recent.forget(run_no, int(t["time"][-1].as_py()) - lifetime)
            yield from pa.table(out).combine_chunks().to_batches()

    return run


def as_of(asks: DataFrame, versions: DataFrame, features: list[str], lifetime: int, scratch: Scratch) -> DataFrame:
    """asks (key, time, and any other columns) with winner, event and the features of the version found, all null without one.

    versions: key string, id, event, arrival, expiry long, and the features; a version is usable at t if event <= t, arrival <= t < expiry and
    t - event < lifetime.  The walk costs as many steps as versions lie between an ask and its answer, or the lifetime's end."""
    ship(asks.sparkSession)
    asks = scratch.table(asks, "asks")  # rows are numbered below, which a written table makes repeatable
    extra = [c for c in asks.columns if c not in ("key", "time")]
    null = [F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in features]
    none = F.lit(None).cast("long")
    kept = F.struct(*[F.col(c) for c in extra]) if extra else F.struct(F.lit(True).alias("__none"))
    times = [F.col(c).cast("long").alias(c) for c in ("arrival", "expiry", "id")]
    v = versions.dropna(subset=["key", "id", "event", "arrival", "expiry"]).select("key", F.col("event").cast("long").alias("time"), F.lit(False).alias("ask"), *times, F.lit(None).cast(asks.select(kept.alias("x")).schema["x"].dataType).alias("extra"), *features)
    usable = asks.where(F.col("key").isNotNull() & F.col("time").isNotNull())
    a = usable.select("key", F.col("time").cast("long").alias("time"), F.lit(True).alias("ask"), none.alias("arrival"), none.alias("expiry"), none.alias("id"), kept.alias("extra"), *null)
    both = v.unionByName(a).withColumn("uid", F.monotonically_increasing_id())
    order = ["key", "time", "ask", F.col("arrival").desc(), "id", *features, "uid"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([f for f in both.schema.fields if f.name not in features] + [both.schema[c] for c in features])
    schema = schema.add("winner", "long").add("event", "long").add("pos", "long").add("open", "boolean")
    walked = scratch.table(dealt.mapInArrow(releasing(_walk(lifetime, features)), schema).withColumn("part", F.spark_partition_id()), "walked")
    answers = ["key", "time", "extra", "winner", "event", *features]
    done = walked.where(F.col("ask") & ~F.col("open")).select(answers)
    pending = walked.where(F.col("ask") & F.col("open"))
    if not pending.isEmpty():
        for rest in _rounds(pending, walked.where(~F.col("ask")), features, lifetime, scratch):
            done = done.unionByName(rest.select(answers))
    missing = asks.where(F.col("key").isNull() | F.col("time").isNull()).select("key", F.col("time").cast("long").alias("time"), kept.alias("extra"), none.alias("winner"), none.alias("event"), *null)
    out = done.unionByName(missing)
    return out.select("key", "time", *[F.col(f"extra.{c}").alias(c) for c in extra], "winner", "event", *features)


def _rounds(pending: DataFrame, versions: DataFrame, features: list[str], lifetime: int, scratch: Scratch) -> Iterator[DataFrame]:
    """Written tables of answers to the pending asks.  An ask's pointer is a block of an earlier part; a round follows it by one block, or by one
    part where a part holds no versions.  An ask is answered by a usable version of the block, or ends with none at another key or past the lifetime."""
    block = F.floor((F.col("pos") - 1) / BLOCK)
    v = versions.withColumn("block", block.cast("long")).select("part", "block", F.struct("pos", "key", F.col("time").alias("event"), "arrival", "expiry", "id", *features).alias("v"))
    last = scratch.table(v.groupBy("part").agg(F.max("block").alias("last")), "last")
    keep = ["uid", "key", "time", "extra"]

    def to_part(rows: DataFrame) -> DataFrame:
        return rows.join(last, "part", "left").withColumnRenamed("last", "block")

    rows, k = to_part(pending.select(*keep, (F.col("part") - 1).alias("part"))), 0
    rows = scratch.table(rows, "pending-0")
    while True:
        met = rows.join(v, ["part", "block"], "left")
        other = (F.col("v.key") != F.col("key")) | (F.col("time") - F.col("v.event") >= lifetime)
        good = (F.col("v.key") == F.col("key")) & (F.col("v.arrival") <= F.col("time")) & (F.col("time") < F.col("v.expiry")) & (F.col("time") - F.col("v.event") < lifetime)
        best = met.groupBy("uid", "part", "block").agg(F.first("key").alias("key"), F.first("time").alias("time"), F.first("extra").alias("extra"), F.max(F.when(good, F.col("v.pos"))).alias("at"), F.max_by("v", F.when(good, F.col("v.pos"))).alias("v"), F.coalesce(F.bool_or(other), F.lit(False)).alias("ends"))
        met = scratch.table(best, f"met-{k}")
        over = F.col("at").isNotNull() | F.col("ends") | (F.col("part") < 0)
        won = F.when(F.col("at").isNotNull(), F.col("v"))
        yield met.where(over).select("key", "time", "extra", won["id"].alias("winner"), won["event"].alias("event"), *[won[c].alias(c) for c in features])
        rest = met.where(~over)
        same = rest.where(F.col("block") > 0).select(*keep, "part", (F.col("block") - 1).alias("block"))
        left = to_part(rest.where(F.coalesce(F.col("block"), F.lit(0)) == 0).select(*keep, (F.col("part") - 1).alias("part")))
        k += 1
        rows = scratch.table(same.unionByName(left), f"pending-{k}")
        if rows.isEmpty():
            return


def _drawn(doc_id: Column) -> list[Column]:
    """The first four eight-digit groups of the SHA-256 of a decimal id, as numbers."""
    digest = F.sha2(doc_id.cast("string"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per label: doc_id, t, version_id, age, status (none, stale or fresh), n_chars and lang of a fresh winner.

    A label whose document is missing or has no source is `none`; a document repeated with several sources asks about the least.  Labels of one
    doc_id ask the same, so they are counted, walk once per COPIES of them, and are repeated at the end."""
    a, b, c, d = _drawn(F.col("doc_id"))
    event = a % 20000
    versions = docs.select(F.col("source").alias("key"), F.col("doc_id").alias("id"), event.alias("event"), (event - 60 + b % 300).alias("arrival"), (event + c % 900).alias("expiry"), F.col("n_chars").cast("long").alias("n_chars"), "lang")
    asked = labels.groupBy("doc_id").agg(F.count("*").alias("n"))
    sources = docs.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("source").alias("key"))
    chunks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))
    asks = asked.join(sources, "doc_id", "left").select("key", (d % 20000).alias("time"), "doc_id", "n", F.explode(chunks).alias("chunk"))
    asks = asks.withColumn("copies", F.least(F.lit(COPIES), F.col("n") - F.col("chunk") * COPIES).cast("int")).drop("n", "chunk")
    found = as_of(asks, versions, ["n_chars", "lang"], 900, Scratch(spark, "asof"))
    age = F.col("time") - F.col("event")
    status = F.when(F.col("winner").isNull(), "none").when(age > 60, "stale").otherwise("fresh")
    fresh = status == "fresh"
    out = found.select("doc_id", F.col("time").alias("t"), F.col("winner").alias("version_id"), age.alias("age"), status.alias("status"), F.when(fresh, F.col("n_chars")).alias("n_chars"), F.when(fresh, F.col("lang")).alias("lang"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("__copy"))
    return out.drop("__copy")


def _group(k: int) -> str:
    return f"CAST('0x' || sha256(CAST(doc_id AS VARCHAR))[{8 * k + 1}:{8 * k + 8}] AS BIGINT)"


SQL = f"""WITH v0 AS (SELECT doc_id, source, n_chars, lang, {_group(0)} % 20000 AS event, {_group(1)} AS b, {_group(2)} AS c FROM documents),
v AS (SELECT *, event - 60 + b % 300 AS arrival, event + c % 900 AS expiry FROM v0),
s AS (SELECT doc_id, min(source) AS source FROM documents GROUP BY 1),
a AS (SELECT row_number() OVER () AS k, l.doc_id, {_group(3).replace('doc_id', 'l.doc_id')} % 20000 AS t, s.source FROM labels l LEFT JOIN s ON s.doc_id = l.doc_id),
m AS (SELECT a.k, v.doc_id AS version_id, v.event, v.n_chars, v.lang, row_number() OVER (PARTITION BY a.k ORDER BY event DESC, arrival, v.doc_id DESC) AS place FROM a JOIN v ON v.source = a.source AND v.event <= a.t AND v.arrival <= a.t AND a.t < v.expiry)
SELECT a.doc_id, t, version_id, t - event AS age, CASE WHEN version_id IS NULL THEN 'none' WHEN t - event > 60 THEN 'stale' ELSE 'fresh' END AS status, CASE WHEN t - event <= 60 THEN CAST(n_chars AS BIGINT) END AS n_chars, CASE WHEN t - event <= 60 THEN lang END AS lang FROM a LEFT JOIN m ON m.k = a.k AND place = 1"""
