"""Content-addressed store of token ids.

Layout of a store, all Parquet:
  recipes/  one row per document in ascending doc_id order (file by file, row by row): its chunk digests and their ends,
            Merkle root, and the number of ids before it within its part
  parts/    ids and documents in each part, and a seal over its recipes' roots and places
  manifest/ one row: a seal over all parts
  chunks/   each distinct chunk once: digest, ids as little-endian unsigned integers of `width` bytes

A rolling hash over windows of ids cuts a document's id stream where the hash's low bits vanish, so equal passages give equal
chunks wherever they stand.  A chunk's address is its 128-bit BLAKE2 digest; a document's manifest is the Merkle root over its
chunk digests, below its id, length and chunk ends.  Reading checks the recipes against the parts and these against the manifest, every recipe
against its root and every chunk against its address; whatever is missing, added or altered is an error.

Nulls: a null text is empty, its document is the end id alone; a null doc_id sorts first.  Documents with one doc_id keep the
order of the scan.  An empty table gives an empty store.  Other columns are ignored."""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, mix, ship, slices
from .tokens import encoder

END_ID = 2
#: Characters of a step, and pieces that a worker remembers (some 220 MB).
CHARS, PIECES = 1_000_000, 1_000_000
#: The rolling window in ids (a power of two); a chunk ends where the hash has MASK bits of zero; chunks have LEAST to MOST ids (the last may be shorter).
WINDOW, MASK, LEAST, MOST = 16, 8, 64, 2048

_STAGED = pa.schema(
    [("uid", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary())), ("ends", pa.list_(pa.int64())), ("payloads", pa.list_(pa.binary()))]
)
_STAGED_SPARK = "uid long, doc_id long, n_tokens long, root binary, digests array<binary>, ends array<long>, payloads array<binary>"


@functools.cache
def _scrambled() -> np.ndarray:
    return mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def rolling(ids: np.ndarray) -> np.ndarray:
    """Buzhash of the window that ends at each position: the exclusive or of the window's scrambled ids, rotated by age.  A window
    is its later half and its earlier half, rotated by a half's length, so it doubles with each step."""
    h = _scrambled()[ids] if not len(ids) or ids.max() < 1 << 16 else mix(ids.astype(np.uint64) + np.uint64(1))
    size = 1
    while size < WINDOW:
        r = np.uint64(size)
        turned = (h[:-size] << r) | (h[:-size] >> (np.uint64(64) - r))
        h = h.copy()
        h[size:] ^= turned
        size *= 2
    return h


def cuts(n: int, marks: np.ndarray) -> list[int]:
    """Chunk ends of a document of n ids.  marks: positions after which the rolling hash allows a cut."""
    ends, last = [], 0
    for m in marks.tolist():
        while m - last > MOST:
            last += MOST
            ends.append(last)
        if m - last >= LEAST:
            ends.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if n > last:
        ends.append(n)
    return ends


def digest(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd one moves up unchanged; no leaves: the digest of nothing."""
    level = list(leaves) or [digest(b"")]
    while len(level) > 1:
        level = [digest(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def recipe_root(doc_id: int | None, n_tokens: int, ends: list[int], leaves: list[bytes]) -> bytes:
    """The root of a document: its id, length and chunk ends above the tree over its chunks."""
    return digest(b"\2" + f"{doc_id}:{n_tokens}:{','.join(map(str, ends))}:".encode() + merkle(leaves))


def stage(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Each document with its chunks."""
    ship(docs.sparkSession)
    kind, tail = f"<u{width}", end_id.to_bytes(4, "little")

    def run(batches):
        enc = encoder(tokenizer, PIECES)
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in slices(texts, CHARS):
                raws = [enc.encode(t) + tail for t in texts[lo:hi]]
                sizes = np.array([len(r) // 4 for r in raws])
                all_ids = np.frombuffer(b"".join(raws), "<u4")
                ends = np.cumsum(sizes)
                begins = ends - sizes
                marks = np.flatnonzero(rolling(all_ids) & np.uint64((1 << MASK) - 1) == 0) + 1
                doc = np.searchsorted(ends, marks - 1, side="right")
                inside = marks - begins[doc] >= WINDOW  # a window never spans two documents
                marks, doc = marks[inside], doc[inside]
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1))
                own = [cuts(int(n), marks[bounds[i] : bounds[i + 1]] - begins[i]) for i, n in enumerate(sizes)]
                first = np.cumsum([0, *map(len, own)])  # of each document's chunks
                chunk_ends = np.array([e for c in own for e in c], np.int64)
                places = np.concatenate([[0], chunk_ends + np.repeat(begins, np.diff(first))]) * width
                data = all_ids.astype(kind).tobytes()
                leaves = [digest(data[a:z]) for a, z in zip(places[:-1].tolist(), places[1:].tolist())]
                payloads = pa.Array.from_buffers(pa.binary(), len(leaves), [None, pa.py_buffer(places.astype(np.int32)), pa.py_buffer(data)])
                lists = pa.array(first, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).slice(lo, hi - lo) for i in range(2)],
                        pa.array(sizes, pa.int64()),
                        pa.array([recipe_root(i, n, e, leaves[a:z]) for i, n, e, a, z in zip(b.column(1).slice(lo, hi - lo).to_pylist(), sizes.tolist(), own, first.tolist(), first[1:].tolist())], pa.binary()),
                        *[pa.ListArray.from_arrays(lists, v) for v in (pa.array(leaves, pa.binary()), pa.array(chunk_ends), payloads)],
                    ],
                    schema=_STAGED,
                )

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _STAGED_SPARK)


def _running(batches):
    """Adds the number of ids before each document within this task's part."""
    total = 0
    for b in batches:
        n = b.column("n_tokens").to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield b.append_column("start_in_part", pa.array(before, pa.int64()))


def write(docs: DataFrame, tokenizer: str, store: Scratch, end_id: int = END_ID, width: int = 2) -> Scratch:
    """Encode every whole text and write the store.  width: bytes of an id in the files; 2 needs a vocabulary of at most 65536."""
    staged = store.table(stage(docs, tokenizer, end_id, width), "staged")
    recipes = staged.drop("payloads").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("uid")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "uid")
    recipes = recipes.withColumn("part", F.spark_partition_id())
    recipes = store.table(recipes.mapInArrow(_running, T.StructType([*recipes.schema.fields, T.StructField("start_in_part", T.LongType())])), "recipes")
    store.table(_sealed(store.table(_parts(recipes), "parts")), "manifest")
    chunk = F.explode(F.arrays_zip("digests", "payloads")).alias("c")
    # The digest decides the payload, so a distinct over both keeps one of each and combines before the shuffle.
    store.table(staged.select(chunk).select(F.col("c.digests").alias("digest"), F.col("c.payloads").alias("payload")).distinct(), "chunks")
    store.drop("staged")
    return store


def _parts(recipes: DataFrame) -> DataFrame:
    """part, n, docs, seal, total: each part's ids, documents and two sums over the hashes of its recipes' roots and places."""
    h = F.xxhash64("uid", "root", "start_in_part", "part")
    return recipes.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"), F.bit_xor(h).alias("seal"), F.sum(F.xxhash64(h).cast("decimal(38,0)")).alias("total"))


def _sealed(parts: DataFrame) -> DataFrame:
    """The manifest over all parts, one row."""
    return parts.agg(F.count("*").alias("parts"), F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("part", "n", "docs", "seal", "total")), F.lit(0)).alias("seal"))


def verify(store: Scratch) -> None:
    """An error if the recipes are not those of the parts table, or this is not that of the manifest: something was lost, added or altered."""
    spark = store.spark
    recipes, parts, manifest = (spark.read.parquet(store.path(name)) for name in ("recipes", "parts", "manifest"))
    found = _parts(recipes.select("uid", "root", "start_in_part", "part", "n_tokens"))
    wrong = found.exceptAll(parts).unionAll(parts.exceptAll(found)).limit(3).collect()
    if wrong:
        raise ValueError(f"recipes and parts differ in parts {sorted({r['part'] for r in wrong})}")
    if _sealed(parts).collect() != manifest.collect():
        raise ValueError("the parts do not match the manifest")


def _recipes(store: Scratch) -> DataFrame:
    """The recipes of a verified set, each checked against its Merkle root, with the start of each document among all ids."""

    def checked(batches):
        for b in batches:
            for root, *rest in zip(*(b.column(k).to_pylist() for k in ("root", "doc_id", "n_tokens", "ends", "digests"))):
                if recipe_root(*rest) != root:
                    raise ValueError("a recipe does not match its Merkle root")
            yield b

    verify(store)
    spark = store.spark
    recipes = spark.read.parquet(store.path("recipes"))
    recipes = recipes.mapInArrow(checked, recipes.schema)
    parts = spark.read.parquet(store.path("parts"))  # a row per part
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return recipes.join(parts.select("part", F.coalesce(before, F.lit(0)).alias("before")), "part").withColumn("start", F.col("before") + F.col("start_in_part"))


def _present(column: str) -> Column:
    """A chunk's column after a left join; a chunk that is not there is an error."""
    return F.when(F.col("crc").isNull(), F.raise_error(F.concat(F.lit("a chunk is missing: "), F.hex("digest")))).otherwise(F.col(column))


def _chunks(store: Scratch, width: int, payload: bool) -> DataFrame:
    """The chunks, each checked against its address, as (digest, crc32 of its ids as 32-bit integers[, ids])."""
    kind = f"<u{width}"

    def run(batches):
        for b in batches:
            digests, payloads = b.column("digest").to_pylist(), b.column("payload").to_pylist()
            wide = []
            for d, p in zip(digests, payloads):
                if digest(p) != d:
                    raise ValueError("a chunk does not match its address")
                wide.append(np.frombuffer(p, kind).astype("<u4").tobytes())
            own = [pa.array(digests, pa.binary()), pa.array([zlib.crc32(w) for w in wide], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, pa.array(wide, pa.binary())] if payload else own, names=["digest", "crc", "ids"][: 2 + payload])

    return store.spark.read.parquet(store.path("chunks")).mapInArrow(run, "digest binary, crc long" + ", ids binary" * payload)


def read_ids(store: Scratch, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of every document, rebuilt from the files."""
    r = _recipes(store)
    uses = r.select("uid", F.posexplode("digests").alias("k", "digest")).join(_chunks(store, width, True), "digest", "left")
    ids = uses.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("k", _present("ids").alias("ids")))).alias("p"))
    joined = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return r.select("uid", "doc_id", "start", "n_tokens").join(ids.select("uid", joined.alias("ids")), "uid").drop("uid")


@functools.cache
def _shift_tables() -> np.ndarray:
    """[k, byte place, byte value]: the CRC-32 register after 2**k zero bytes (reflected polynomial 0xEDB88320)."""
    one = np.zeros(32, np.uint64)  # the operator of one zero byte, by bit
    for bit in range(32):
        r = 1 << bit
        for _ in range(8):
            r = (r >> 1) ^ (0xEDB88320 if r & 1 else 0)
        one[bit] = r
    tables, op = [], one
    values = np.arange(256)
    for _ in range(40):
        t = np.zeros((4, 256), np.uint64)
        for place in range(4):
            for bit in range(8):
                t[place] ^= np.where(values >> bit & 1, op[8 * place + bit], np.uint64(0)).astype(np.uint64)
        tables.append(t)
        op = _apply(t, op)
    return np.stack(tables)


def _apply(t: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return t[0][crc & np.uint64(255)] ^ t[1][crc >> np.uint64(8) & np.uint64(255)] ^ t[2][crc >> np.uint64(16) & np.uint64(255)] ^ t[3][crc >> np.uint64(24)]


def shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What a block's CRC-32 adds (by exclusive or) to that of a stream in which `zeros` bytes follow it."""
    crc, zeros = crc.astype(np.uint64), zeros.astype(np.int64)
    for k, t in enumerate(_shift_tables()):
        rows = np.flatnonzero(zeros >> k & 1)
        if len(rows):
            crc[rows] = _apply(t, crc[rows])
    return crc.astype(np.int64)


def digests(store: Scratch, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files.  Only checksums of chunks travel: CRC-32 is linear, so a
    document's is the exclusive or of its chunks' checksums, each moved by the number of bytes behind it."""

    @F.pandas_udf("long")
    def move(crc, zeros):
        import pandas as pd

        return pd.Series(shifted(crc.to_numpy(), zeros.to_numpy()))

    r = _recipes(store)
    uses = r.select("uid", "doc_id", "start", "n_tokens", F.explode(F.arrays_zip("digests", "ends")).alias("c"))
    uses = uses.select("uid", "doc_id", "start", "n_tokens", F.col("c.digests").alias("digest"), ((F.col("n_tokens") - F.col("c.ends")) * 4).alias("zeros"))
    uses = uses.join(_chunks(store, width, False), "digest", "left").withColumn("crc", _present("crc"))
    return uses.groupBy("uid", "doc_id", "start", "n_tokens").agg(F.bit_xor(move("crc", "zeros")).alias("ids_crc32")).drop("uid")


def query(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return digests(write(docs, tokenizer, Scratch(spark, "idstore")))
