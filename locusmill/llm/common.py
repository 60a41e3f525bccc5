"""Shared plumbing: batches of text, memory, hashing."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import BROADCAST_ROWS, Scratch, beside, ship  # noqa: F401 - the operators take them from here

#: Characters of text that one step of a Python operator handles at once; bounds the arrays it builds.
SLICE_CHARS = 250_000


def release() -> None:
    """Give freed memory back to the system; an idle Python worker would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def releasing(run):
    """The generator function run, with release() at its end."""

    def each(batches):
        yield from run(batches)
        release()

    return each


def slices(texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts hold at most `limit` characters (or one text)."""
    begin = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(texts):
        yield begin, len(texts)


def chosen(rows: DataFrame, uids: DataFrame, scratch: Scratch, name: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The rows whose `uid`, a number of 0 or more, is among uids.  The numbers go into bitmaps of 32,768 consecutive ones each, 4 KB.  Up to
    `limit` bitmaps, 80 MB for some 600 million numbers, these are broadcast and no row moves; beyond, rows are shuffled by uid.  Both give the same
    rows.  Repeated uids count once; none give no rows."""
    n = F.col("uid") + 1  # numbers above 0 fill a bitmap from its first bit
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("__bits")
    maps = scratch.table(uids.groupBy(F.bitmap_bucket_number(n).alias("__block")).agg(bits), name)
    if maps.limit(limit + 1).count() > limit:
        return rows.join(uids.select("uid"), "uid", "left_semi")
    place = F.bitmap_bit_position(n)
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(maps), F.bitmap_bucket_number(n) == F.col("__block"))
    return found.where(F.getbit(byte, (place % 8).cast("int")) == 1).select(*rows.columns)


#: Odd multiplier of the positional word hash, its inverse modulo 2**64, and a 64-bit value for each byte.
_R = 0xD1342543DE82EF95
_R_INVERSE = pow(_R, -1, 1 << 64)
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that one step of run_hashes handles.
_BLOCK = 1 << 20


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(_BLOCK, np.uint64), np.ones(_BLOCK, np.uint64)
    up[1:], down[1:] = _R, _R_INVERSE
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def run_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begins, ends, hashes) of the maximal runs of bytes for which the table `inside` is true.

    The hash of a run is a polynomial in its bytes' values, taken as a difference of running sums, so all runs come from a few
    array operations.  Long data goes block by block, cut outside of runs."""
    begins, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        if stop < len(data):
            outside = np.flatnonzero(~inside[data[at:stop]])
            if len(outside):
                stop = at + int(outside[-1]) + 1
        b, e, h = _block_hashes(data[at:stop], inside) if stop - at < _BLOCK or stop == len(data) or not inside[data[stop]] else (None, None, None)
        if b is None:  # one run fills the block: take it whole, with Horner's rule over blocks
            rest = np.flatnonzero(~inside[data[stop:]])
            stop = stop + int(rest[0]) if len(rest) else len(data)
            b, e, h = np.array([0]), np.array([stop - at]), np.array([xxhash.xxh3_64_intdigest(data[at:stop].tobytes())], np.uint64)
        begins.append(b + at)
        ends.append(e + at)
        hashes.append(h)
        at = stop
    if not begins:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(begins), np.concatenate(ends), np.concatenate(hashes)


def _block_hashes(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _powers()
    n = len(data)
    held = np.zeros(n + 2, np.int8)
    held[1:-1] = inside[data]
    edge = np.diff(held)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[data] * up[:n], out=total[1:])
    return begin, end, mix((total[end] - total[begin]) * down[np.minimum(begin, n - 1)])


_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
_OTHER = re.compile(r"[^\w\x00-\x7f]")


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased runs of \\w of whole texts, one text after the other, and each text's number of words."""
    raw = []
    for t in texts:
        t = (t or "").lower()
        raw.append((t if t.isascii() else _OTHER.sub(" ", t)).encode("utf-8", "surrogatepass"))
    sizes = np.array([len(r) + 1 for r in raw], np.int64)
    begins, _, hashes = run_hashes(np.frombuffer(b"\n".join(raw), np.uint8), _WORD_BYTES)
    return hashes, np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(sizes)])))


def word_hashes(text: str | None) -> np.ndarray:
    return hashed_words([text])[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the murmur finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hash of every run of k words; a text with 1 to k-1 words is one shorter shingle, an empty one has none."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j]
    return mix(out + np.uint64(k))
