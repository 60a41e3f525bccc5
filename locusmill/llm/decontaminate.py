"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

For each size of a benchmark item (in words) a window of as many words slides over every document.  A window's
fingerprint is the SimHash, of BITS bits, of its five-word shingles, each weighing as often as it occurs; running sums of the bits' votes
give all windows' fingerprints at once.  Fingerprints are cut into BLOCKS blocks.  If two differ in at most RADIUS bits, some block differs in
at most RADIUS // BLOCKS of them, so the items whose block lies that near to the window's are all there are within the radius; of
unlike items one in six passes a block and none the radius.  What is within RADIUS counts if the weighted Jaccard similarity of the shingles is
at least SIMILARITY.

Since that similarity needs a common shingle, only windows that hold one of the benchmark's shingles get a fingerprint; others
could never pass.  At a similarity of just 0.8 the expected distance is 39 bits of 256 and RADIUS four standard deviations more, so about one
such window in 50 000 is missed, and the next window over it rarely is.

The benchmark is read in blocks of at most ITEMS items and CHARS characters (or one longer item), and each block passes over all documents.
A block's index is arrays of about 30 bytes a word, so it holds some 100 MB at most.

Words are lower-cased runs of \\w.  A document shorter than an item is one window; a text or item of fewer than five words is one
shingle.  A null or empty text, and an item without words, match nothing.  Equal items each match; a null id is kept; repeated rows are
judged alike; empty tables give no rows; other columns are ignored (kept by clean())."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_words, mix, release, ship, shingles, slices, word_hashes

WORDS, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 256, 16, 63
#: Items and characters of one block of the benchmark; their index is what a task holds.
ITEMS, CHARS = 20_000, 16_000_000
#: Window-item pairs that are compared at once.
PAIRS = 1 << 18

_HITS = "array<struct<item_id: bigint, word: int, similarity: double>>"


def simhash(votes: np.ndarray) -> np.ndarray:
    """[n, BITS] sums of +-1 votes -> [n, BLOCKS] fingerprints of 16-bit blocks."""
    return np.packbits(votes >= 0, axis=1, bitorder="little").view(np.uint16)


def _votes(sh: np.ndarray) -> np.ndarray:
    words = np.stack([mix(sh ^ np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64))) for k in range(BITS // 64)], 1)
    return np.unpackbits(words.view(np.uint8).reshape(len(sh), -1), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def _near_values(radius: int) -> np.ndarray:
    """All 16-bit values of at most `radius` bits."""
    values = np.arange(1 << 16, dtype=np.uint32)
    return values[np.bitwise_count(values) <= radius]


class Sized:
    """The items of one size: their numbers, fingerprints, and each block's values in order."""

    def __init__(self, items: np.ndarray, prints: np.ndarray):
        self.items, self.prints = items, prints
        self.order = np.argsort(prints, axis=0, kind="stable")
        self.values = np.take_along_axis(prints, self.order, 0)

    def near(self, window: np.ndarray, probe: bool | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) pairs within RADIUS of the windows' fingerprints.  A block is looked up at every near value (probe) where the items are
        many, else compared with all items' blocks; both find the items with a block that is near enough."""
        reach = RADIUS // BLOCKS
        if probe is None:
            probe = len(self.items) > 4096
        rows, found = [], []
        if probe:
            masks = _near_values(reach)
            for r, w in enumerate(window):
                hit = []
                for k in range(BLOCKS):
                    keys = np.sort(masks ^ np.uint32(w[k])).astype(np.uint16)
                    lo, hi = (np.searchsorted(self.values[:, k], keys, side=s) for s in ("left", "right"))
                    some = np.flatnonzero(hi > lo)
                    hit += [self.order[a:z, k] for a, z in zip(lo[some], hi[some])]
                at = np.unique(np.concatenate(hit)) if hit else np.empty(0, np.int64)
                at = at[np.bitwise_count(self.prints[at] ^ w).sum(1, dtype=np.int32) <= RADIUS]
                rows.append(np.full(len(at), r))
                found.append(at)
        else:
            step = max(1, PAIRS // max(len(self.items), 1))
            for lo in range(0, len(window), step):
                apart = np.bitwise_count(window[lo : lo + step, None, :] ^ self.prints[None, :, :])
                r, at = np.nonzero(apart.min(2) <= reach)
                close = apart[r, at].sum(1, dtype=np.int32) <= RADIUS
                rows.append(r[close] + lo)
                found.append(at[close])
        return (np.concatenate(rows), self.items[np.concatenate(found)]) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


class Index:
    """The items of one block of the benchmark."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids: list[int | None] = []
        sets, many, sizes, prints = [], [], [], []
        for item_id, text in items:
            w = word_hashes(text)
            if not len(w):
                continue
            sh = shingles(w, WORDS)
            self.ids.append(item_id)
            each, counts = np.unique(sh, return_counts=True)
            sets.append(each)
            many.append(counts.astype(np.int32))
            sizes.append(len(w))
            prints.append(simhash(_votes(sh).sum(0, keepdims=True, dtype=np.int32))[0])
        self.sizes = np.array(sizes, np.int64)
        self.bounds = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
        self.shingles = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        self.counts = np.concatenate(many) if many else np.empty(0, np.int32)
        held = np.repeat(self.sizes, np.diff(self.bounds)).astype(np.int32)
        order = np.lexsort((held, self.shingles))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.shingles[order][1:] != self.shingles[order][:-1]) | (held[order][1:] != held[order][:-1])
        pairs = self.shingles[order][fresh]
        #: Distinct shingles, and the sizes of the items that hold each.
        self.known, first = np.unique(pairs, return_index=True)
        self.size_of, self.size_bounds = held[order][fresh], np.concatenate([first, [len(pairs)]])
        self.marks = np.zeros(1 << 20, bool)
        self.marks[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.by_size = {int(s): Sized(at := np.flatnonzero(self.sizes == s), np.stack([prints[i] for i in at])) for s in np.unique(self.sizes)}
        self.short = sorted(s for s in self.by_size if s < WORDS)

    def __len__(self) -> int:
        return len(self.ids)

    def hits(self, sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known shingles, and which they are."""
        at = np.flatnonzero(self.marks[(sh & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if not len(at):
            return at, at
        where = np.minimum(np.searchsorted(self.known, sh[at]), len(self.known) - 1)
        same = self.known[where] == sh[at]
        return at[same], where[same]

    def match(self, words: np.ndarray) -> list[tuple[int | None, int, float]]:
        """(item id, first word, similarity) of the best window for each item that the text holds."""
        best: dict[int, tuple[float, int]] = {}
        last = len(words)
        for k in (*[s for s in self.short if s < last], WORDS):
            sh = shingles(words, k)  # a short item is one shingle of its own size
            at, which = self.hits(sh)
            if not len(at):
                continue
            n = self.size_bounds[which + 1] - self.size_bounds[which]
            place = np.repeat(at, n)
            size_of = self.size_of[np.repeat(self.size_bounds[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            for size in np.unique(size_of).tolist():
                if k != WORDS and size != k:
                    continue
                p, reach = place[size_of == size], max(size - k, 0)
                lo, hi = np.maximum(p - reach, 0), np.maximum(np.minimum(p, last - size), 0)
                covered = np.zeros(len(sh) + 1, np.int32)  # windows that begin between lo and hi of any hit
                np.add.at(covered, lo[lo <= hi], 1)
                np.add.at(covered, np.minimum(hi + 1, len(sh))[lo <= hi], -1)
                width = min(max(size - k + 1, 1), len(sh))
                starts = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                starts = starts[starts + width <= len(sh)]
                for at0 in range(0, len(starts), 4096):
                    self._some(sh, starts[at0 : at0 + 4096], width, self.by_size[size], best)
        return [(self.ids[n], w, s) for n, (s, w) in sorted(best.items())]

    def _some(self, sh: np.ndarray, starts: np.ndarray, width: int, sized: Sized, best: dict) -> None:
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > width) + 1):  # runs of overlapping windows
            a, z = int(run[0]), int(run[-1]) + width
            total = np.zeros((z - a + 1, BITS), np.int32)
            np.cumsum(_votes(sh[a:z]), axis=0, out=total[1:])
            prints = simhash(total[run - a + width] - total[run - a])
            windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for r, n in zip(*(x.tolist() for x in sized.near(prints))):
                start = int(run[r])
                if r not in windows:
                    windows[r] = np.unique(sh[start : start + width], return_counts=True)
                s = self.similarity(*windows[r], n)
                if s >= SIMILARITY and (n not in best or s > best[n][0]):
                    best[n] = (s, start)

    def similarity(self, each: np.ndarray, counts: np.ndarray, n: int) -> float:
        """Weighted Jaccard similarity of an item and distinct shingles with their counts."""
        own = slice(self.bounds[n], self.bounds[n + 1])
        mine, many = self.shingles[own], self.counts[own]
        at = np.minimum(np.searchsorted(mine, each), len(mine) - 1)
        both = int(np.minimum(many[at], counts)[mine[at] == each].sum())
        return both / (int(counts.sum()) + int(many.sum()) - both)


def indexes(benchmark: DataFrame):
    """The benchmark, block by block; the driver holds one block at a time."""
    block: list[tuple] = []
    chars = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        size = len(r["text"] or "")
        if block and (len(block) == ITEMS or chars + size > CHARS):
            yield Index(block)
            block, chars = [], 0
        block.append((r["item_id"], r["text"]))
        chars += size
    if block:
        yield Index(block)


def hits(spark: SparkSession, index: Index) -> Column:
    """For each text the items of the index that it holds."""
    ship(spark)
    held = spark.sparkContext.broadcast(index)  # bounded by ITEMS and CHARS

    @F.pandas_udf(_HITS)
    def run(text: pd.Series) -> pd.Series:
        own, texts, out = held.value, text.tolist(), []
        for lo, hi in slices(texts):
            every, counts = hashed_words(texts[lo:hi])
            out += [[{"item_id": i, "word": w, "similarity": s} for i, w, s in own.match(words)] for words in np.split(every, np.cumsum(counts)[:-1])]
        release()
        return pd.Series(out, dtype=object)

    return run.asNondeterministic()(F.col("text").cast("string"))  # else a filter on it would have it computed again


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, word (where the best window begins), similarity: every item in every document."""
    spark, out = docs.sparkSession, None
    for index in indexes(benchmark):
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), hits(spark, index).alias("hit")).where(F.size("hit") > 0)
        rows = rows.select("doc_id", F.explode("hit").alias("hit")).select("doc_id", "hit.item_id", "hit.word", "hit.similarity")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "doc_id long, item_id long, word int, similarity double")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that hold no item."""
    for index in indexes(benchmark):
        docs = docs.select(F.struct("*").alias("row"), hits(docs.sparkSession, index).alias("hit")).where(F.size("hit") == 0).select("row.*")
    return docs


def query(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
