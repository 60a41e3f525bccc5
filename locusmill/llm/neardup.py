"""Near-duplicates: ProbMinHash signatures, banding, exact verification, classes.

A text's five-word shingles weigh as often as they occur.  ProbMinHash: each shingle is a Poisson process whose
rate is its weight and whose arrivals fall on random registers; a register keeps the shingle that arrives first.  Arrivals are made
in rounds, and a shingle stops once its clock is beyond the text's last register.  Two texts agree in a register with
probability equal to their probability Jaccard similarity.

Texts of equal words are one node.  Nodes that agree in a whole band share a bucket.  A bucket of n
nodes is not spelled out as pairs: in each of ROUNDS rounds its members are compared with one leader; links are verified by exact
similarity, and components are formed.  A bucket of two members is done with the first round, others when they hold one component.  The rest
compare members across components in tiles of bounded size, a pair of tiles a task.  Members of a bucket that then
holds more than HOT are signed anew instead, with more registers in longer bands, which few pairs of low similarity share, and start again; after
the last level tiles take all.  So copies and near copies cost about one comparison each, the copies of a member in tiles are bounded, and
every pair that shares a bucket is compared unless it is in one component by then.

Missed links: a pair at similarity SIMILARITY shares no band of a level with probability 2e-6, 1e-6 and 7e-7 (LEVELS), and
its signatures agree in less than ESTIMATE of the registers, which spares the exact test, with probability 2e-11.

Nulls: a null text is empty; texts without words are copies of each other; a text of 1 to 4 words is one shingle; a null
id is kept and never a class id unless nothing else is there.  Repeated rows are copies.  An empty table gives no rows; other
columns are ignored (kept by keep_one())."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import components as stars
from .common import Scratch, chosen, hashed_words, mix, releasing, ship, shingles, slices

WORDS, SIMILARITY = 5, 0.8
#: Bands and registers in a band of each level.
LEVELS = ((25, 4), (75, 8), (200, 12))
REGISTERS = LEVELS[0][0] * LEVELS[0][1]
ESTIMATE = 0.5
#: Rounds of comparisons with a leader before the members themselves are compared, members of a bucket that goes to the next level if there are
#: more, and members of a tile.
ROUNDS, HOT, TILE = 2, 8192, 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_SIGNED = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("h", pa.int64()), ("bands", pa.list_(pa.int64())), ("mini", pa.binary()), ("shingles", pa.binary()), ("weights", pa.binary())])
_SIGNED_SPARK = "uid long, doc_id long, digest binary, h long, bands array<long>, mini binary, shingles binary, weights binary"


def probminhash(element: np.ndarray, weight: np.ndarray, doc: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """[docs, registers] uint32 signatures.  element, weight, doc: the distinct shingles of all texts, with their text's number."""
    first = np.full(docs * registers, np.inf)
    winner = np.zeros(docs * registers, np.uint32)
    mark = (mix(element) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    live = np.arange(len(element))
    clock = np.zeros(len(element))
    t = 0
    while len(live):
        t += 1
        step = np.uint64(t * int(_GOLDEN) % (1 << 64))
        r = mix(element[live] + step)
        clock[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weight[live]
        register = doc[live] * registers + (mix(r) % np.uint64(registers)).astype(np.int64)
        x = clock[live]
        won = x < first[register]
        np.minimum.at(first, register[won], x[won])
        won &= x == first[register]
        winner[register[won]] = mark[live[won]]
        which = np.unique(doc[live])
        last = np.zeros(docs)
        last[which] = first.reshape(docs, registers)[which].max(1)
        live = live[x < last[doc[live]]]
    return winner.reshape(docs, registers)


def band_keys(sig: np.ndarray, level: int = 0) -> np.ndarray:
    """[docs, bands] int64: a hash of each band's registers and number."""
    bands, rows = LEVELS[level]
    parts = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    key = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1 + 1000 * level), (len(sig), 1))
    for k in range(rows):
        key = mix(key * _GOLDEN + parts[:, :, k])
    return key.view(np.int64)


def sign(rows: DataFrame) -> DataFrame:
    """For every row of (uid, doc_id, text): uid, doc_id, digest (of the text's words) and its first half h, bands, mini (a byte of each register),
    shingles (sorted 32-bit hashes) and weights (empty: all 1)."""
    ship(rows.sparkSession)

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in slices(texts):
                n = hi - lo
                every, counts = hashed_words(texts[lo:hi])
                words = np.split(every, np.cumsum(counts)[:-1])
                digests = [xxhash.xxh3_128_digest(w.tobytes()) for w in words]
                parts = [shingles(w, WORDS) & np.uint64(0xFFFFFFFF) for w in words]
                sizes = np.array([len(p) for p in parts])
                # One sort finds the distinct shingles of all texts; the text's number is in the upper half.
                coded = np.concatenate(parts) | np.repeat(np.arange(n, dtype=np.uint64) << np.uint64(32), sizes)
                coded, counts = np.unique(coded, return_counts=True)
                doc = (coded >> np.uint64(32)).astype(np.int64)
                element = coded & np.uint64(0xFFFFFFFF)
                sig = probminhash(element, counts.astype(float), doc, n)
                ends = np.searchsorted(doc, np.arange(n + 1))
                small, many = element.astype("<u4"), counts.astype("<u4")
                sets = [small[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
                weights = [b"" if (many[ends[i] : ends[i + 1]] == 1).all() else many[ends[i] : ends[i + 1]].tobytes() for i in range(n)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * LEVELS[0][0], pa.int32()), pa.array(band_keys(sig).ravel()))
                short = [r.tobytes() for r in sig.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[b.column(i).slice(lo, n) for i in range(2)],
                        pa.array(digests, pa.binary()),
                        pa.array(np.frombuffer(b"".join(digests), "<i8")[::2]),
                        lists,
                        *[pa.array(c, pa.binary()) for c in (short, sets, weights)],
                    ],
                    schema=_SIGNED,
                )

    return rows.select(F.col("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), _SIGNED_SPARK)


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Exact: the sum over common elements i of 1 / sum over all j of max(x_j / x_i, y_j / y_i).  a, b: distinct elements."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    every = np.union1d(a, b)
    u, v = np.zeros(len(every)), np.zeros(len(every))
    u[np.searchsorted(every, a)] = x
    v[np.searchsorted(every, b)] = y
    common = (u > 0) & (v > 0)
    if (u[common] == v[common]).all():  # one ratio: the plain weighted form
        return float(u[common].sum() / np.maximum(u, v).sum())
    with np.errstate(divide="ignore"):
        ratio = v / u
    order = np.argsort(ratio, kind="stable")
    u, v, ratio, common = u[order], v[order], ratio[order], common[order]
    upto = np.searchsorted(ratio, ratio[common], side="right")
    su, sv = np.concatenate([[0], np.cumsum(u)]), np.concatenate([[0], np.cumsum(v)])
    return float((1 / (su[upto] / u[common] + (sv[-1] - sv[upto]) / v[common])).sum())


def verify(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """comp_a, comp_b of those pairs (a, b, comp_a, comp_b) that are links.  Signatures, cut to bytes, rule most others out before shingles move."""

    def near(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(-1, REGISTERS) for c in ("mini_a", "mini_b"))
            yield t.select(["a", "b", "comp_a", "comp_b"]).filter(pa.array((x == y).mean(1) >= ESTIMATE))

    def exact(batches):
        def weights(raw, n):
            return np.frombuffer(raw, "<u4").astype(float) if raw else np.ones(n)

        for t in batches:
            keep = []
            for sa, wa, sb, wb in zip(*(t.column(c).to_pylist() for c in ("shingles_a", "weights_a", "shingles_b", "weights_b"))):
                x, y = np.frombuffer(sa, "<u4"), np.frombuffer(sb, "<u4")
                keep.append(probability_jaccard(x, weights(wa, len(x)), y, weights(wb, len(y))) >= SIMILARITY)
            yield t.select(["comp_a", "comp_b"]).filter(pa.array(keep, pa.bool_()))

    def with_nodes(p: DataFrame, *columns: str) -> DataFrame:
        for side in "ab":
            p = p.join(nodes.select(F.col("digest").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)
        return p

    close = with_nodes(pairs, "mini").mapInArrow(releasing(near), "a binary, b binary, comp_a binary, comp_b binary")
    return with_nodes(close, "shingles", "weights").mapInArrow(releasing(exact), "comp_a binary, comp_b binary")


def _united(labels: DataFrame | None, links: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """node, comp after further links (comp_a, comp_b) between components; a node without a label is a component of its own."""
    if links.isEmpty():
        return labels
    new = stars.components(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), scratch, name)
    if labels is not None:
        moved = labels.join(new.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
        new = moved.unionByName(new).distinct()  # a centre is a node of either
    return scratch.table(new, f"{name}-labels")


def _open(members: DataFrame, labels: DataFrame | None, led: bool) -> DataFrame:
    """key, digest, comp of the members of buckets that hold several components, and, when led by one of them, more than two members."""
    m = members.withColumn("comp", F.col("digest")) if labels is None else members.join(labels.select(F.col("node").alias("digest"), F.col("comp").alias("found")), "digest", "left").select("key", "digest", F.coalesce("found", "digest").alias("comp"))
    h = F.xxhash64("comp")
    several = m.groupBy("key").agg(F.min(h).alias("lo"), F.max(h).alias("hi"), F.count("*").alias("n")).where((F.col("lo") != F.col("hi")) & (F.col("n") > 1 + int(led)))
    return m.join(several.select("key"), "key")


def _with_leader(rows: DataFrame, seed: int) -> DataFrame:
    """a, b, comp_a, comp_b: every member with its bucket's leader, if that is of another component."""
    order = F.struct(F.xxhash64(F.lit(seed), "digest").alias("h"), F.struct("digest", "comp").alias("m"))
    leader = rows.groupBy("key").agg(F.min(order).alias("l")).select("key", F.col("l.m.digest").alias("b"), F.col("l.m.comp").alias("comp_b"))
    return rows.join(leader, "key").where(F.col("comp") != F.col("comp_b")).select(F.col("digest").alias("a"), "b", F.col("comp").alias("comp_a"), "comp_b").distinct()


def _similar(a: np.ndarray, x: np.ndarray | None, others: list[tuple[np.ndarray, np.ndarray | None]]) -> np.ndarray:
    """Which of the others (sorted shingles, weights or None for all 1) are linked to a."""
    out = np.zeros(len(others), bool)
    plain = [k for k, (b, y) in enumerate(others) if x is None and y is None and len(a) and len(b)]
    if plain:
        sizes = np.array([len(others[k][0]) for k in plain])
        every = np.concatenate([others[k][0] for k in plain])
        common = np.add.reduceat(a[np.minimum(np.searchsorted(a, every), len(a) - 1)] == every, np.cumsum(sizes) - sizes, dtype=np.int64)
        out[plain] = common / (len(a) + sizes - common) >= SIMILARITY
    for k in set(range(len(others))) - set(plain):
        b, y = others[k]
        out[k] = probability_jaccard(a, np.ones(len(a)) if x is None else x, b, np.ones(len(b)) if y is None else y) >= SIMILARITY
    return out


def _tiled(rows: DataFrame) -> DataFrame:
    """key, digest, comp, tile, i, j: the members of buckets for each pair of tiles (i, j) that they are compared in."""
    sizes = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    own, rest = (F.ceil(n / TILE).cast("int") for n in (F.col("top.n"), F.col("all") - F.col("top.n")))
    rows = rows.join(sizes.select("key", F.col("top.comp").alias("top"), own.alias("own"), rest.alias("rest")), "key")
    tile = F.when(F.col("comp") == F.col("top"), F.col("rest") + F.pmod(F.xxhash64("digest"), F.col("own"))).otherwise(F.pmod(F.xxhash64("digest"), F.col("rest")))
    others = F.col("rest") + F.when(F.col("comp") == F.col("top"), 0).otherwise(F.col("own"))
    rows = rows.select("key", "digest", "comp", tile.cast("int").alias("tile"), F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    return rows.select("key", "digest", "comp", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))


class _Pairs:
    """The members of a pair of tiles, and for each which later ones it is to be compared with."""

    def __init__(self, key: tuple, table: pa.Table, level: int):
        self.names = table.column("comp").to_pylist()
        self.comp = np.unique(np.array([c.hex() for c in self.names]), return_inverse=True)[1]
        self.tile = np.array(table.column("tile").to_pylist())
        self.same_tile = key[1].as_py() == key[2].as_py()
        self.mini = np.frombuffer(b"".join(table.column("mini").to_pylist()), np.uint8).reshape(-1, REGISTERS)
        self.keys = np.array(table.column("bands").to_pylist(), np.int64) if level == 0 else None
        if level == 0:
            self.own = int(np.flatnonzero((self.keys == key[0].as_py()).all(0))[0])

    def after(self, r: int) -> np.ndarray:
        at = r + 1 + np.flatnonzero((self.comp[r + 1 :] != self.comp[r]) & (self.same_tile | (self.tile[r + 1 :] != self.tile[r])))
        at = at[(self.mini[at] == self.mini[r]).mean(1) >= ESTIMATE]
        return at if self.keys is None else at[(self.keys[at] == self.keys[r]).argmax(1) == self.own]


def _candidates(rows: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """The rows of _tiled() that have another to be compared with exactly, by signature: where texts share a bucket by chance, few."""

    def run(key, table):
        pairs = _Pairs(key, table, level)
        met = np.zeros(table.num_rows, bool)
        for r in range(table.num_rows):
            at = pairs.after(r)
            met[at] = True
            met[r] |= len(at) > 0
        return table.select(["key", "digest", "comp", "tile", "i", "j"]).filter(pa.array(met))

    return rows.join(nodes.select("digest", "bands", "mini"), "digest").groupBy("key", "i", "j").applyInArrow(run, "key long, digest binary, comp binary, tile int, i int, j int")


def _across(rows: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """comp_a, comp_b: links between different components, as many as unite what is linked within a bucket.

    Members are compared across components, by signature and then exactly, on the first level only in the first bucket that a pair shares; a pair
    whose components have met meanwhile is passed over, so a bucket gives fewer links than members.  Members are cut into tiles of about
    TILE, and each pair of tiles is a group of its own.  The largest component of a bucket has tiles apart, which meet the others' tiles and never
    each other; a bucket of one large component and few strays therefore costs in proportion to its members.  Shingles move only for members that
    signatures do not rule out."""
    rows = _candidates(_tiled(rows), nodes, level).join(nodes.select("digest", "bands", "mini", "shingles", "weights"), "digest")

    def run(key, table):
        pairs = _Pairs(key, table, level)
        comp, names = pairs.comp, pairs.names
        sets = [(np.frombuffer(s, "<u4"), np.frombuffer(w, "<u4").astype(float) if w else None) for s, w in zip(table.column("shingles").to_pylist(), table.column("weights").to_pylist())]
        a, b = [], []
        for r in range(len(names)):
            at = pairs.after(r)
            for s in at[_similar(*sets[r], [sets[k] for k in at])].tolist():
                if comp[s] != comp[r]:
                    comp[comp == comp[s]] = comp[r]
                    a.append(names[r])
                    b.append(names[s])
        return pa.table({"comp_a": pa.array(a, pa.binary()), "comp_b": pa.array(b, pa.binary())})

    return rows.groupBy("key", "i", "j").applyInArrow(run, "comp_a binary, comp_b binary")


def _signed_again(nodes: DataFrame, level: int) -> DataFrame:
    """digest, key: the buckets of a level with more registers, made from the shingles."""
    bands, rows = LEVELS[level]
    salt = np.uint64(0xA24BAED4963EE407 * level % (1 << 64))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [np.frombuffer(x, "<u4") for x in part.column("shingles").to_pylist()]
                weights = [np.frombuffer(w, "<u4").astype(float) if w else np.ones(len(s)) for w, s in zip(part.column("weights").to_pylist(), sets)]
                doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                sig = probminhash(mix(np.concatenate(sets).astype(np.uint64) ^ salt), np.concatenate(weights), doc, len(sets), bands * rows)
                yield pa.RecordBatch.from_arrays([part.column("digest").take(pa.array(np.repeat(np.arange(len(sets)), bands))), pa.array(band_keys(sig, level).ravel())], names=["digest", "key"])

    return nodes.select("digest", "shingles", "weights").mapInArrow(releasing(run), "digest binary, key long")


def _buckets(rows: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """key, digest of the members of buckets with several nodes.  rows: digest, key and h, a half of the digest, for sums without sorting: two
    nodes of one bucket and one h, which would be overlooked, occur once in 2**64 pairs."""
    shared = rows.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    return scratch.table(rows.select("key", "digest").join(shared, "key").distinct(), name)


def _settle(members: DataFrame, labels: DataFrame | None, nodes: DataFrame, scratch: Scratch, level: int = 0) -> DataFrame | None:
    """node, comp after all comparisons within buckets."""
    name = f"level{level}"
    for k in range(ROUNDS):
        rows = scratch.table(_open(members, labels, k > 0), f"{name}-open{k}")
        if rows.isEmpty():
            return labels
        labels = _united(labels, scratch.table(verify(_with_leader(rows, k), nodes), f"{name}-links{k}"), scratch, f"{name}-comp{k}")
        members = rows.select("key", "digest")
    rows = scratch.table(_open(members, labels, ROUNDS > 0), f"{name}-open")
    if rows.isEmpty():
        return labels
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key")
    hot = scratch.table(hot, f"{name}-hot") if level + 1 < len(LEVELS) else None
    again = hot is not None and not hot.isEmpty()
    labels = _united(labels, scratch.table(_across(rows.join(hot, "key", "left_anti") if again else rows, nodes, level), f"{name}-links"), scratch, f"{name}-comp")
    if not again:
        return labels
    few = nodes.join(rows.join(hot, "key", "left_semi").select("digest").distinct(), "digest", "left_semi")
    wider = scratch.table(_signed_again(few, level + 1), f"{name}-again").withColumn("h", F.xxhash64("digest"))
    return _settle(_buckets(wider, f"{name}-members", scratch), labels, nodes, scratch, level + 1)


def link(signed: DataFrame, scratch: Scratch) -> DataFrame | None:
    """node, comp for every node with a link; None if there is none.  signed: sign(), written."""
    members = _buckets(signed.select("digest", "h", F.explode("bands").alias("key")), "members", scratch)
    if members.isEmpty():
        return None
    involved = members.select("digest").distinct()
    one = signed.groupBy("digest").agg(F.min("uid").alias("uid")).join(involved, "digest", "left_semi").select("uid")  # a row of each text
    nodes = scratch.table(chosen(signed.select("uid", "digest", "bands", "mini", "shingles", "weights"), one, scratch, "one").drop("uid"), "nodes")
    return _settle(members, None, nodes, scratch)


def _classes(signed: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """digest, comp of every text; and comp, class_id, uid of every class, whose row `uid` stands for it: the least doc_id, of equal ones the first."""
    labels = link(signed, scratch)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    texts = signed.groupBy("digest").agg(F.min(order).alias("first"))
    if labels is None:
        texts = texts.withColumn("comp", F.col("digest"))
    else:
        texts = texts.join(labels.select(F.col("node").alias("digest"), "comp"), "digest", "left").select("digest", "first", F.coalesce("comp", "digest").alias("comp"))
    texts = scratch.table(texts, "texts")
    best = texts.groupBy("comp").agg(F.min("first").alias("m")).select("comp", F.col("m.doc_id").alias("class_id"), F.col("m.uid").alias("uid"))
    best = scratch.table(best, "best")
    for name in scratch.names - {"signed", "texts", "best", "rows"}:
        scratch.drop(name)
    return texts.select("digest", "comp"), best


def classes(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, digest and class_id (the least doc_id of the class) for every row."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    signed = scratch.table(sign(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")), "signed")
    texts, best = _classes(signed, scratch)
    # Written, so that Spark can split the rows of a frequent text.
    by_text = scratch.table(texts.join(best.select("comp", "class_id"), "comp").select("digest", "class_id"), "classes")
    return signed.select("doc_id", "digest").join(by_text, "digest").select("doc_id", "digest", "class_id")


def keep_one(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """docs, all columns, with one row of each class: the least doc_id, of equal ones the first."""
    scratch = scratch or Scratch(docs.sparkSession, "neardup")
    # The rows are written with their numbers, so the choice holds however often a task is repeated.
    rows = scratch.table(docs.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("row")), "rows")
    signed = scratch.table(sign(rows.select("uid", "row.doc_id", "row.text")), "signed")
    best = _classes(signed, scratch)[1]
    scratch.drop("signed", "texts")
    return chosen(rows, best.select("uid"), scratch, "kept").select("row.*")


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return classes(docs).select("doc_id", "class_id")
