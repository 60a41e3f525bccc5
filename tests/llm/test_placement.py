"""Sharding, the as-of join and the two-tree centroids against plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("locusmill.llm")
from locusmill.llm import asof, cluster, sharding  # noqa: E402
from locusmill.llm.common import Scratch  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, key string, uid string, version string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "own", "own", "own", "own", "own") for i, t, s in rows], DOCS)


def plain_fold(loads, shards, own):
    held, picks, total = [0] * shards, dict(own), sum(loads.values())
    for slot in sorted(own, key=lambda s: (-loads.get(s, 0), s)):
        b = loads.get(slot, 0)
        stays = own[slot] < shards and (b == 0 or (held[own[slot]] + b) * shards <= total)
        picks[slot] = own[slot] if stays else held.index(min(held))
        held[picks[slot]] += b
    return picks


def test_sharding_is_the_plain_fold(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é😀", "x" * rng.randint(1, 4000)]), "s") for i in range(700)]
    rows += [(None, "nothing", "s"), (None, "else", "s"), *[(5, "hot" * 40, "s")] * 300]
    got = sharding.query(spark, documents(spark, rows).repartition(7), 6).collect()

    def slot(i, t):
        name = str(i) if i is not None else "null:" + hashlib.sha256((t or "").encode()).hexdigest()
        return int(hashlib.sha256(name.encode()).hexdigest()[:8], 16) % sharding.SLOTS

    loads = {}
    for i, t, _ in rows:
        loads[slot(i, t)] = loads.get(slot(i, t), 0) + len((t or "").encode()) + 1
    picks = plain_fold(loads, 6, {s: s * 6 // sharding.SLOTS for s in range(sharding.SLOTS)})
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), picks[slot(i, t)]) for i, t, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"], r["shard"]) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"]))
    for places in by.values():
        assert [p for p, _ in sorted(places)] == list(range(len(places))) and [i for _, i in sorted(places)] == sorted(i for _, i in places)
    sizes = [sum(r["size"] for r in got if r["shard"] == s) for s in range(6)]
    assert max(sizes) - min(sizes) < 0.02 * sum(sizes) / 6 or max(sizes) == loads[slot(5, "")]


def test_slot_maps_are_versions(spark, tmp_path):
    docs = documents(spark, [(i, "word " * (i % 50), "s") for i in range(4000)])
    scratch = Scratch(spark, "test")
    rows = sharding.measured(docs, "doc_id", "text", scratch)
    m = sharding.SlotMap(scratch)
    first, even = m.create(8), m.rebalance(sharding.loads(rows), 8)
    grown = m.rebalance(sharding.loads(rows), 9)
    held = sharding.placed(rows, m.read(grown)).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert len(held) == 9 and max(r["b"] for r in held) < 1.01 * min(r["b"] for r in held)
    moved = m.moves(even, grown).agg(F.sum("bytes")).first()[0] / sum(r["b"] for r in held)
    assert 1 / 9 - 0.01 < moved < 0.2 and m.moves(first, even).count() < 0.3 * sharding.SLOTS
    assert m.read(first).where("shard <> floor(slot * 8 / 4096)").isEmpty()
    sharding.write_shards(docs, m.read(), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 4000 and back.select("__shard").distinct().collect()[0][0] == "own"
    want = {r["key"]: r["shard"] for r in sharding.placed(rows, m.read()).select("key", "shard").collect()}
    assert {r["doc_id"]: r["shard"] for r in back.select("doc_id", "shard").collect()} == want


def drawn(i):
    h = hashlib.sha256(str(i).encode()).hexdigest()
    return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]


def plain_as_of(key, t, versions, lifetime):
    best = None
    for k, i, event, arrival, expiry, f in versions:
        if None not in (k, i, event, arrival, expiry) and k == key and event <= t and arrival <= t < expiry and t - event < lifetime:
            best = max(best or (), (event, -arrival, i, f))
    return (best[2], best[0], best[3]) if best else (None, None, None)


def test_as_of_walks_over_parts(spark):
    """A hot key with very many versions that are not usable, moments with many asks, keys with asks only, ties and nulls."""
    rng = random.Random(9)
    versions = [("hot", 1, 0, 0, 10_000, "a"), ("hot", 2, 0, 0, 10_000, "b"), ("hot", 2, 0, 0, 10_000, "c")]
    versions += [("hot", 10 + i, 5 + i // 40, 9_000, 9_999, "late") for i in range(3000)]
    versions += [(rng.choice("abc"), 5000 + i, e := rng.randint(0, 300), e + rng.randint(-5, 60), e + rng.randint(0, 90), "f") for i in range(600)]
    versions += [(None, 9000, 1, 1, 99, "x"), ("a", None, 1, 1, 99, "x"), ("a", 9001, None, 1, 99, "x")]
    asks = [("hot", t) for t in (0, 4, 5, 40, 79, 80, 81, 150, 9000, 9500) for _ in range(60)] + [(rng.choice("abcd"), rng.randint(-5, 420)) for _ in range(500)] + [("only", 7)] * 400 + [(None, 3), ("a", None)]
    v = spark.createDataFrame(versions, "key string, id long, event long, arrival long, expiry long, f string").repartition(5)
    a = spark.createDataFrame([(k, t, n, "u") for n, (k, t) in enumerate(asks)], "key string, time long, n long, uid string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for lifetime in (100, 12_000):
            got = asof.as_of(a, v, ["f"], lifetime, Scratch(spark, "test"))
            assert got.columns == ["key", "time", "n", "uid", "winner", "event", "f"]
            found = {r["n"]: (r["winner"], r["event"], r["f"]) for r in got.collect()}
            assert found == {n: plain_as_of(k, t, versions, lifetime) if t is not None else (None,) * 3 for n, (k, t) in enumerate(asks)}
            assert found[0][0] == 2 and found[0][2] == "c"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_as_of_query(spark):
    rows = [(i, "x", f"s{i % 3}" if i % 7 else None) for i in range(900)] + [(None, "x", "s1"), (4, "x", "s1")]
    docs = documents(spark, rows)
    ids = [*range(0, 1000, 3), *[8] * 2500, None, 4]
    got = asof.query(spark, docs, spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")).collect()
    assert len(got) == len(ids) and sum(r["doc_id"] == 8 for r in got) == 2500
    versions = []
    for i, _, s in rows:
        if i is not None:
            x = drawn(i)
            e = x[0] % 20000
            versions.append((s, i, e, e - 60 + x[1] % 300, e + x[2] % 900, 0))
    source = {i: s for i, _, s in reversed(rows)}
    for r in got:
        if r["doc_id"] is None:
            assert tuple(r)[1:] == (None, None, None, "none", None, None)
            continue
        t = drawn(r["doc_id"])[3] % 20000
        w, e, _ = plain_as_of(source.get(r["doc_id"]), t, versions, 900)
        age = None if w is None else t - e
        fresh = w is not None and age <= 60
        assert tuple(r)[1:] == (t, w, age, "none" if w is None else "fresh" if fresh else "stale", 1 if fresh else None, "en" if fresh else None)


def test_as_of_of_nothing(spark):
    docs, none = documents(spark, [(1, "x", "s")]), spark.createDataFrame([], "doc_id long, quality int")
    assert asof.query(spark, docs, none).collect() == []
    assert asof.query(spark, docs.limit(0), none.union(spark.createDataFrame([(1, 1)], "doc_id long, quality int"))).first()["status"] == "none"
    assert sharding.query(spark, docs.limit(0)).collect() == []


def plain_lloyd(ids, x, k, rounds, seed):
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{seed}:{ids[i]}".encode()).hexdigest(), x[i].tolist()))
    c = x[order[:k]].copy()
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if r < rounds:
            for j in range(len(c)):
                if (own == j).any():
                    c[j] = x[own == j].sum(0) // (own == j).sum()
    return own, d.min(1), c


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "few"])
def test_centroids_are_lloyds(spark, kind, monkeypatch):
    rng = np.random.default_rng(6)
    n = {"few": 5}.get(kind, 900)
    centers = rng.normal(0, 2, (12, 64))
    v = centers[rng.integers(0, 12, n)] + rng.normal(0, 0.05, (n, 64)) if kind == "clusters" else rng.normal(0, 1, (n, 64))
    if kind == "copies":
        v[: n // 2] = v[0]
        v[n // 2 : n // 2 + 5, 0] = 3e5
    ids = list(range(n))
    monkeypatch.setattr(cluster, "CHUNK", 250)
    bad = [(9001, None, 0), (9002, [1.0] * 63, 0), (9003, [1.0] * 63 + [None], 0), (9004, [math.nan] * 64, 0), (9005, [math.inf] + [0.0] * 63, 0), (9006, [1.0] * 65, 0), (9007, [], 0)]
    df = spark.createDataFrame([(i, a.tolist(), 1) for i, a in zip(ids, v)] + bad, "vec_id long, embedding array<double>, cluster int").repartition(3)
    x = np.clip(np.floor(1024 * v), -cluster.MOST, cluster.MOST).astype(np.int64)
    own, dist, c = plain_lloyd(ids, x, 8, 10, 3)
    got = {r["vec_id"]: r for r in cluster.query(spark, df).collect()}
    assert sorted(got) == ids
    for i in ids:
        r = got[i]
        assert (r["cluster"], r["distance"], r["inertia"]) == (own[i], dist[i], dist.sum()) and r["cluster_inertia"] == dist[own == own[i]].sum()
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, c[own[i]])).encode()).hexdigest()


def test_cover_tree_covers_and_prunes():
    rng = np.random.default_rng(2)
    centers = rng.integers(-3000, 3000, (8, 64))
    x = centers[rng.integers(0, 8, 1000)] + rng.integers(-40, 40, (1000, 64))
    tree = cluster.cover_tree(x)
    rows = x[tree["order"]]
    for a, b, c, r, k, e in zip(*(tree[n] for n in ("lo", "hi", "center", "radius", "kids", "kid_hi"))):
        assert np.sqrt(((rows[a:b] - x[c]) ** 2).sum(1)).max() <= r + 1e-6
        if e > k:  # children share out the node's rows, and one of them has its center
            assert tree["lo"][k] == a and tree["hi"][e - 1] == b and (tree["lo"][k + 1 : e] == tree["hi"][k : e - 1]).all() and c in tree["center"][k:e]
    place = np.argsort(tree["order"])
    own, sums, counts, compared = cluster.DualTree(centers).nearest(rows, tree | {"center": place[tree["center"]]})
    assert compared == 0 and (own == ((rows[:, None] - centers[None]) ** 2).sum(2).argmin(1)).all()
    assert all((sums[k] == rows[own == k].sum(0)).all() for k in range(8)) and counts.sum() == 1000


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert cluster.query(spark, df).collect() == []
