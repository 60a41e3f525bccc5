"""Lloyd's centroids with two trees: cover trees over the vectors, built once, and one over the centroids, built anew each round.

Vectors are gathered into chunks of some thousands as they are scanned, and each chunk gets a cover tree: nets of falling radius from a
farthest-first order, each net within the next, every vector within its net's radius of its node.  A round sends the centroids, a bounded
parameter, to all tasks, and each task walks pairs of a vector node and a centroid node.  A centroid node is dropped for a vector node if even
its nearest point is farther than some centroid's farthest.  A vector node with one centroid left is given to it whole, by the node's sum; leaves
with several are compared exactly.  Bounds have a margin for rounding and sums and distances are whole numbers, so the result is exactly Lloyd's.

Components are floor(1024 * x); beyond 2**27 either way they are taken as 2**27, as a squared distance would not fit a long.  Rows with a null,
missing, short, long or non-finite vector are left out.  Repeated rows are vectors of their own.  With fewer vectors than centroids each is one;
an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, releasing, ship

#: Components of a vector; vectors of a chunk; vectors of a leaf, about; centroids of a tree's leaf.
WIDTH, CHUNK, LEAF = 64, 4096, 16
#: The largest component after scaling.
MOST = 1 << 27
#: Rounding of a distance in doubles, relative and absolute, well above what 64 terms can gather.
MARGIN = 1e-9, 1e-6


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of a to the row, or rows, b: exact whole numbers."""
    d = a - b
    return np.einsum("...i,...i->...", d, d)


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> dict[str, np.ndarray]:
    """A cover tree over the rows of x (int64): `order` lists the rows so that each node's rows lie in one run; nodes have `center` (a row),
    `radius` (the largest distance of its rows), `lo`, `hi` (its run) and `kids`, `kid_hi` (its children's numbers, a run; none for a leaf) and
    `sum` (of its rows)."""
    n = len(x)
    # Farthest-first: pick k has distance far[k] to the earlier picks; all rows are within far[k + 1] of the first k + 1 picks.
    near, of = _squares(x, x[0]), np.zeros(n, np.int64)
    picks, far = [0], [np.inf]
    while len(picks) * leaf < n and (k := int(near.argmax())) >= 0 and near[k] > 0:
        far.append(float(near[k]) ** 0.5)
        d = _squares(x, x[k])
        closer = d < near
        near[closer], of[closer] = d[closer], len(picks)
        picks.append(k)
    picks, far = np.array(picks), np.array(far)
    at = x[picks]
    # Nets: level l holds the picks with far > top / 2**l, so each level begins the next and covers it.
    sizes, radius = [1], far[1] if len(far) > 1 else 1.0
    while sizes[-1] < len(picks):
        radius /= 2
        if (size := int((far > radius).sum())) > sizes[-1]:  # a level like the one above is left out
            sizes.append(size)
    parent = [np.zeros(1, np.int64)]
    for small, large in zip(sizes, sizes[1:]):
        up = np.arange(large)
        for i in range(small, large):  # a pick's parent is its nearest in the net above
            up[i] = _squares(at[:small], at[i]).argmin()
        parent.append(up)
    # Paths from the root sort the picks so that each node's rows are a run.
    paths = [np.arange(len(picks))]
    for up in reversed(parent[1:]):
        paths.append(up[paths[-1]])
    paths = paths[::-1]
    rank = np.lexsort(tuple(paths[::-1]))
    place = np.empty(len(picks), np.int64)
    place[rank] = np.arange(len(picks))
    order = np.argsort(place[of], kind="stable")
    path_of = [p[of[order]] for p in paths]
    center, lo, hi, first_kid, kid_hi = [], [], [], [], []
    begin = 0
    for level, p in enumerate(path_of):
        starts = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        ends = np.append(starts[1:], n)
        center.append(picks[p[starts]])
        lo.append(starts)
        hi.append(ends)
        begin += len(starts)
        if level + 1 < len(path_of):
            q = path_of[level + 1]
            below = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            first_kid.append(begin + np.searchsorted(below, starts))
            kid_hi.append(begin + np.searchsorted(below, ends))
        else:
            first_kid.append(np.zeros(len(starts), np.int64))
            kid_hi.append(np.zeros(len(starts), np.int64))
    tree = {"order": order, "center": np.concatenate(center), "lo": np.concatenate(lo), "hi": np.concatenate(hi), "kids": np.concatenate(first_kid), "kid_hi": np.concatenate(kid_hi)}
    rows = x[order]
    tree["radius"] = np.array([float(_squares(rows[a:b], x[c]).max()) ** 0.5 for a, b, c in zip(tree["lo"], tree["hi"], tree["center"])])
    tree["sum"] = np.array([rows[a:b].sum(0) for a, b in zip(tree["lo"], tree["hi"])])
    return tree


def _expanded(kids: np.ndarray, kid_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs [kids, kid_hi): the number of the run and the member, for all members."""
    n = kid_hi - kids
    which = np.repeat(np.arange(len(n)), n)
    return which, kids[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


class DualTree:
    """The centroids' tree, and its walk beside a chunk's tree."""

    def __init__(self, centroids: np.ndarray):
        self.c, self.tree = centroids, cover_tree(centroids, 1)
        self.at = centroids[self.tree["center"]]
        first = np.array([np.flatnonzero((centroids == c).all(1))[0] for c in centroids])
        self.number = first[self.tree["center"]]  # of equal centroids the first is the nearest
        self.inner = self.tree["kid_hi"] > self.tree["kids"]

    def nearest(self, x: np.ndarray, tree: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For rows x in the tree's order: the number of each row's nearest centroid, sums and counts by centroid, and how many pairs of a
        row and a centroid were compared."""
        out = np.full(len(x), -1, np.int32)
        sums, counts, compared = np.zeros((len(self.c), x.shape[1]), np.int64), np.zeros(len(self.c), np.int64), 0
        v, c = np.zeros(1, np.int64), np.zeros(1, np.int64)
        at, radius, c_radius = x[tree["center"]].astype(np.int64), tree["radius"], self.tree["radius"]
        while len(v):
            d = np.sqrt(_squares(at[v], self.at[c]).astype(np.float64))
            ids, group = np.unique(v, return_inverse=True)
            best = np.full(len(ids), np.inf)
            np.minimum.at(best, group, d + radius[v])  # a centroid node's center is a centroid
            stay = d - radius[v] - c_radius[c] <= best[group] * (1 + MARGIN[0]) + MARGIN[1]
            v, c, group = v[stay], c[stay], group[stay]
            inner = self.inner[c]
            widest = np.full(len(ids), -1.0)
            np.maximum.at(widest, group, np.where(inner, c_radius[c], -1.0))
            leaf = tree["kid_hi"][v] == tree["kids"][v]
            alone = (np.bincount(group, minlength=len(ids))[group] == 1) & ~inner
            final = leaf & (widest[group] < 0) & ~alone
            narrow = ~inner & ~alone & ~final
            by_c = inner & (leaf | (radius[v] <= widest[group]))
            whose = np.zeros(len(ids), bool)
            np.logical_or.at(whose, group, by_c)
            by_v = (inner | narrow) & ~whose[group]
            for node, k in zip(v[alone].tolist(), self.number[c[alone]].tolist()):
                a, b = tree["lo"][node], tree["hi"][node]
                out[a:b] = k
                sums[k] += tree["sum"][node]
                counts[k] += b - a
            for node in np.unique(v[final]).tolist():
                ks = np.sort(self.number[c[final & (v == node)]])  # ties go to the smaller number
                a, b = tree["lo"][node], tree["hi"][node]
                rows = x[a:b].astype(np.int64)
                own = ks[_squares(rows[:, None, :], self.c[None, ks]).argmin(1)]
                out[a:b] = own
                np.add.at(sums, own, rows)
                counts += np.bincount(own, minlength=len(counts))
                compared += len(rows) * len(ks)
            which, kids = _expanded(tree["kids"][v[by_v]], tree["kid_hi"][v[by_v]])
            which_c, kids_c = _expanded(self.tree["kids"][c[by_c]], self.tree["kid_hi"][c[by_c]])
            rest = whose[group] & ~by_c  # pairs that wait for their node's wider centroid nodes
            v, c = np.concatenate([kids, v[by_c][which_c], v[rest]]), np.concatenate([c[by_v][which], kids_c, c[rest]])
        return out, sums, counts, compared


_NODE = ("center", "lo", "hi", "kids", "kid_hi")
TREES = "vec_ids array<long>, vectors binary, nodes binary, radii binary, sums binary"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of vec_id and embedding -> a row per chunk: its vectors in the order of its tree, and the tree."""
    ids: list[pa.Array] = []
    parts: list[np.ndarray] = []

    def packed() -> pa.RecordBatch:
        x = np.concatenate(parts)
        tree = cover_tree(x)
        names = pa.concat_arrays(ids).take(pa.array(tree["order"]))
        place = np.empty(len(x), np.int64)
        place[tree["order"]] = np.arange(len(x))
        nodes = np.stack([place[tree["center"]], *[tree[k] for k in _NODE[1:]]])
        blobs = [a.tobytes() for a in (x[tree["order"]].astype("<i4"), nodes.astype("<i8"), tree["radius"].astype("<f8"), tree["sum"].astype("<i8"))]
        ids.clear()
        parts.clear()
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), *[pa.array([b]) for b in blobs]], ["vec_ids", "vectors", "nodes", "radii", "sums"])

    for b in batches:
        x = b["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
        x = np.clip(np.floor(1024 * x), -MOST, MOST).astype(np.int64)
        at = 0
        while at < len(x):
            step = CHUNK - sum(map(len, parts))
            ids.append(b["vec_id"].slice(at, step))
            parts.append(x[at : at + step])
            at += step
            if sum(map(len, parts)) == CHUNK:
                yield packed()
    if parts:
        yield packed()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, dict[str, np.ndarray]]]:
    for b in batches:
        for i in range(b.num_rows):
            x, nodes, radius, sums = (np.frombuffer(b[k][i].as_buffer(), t) for k, t in (("vectors", "<i4"), ("nodes", "<i8"), ("radii", "<f8"), ("sums", "<i8")))
            tree = dict(zip(_NODE, nodes.reshape(len(_NODE), -1))) | {"radius": radius, "sum": sums.reshape(-1, WIDTH)}
            yield b["vec_ids"][i].values, x.reshape(-1, WIDTH), tree


def trees(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """The written chunks of vectors (vec_id, embedding), a third wider than the vectors themselves."""
    ship(vectors.sparkSession)
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    kept = vectors.where((F.size("embedding") == WIDTH) & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return scratch.table(kept.mapInArrow(releasing(_chunks), TREES), "trees")


def starts(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The first centroids: the k kept vectors with the least SHA-256 of `seed:vec_id`, by rising digest (of equal ones by components).  Their
    number is a parameter, so they come to the driver."""
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform("embedding", lambda e: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(F.lit(1024.0) * e.cast("double")).cast("double"))).cast("long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    found = vectors.where((F.size("embedding") == WIDTH) & finite).select(digest.alias("digest"), scaled.alias("x")).orderBy("digest", "x").limit(k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(-1, WIDTH)


def _moved(chunks: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: the centroids after it.  A task gives a row per centroid, so the driver gets a number of sums that only the centroids bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, sums, counts = DualTree(centroids), np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for _, x, tree in _read(batches):
            _, s, n, _ = walk.nearest(x, tree)
            sums += s
            counts += n
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * WIDTH, pa.int32()), pa.array(sums.reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(counts), lists], ["cluster", "n", "s"])

    parts = chunks.mapInArrow(releasing(run), "cluster int, n long, s array<long>")
    each = parts.select("cluster", "n", F.posexplode("s").alias("at", "s"))
    exact = "decimal(38,0)"
    total = each.groupBy("cluster", "at").agg(F.sum(F.col("n").cast(exact)).alias("n"), F.sum(F.col("s").cast(exact)).alias("s")).where("n > 0")
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"], r["at"]] = int(r["s"]) // int(r["n"])
    return out


def _assigned(chunks: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = DualTree(centroids)
        for ids, x, tree in _read(batches):
            own = walk.nearest(x, tree)[0]
            yield pa.RecordBatch.from_arrays([ids, pa.array(own), pa.array(_squares(x.astype(np.int64), centroids[own]))], ["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(releasing(run), "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, scratch: Scratch, k: int = 8, rounds: int = 10, seed: int = 3) -> tuple[DataFrame, np.ndarray]:
    """A written table of vec_id, cluster, distance (squared, in scaled components), and the final centroids.  Empty centroids stay."""
    chunks, centroids = trees(vectors, scratch), starts(vectors, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    for _ in range(rounds):
        centroids = _moved(chunks, centroids)
    return scratch.table(_assigned(chunks, centroids), "assigned"), centroids


def query(spark: SparkSession, embeddings: DataFrame) -> DataFrame:
    """A row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    rows, centroids = lloyd(embeddings, Scratch(spark, "cluster"))
    names = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    digests = spark.createDataFrame(names, "cluster int, centroid_sha256 string")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own"))
    facts = sums.join(F.broadcast(digests), "cluster").withColumn("inertia", F.sum("own").over(Window.partitionBy()).try_cast("long"))  # a row per centroid
    out = rows.join(F.broadcast(facts), "cluster")
    return out.select("vec_id", "cluster", "distance", F.col("own").try_cast("long").alias("cluster_inertia"), "inertia", "centroid_sha256")


def _sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Each round as two tables: the nearest centroid of each vector, and the floors of the means."""
    scaled = f"[greatest(-{MOST}, least({MOST}, CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT))) FOR e IN embedding]"
    parts = [f"x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {scaled} AS x FROM embeddings WHERE len(embedding) = {WIDTH} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {WIDTH})"]
    parts.append(f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), x) - 1 AS cluster, x AS c FROM x QUALIFY cluster < {k})")
    for i in range(rounds + 1):
        parts.append(f"d{i} AS (SELECT r, vec_id, x, cluster, CAST(list_sum([(a - c[j]) * (a - c[j]) FOR a, j IN x]) AS BIGINT) AS distance FROM x, c{i})")
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM d{i} GROUP BY r)")
        if i < rounds:
            parts.append(f"s{i} AS (SELECT cluster, j, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS v, unnest(range({WIDTH})) AS j FROM a{i}) GROUP BY 1, 2)")
            parts.append(f"m{i} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY j) AS c FROM s{i} GROUP BY 1)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(m{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i} USING (cluster))")
    end = f"SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"
    return "WITH " + ",\n".join(parts) + "\n" + end


SQL = _sql()
