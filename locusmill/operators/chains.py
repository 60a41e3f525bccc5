"""List ranking by pointer doubling: directed links become ordered paths and rings in a number of rounds that grows with the logarithm of
the longest, and lines that share ends become polylines."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def ranked(links: DataFrame, scratch: Scratch, name: str = "chains") -> DataFrame:
    """node, chain, rank, ring for links (node, next): no two nodes have one next, and the last node of a path has null.

    A path is named by its last node and ranked from 0 at the node that none leads to; a ring is named by its least node and ranked from there.
    Each node's pointer is doubled until it has passed the end, and with it go the steps passed, the last node, the least node passed and the
    steps to it.  Two spans that follow each other in a path have no common least node; once all that follow each other in a ring have, every
    node of it knows the ring's.  Each round is written and joins on unique nodes."""
    to, low = F.col("to"), F.col("low")
    live = links.select("node", F.col("next").alias("to"), F.lit(1).cast("long").alias("n"), F.col("node").alias("last"), F.col("node").alias("low"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("open"))
    live, k = scratch.table(live, f"{name}-0"), 0
    while not live.where(to.isNotNull() & F.col("open")).isEmpty():
        ahead = live.select(F.col("node").alias("to"), *[F.col(c).alias(f"__{c}") for c in ("to", "n", "last", "low", "off")])
        lower = F.col("__low") < low
        moved = live.where(to.isNotNull()).join(ahead, "to").select("node", F.col("__to").alias("to"), (F.col("n") + F.col("__n")).alias("n"), F.col("__last").alias("last"), F.least("low", "__low").alias("low"), F.when(lower, F.col("n") + F.col("__off")).otherwise(F.col("off")).alias("off"), (F.col("__low") != low).alias("open"))
        k += 1
        live = scratch.table(live.where(to.isNull()).unionByName(moved), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    ring = to.isNotNull()
    found = live.select("node", F.when(ring, low).otherwise(F.col("last")).alias("chain"), F.when(ring, F.col("off")).otherwise(F.col("n")).alias("__at"), ring.alias("ring"))
    length = found.groupBy("chain").agg(F.count("*").alias("__n"))
    rank = F.when(F.col("ring"), F.pmod(F.col("__n") - F.col("__at"), F.col("__n"))).otherwise(F.col("__n") - F.col("__at"))
    return found.join(length, "chain").select("node", "chain", rank.alias("rank"), "ring")


def merged_lines(segments: DataFrame, scratch: Scratch) -> DataFrame:
    """key, line, closed, points (array<struct<x, y>>): segments (key, x1, y1, x2, y2) of each key joined wherever exactly two of them end.

    Points with one end, or three and more, end a line.  A line of one key and a point of equal coordinates is one, unless segments name their
    points (n1, n2): then points are told apart by name, too.  Repeated segments, in either direction, count once, and segments from a point to
    itself or with a null are left out.  A line starts at the end whose first segment is the lesser.
    Every segment gives two directed ones; a chain of them and its reverse are one line, of which one is kept."""
    names = "n1" in segments.columns
    a, b = (F.struct(*[F.col(f"{c}{k}").alias(c) for c in ("xyn" if names else "xy")]) for k in (1, 2))
    whole = segments.dropna(subset=["x1", "y1", "x2", "y2", *(["n1", "n2"] if names else [])]).select("key", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    whole = scratch.table(whole.withColumn("id", F.monotonically_increasing_id()), "segments")
    both = whole.select("key", (F.col("id") * 2).alias("node"), "a", "b").unionByName(whole.select("key", (F.col("id") * 2 + 1).alias("node"), F.col("b").alias("a"), F.col("a").alias("b")))
    both = scratch.table(both, "directed")
    # At a point where two segments end, the one that comes in leads to the other, not to its own reverse.
    out = both.groupBy("key", F.col("a").alias("at")).agg(F.count("*").alias("n"), F.min("node").alias("u"), F.max("node").alias("v")).where("n = 2")
    back = F.col("node").bitwiseXOR(F.lit(1))
    links = both.join(out.select("key", F.col("at").alias("b"), "u", "v"), ["key", "b"], "left").select("node", F.when(F.col("u") == back, F.col("v")).otherwise(F.col("u")).alias("next"))
    chains = both.join(ranked(links, scratch, "lines"), "node")
    # A ring and its reverse have the least nodes 2k and 2k + 1, or a path and its reverse: the even one's side is kept.
    least = chains.groupBy("chain").agg(F.min(F.when(F.col("rank") == 0, F.col("node"))).alias("head"), F.min(F.shiftright("node", 1)).alias("low"))
    kept = least.groupBy("low").agg(F.min_by("chain", "head").alias("chain"))
    found = chains.join(kept, "chain")
    points = F.array_sort(F.collect_list(F.struct("rank", "a", "b")))
    lines = found.groupBy("key", "chain").agg(F.first("ring").alias("closed"), points.alias("p"))
    at = F.concat(F.transform("p", lambda s: s["a"]), F.array(F.element_at("p", -1)["b"]))
    places = F.transform(at, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return lines.select("key", F.col("chain").alias("line"), "closed", places.alias("points"))


def length_m(points: Column, mx: float, my: float) -> Column:
    """Metres of a polyline; mx, my: metres per unit of x and y."""
    steps = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.hypot((F.get(points, i)["x"] - F.get(points, i - 1)["x"]) * mx, (F.get(points, i)["y"] - F.get(points, i - 1)["y"]) * my))
    return F.when(F.size(points) < 2, 0.0).otherwise(F.aggregate(steps, F.lit(0.0), lambda s, x: s + x))


def along(points: Column, share: Column) -> Column:
    """struct<x, y>: the point at a share of a polyline's length, in units of its coordinates."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(points) - 1), lambda i: F.struct(F.get(points, i - 1).alias("a"), F.get(points, i).alias("b")))
    steps = F.transform(pairs, lambda e: F.struct(e["a"].alias("a"), e["b"].alias("b"), F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]).alias("d")))
    goal = share * F.aggregate(steps, F.lit(0.0), lambda s, e: s + e["d"])
    start = F.struct(F.lit(0.0).alias("done"), goal.alias("goal"), F.get(points, 0)["x"].alias("x"), F.get(points, 0)["y"].alias("y"))

    def step(s: Column, e: Column) -> Column:
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(s["goal"] - s["done"], e["d"]), F.lit(0.0))))
        here = s["done"] < s["goal"]
        x, y = e["a"]["x"] + t * (e["b"]["x"] - e["a"]["x"]), e["a"]["y"] + t * (e["b"]["y"] - e["a"]["y"])
        return F.struct((s["done"] + e["d"]).alias("done"), s["goal"].alias("goal"), F.when(here, x).otherwise(s["x"]).alias("x"), F.when(here, y).otherwise(s["y"]).alias("y"))

    return F.aggregate(steps, start, step, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))


def simplified(points: Column, tolerance: float) -> Column:
    """A polyline without points that lie within `tolerance` of the line through those that stay (Douglas and Peucker); its ends stay."""
    def run(lines: pd.Series) -> pd.Series:
        import numpy as np

        def one(line):
            p = np.array([(v["x"], v["y"]) for v in line], float)
            keep, todo = {0, len(p) - 1}, [(0, len(p) - 1)]
            while todo:
                i, j = todo.pop()
                if j - i < 2:
                    continue
                d, q = p[j] - p[i], p[i + 1 : j] - p[i]
                t = np.clip((q @ d) / (d @ d), 0, 1) if d @ d else np.zeros(len(q))
                off = np.hypot(*(q - t[:, None] * d).T)
                k = int(off.argmax())
                if off[k] > tolerance:
                    keep.add(i + 1 + k)
                    todo += [(i, i + 1 + k), (i + 1 + k, j)]
            return [line[k] for k in sorted(keep)]

        return lines.map(lambda x: None if x is None else one(x) if len(x) else [])

    return F.pandas_udf(run, "array<struct<x: double, y: double>>")(points)
