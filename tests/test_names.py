"""Name scores with and without the filter, common substrings and rounding against plain Python."""

import difflib
import math
import random

from pyspark.sql import functions as F

from locusmill.functions import text
from locusmill.operators import link

RNG = random.Random(1)
NAMES = ["", "a", "ab", "aab", "bba", "カフェ", "カフェ青", "青カフェ", "cafe", "cafe blue", "blue cafe"] + ["".join(RNG.choice("abcé青") for _ in range(RNG.randint(1, 9))) for _ in range(60)]


def score(x, y):
    short, long = sorted((x, y), key=len)
    if not x or not y:
        return 0.0
    return 1.0 if x == y else 0.9 if len(short) >= 3 and short in long else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()


def test_scores_bounds_and_substrings(spark):
    pairs = spark.createDataFrame([(a, b) for a in NAMES for b in NAMES] + [(None, "a"), ("a", None)], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = pairs.select("a", "b", text.name_score(a, b).alias("score"), text.score_bound(a, b, text.letters(a), text.letters(b)).alias("bound"), text.longest_common(a, b).alias("common")).collect()
    assert len(got) == len(NAMES) ** 2 + 2
    for r in got:
        if r["a"] is None or r["b"] is None:
            assert r["score"] is None and r["common"] is None
            continue
        want = difflib.SequenceMatcher(None, r["a"], r["b"], autojunk=False).find_longest_match().size
        assert r["score"] == score(r["a"], r["b"]) <= r["bound"] + 1e-12 and r["common"] == want
    assert sum(r["bound"] is not None and r["bound"] < 0.6 for r in got) > len(got) / 4


def test_automaton():
    for _ in range(200):
        s, t = ("".join(RNG.choice("ab") for _ in range(RNG.randint(0, 30))) for _ in range(2))
        assert text.Substrings(t).longest(s) == difflib.SequenceMatcher(None, s, t, autojunk=False).find_longest_match().size


def test_filtered_matches_are_all_matches(spark):
    left = spark.createDataFrame([(i, RNG.choice(NAMES), 35 + RNG.random() / 300, 139.0) for i in range(80)], "row_id long, core string, lat double, lng double")
    right = spark.createDataFrame([(i, RNG.choice(NAMES), 35 + RNG.random() / 300, 139.0) for i in range(120)], "other_id long, other_core string, lat double, lng double")
    report = link.filter_report(left, right, 150.0, 0.6).first()
    assert 0 < report["verified"] < report["near"] / 2
    got = {r["row_id"]: (r["other_id"], r["score"]) for r in link.fuzzy_nearest(left, right, 150.0, 0.6).collect()}
    want = {}
    for x in left.collect():
        best = []
        for y in right.collect():
            h = math.sin(math.radians(y["lat"] - x["lat"]) / 2) ** 2
            m = 2 * 6371000 * math.asin(math.sqrt(h))
            if m <= 150 and score(x["core"], y["other_core"]) >= 0.6:
                best.append((-score(x["core"], y["other_core"]), round(m, 3), y["other_id"]))
        if best:
            want[x["row_id"]] = (min(best)[2], -min(best)[0])
    assert got == want and any(0.6 <= s < 0.9 for _, s in want.values())


def test_rounding(spark):
    values = [RNG.uniform(-1e4, 1e4) for _ in range(2000)] + [k / 8 for k in range(-50, 50)] + [2.675, 1.005, 0.5, 1.5, 2.5, -0.5, 1e300, -1e15, 0.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for digits in (0, 2, 4):
        for r in df.select("v", text.round_half_even(F.col("v"), digits).alias("x")).collect():
            if r["v"] is None or math.isnan(r["v"]):
                assert r["x"] is None or math.isnan(r["x"])
            else:
                assert r["x"] == (round(r["v"], digits) if math.isfinite(r["v"]) else r["v"]), (r["v"], digits)
