"""Quality rules: robust multivariate outliers.

Each text's counts become a vector of transformed statistics.  For every language and source a
minimum-covariance-determinant estimate of location and scatter is made by concentration steps: keep the COVER share of rows with the
least Mahalanobis distances, estimate from these, repeat.  There are two starts, medians with their absolute deviations and the
covariance of spatial signs; after FIRST steps the one of the smaller determinant goes on until no determinant falls by more than SETTLED.
A scatter's diagonal gets a floor (VECTOR), since a statistic may be constant.

Each step is two aggregations over the narrow table of statistics: a histogram of distances, which gives the cut, and sums of
products; every row counts.  Rows meet estimates and cuts by a broadcast whose size is checked, or salted, and sums are partial before the shuffle, so
a hot source is no task of its own.  A document beyond the CUT quantile of the distance is rejected, as is one that fails the base rules.

A source with fewer than LEAST passing rows is judged by the estimate of its whole language, a language with fewer by that of all.

Nulls: a null text has no words and fails the base rules; a null lang or source is a value of its own.  Ties and repeated
rows are judged alike; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, beside, ship, slices
from .textstats import statistics

COVER, LEAST = 0.75, 100
FIRST, MOST, SETTLED = 2, 12, 1e-3
#: The share of a normal population within the accepted distance.
CUT = 1 - 1e-9
#: Bins of the distance histogram for each doubling of the squared distance.
BINS = 32
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, with the least standard deviation that any group is held to have.
VECTOR = {"log_words": 0.3, "word_length": 0.3, "symbols": 0.03, "upper": 0.04, "repeats": 0.1, "dup_lines": 0.15, "marks": 0.04}


def chi2(p: int, q: float) -> float:
    """The q-quantile of the chi-squared distribution with p degrees of freedom (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(q) * (2 / (9 * p)) ** 0.5) ** 3


def vectors(c: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    n, chars = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1)

    def share(x, of):
        return np.arcsin(np.sqrt(np.minimum(x / of, 1)))

    return {
        "log_words": np.log(n),
        "word_length": c["word_chars"] / n,
        "symbols": share(c["n_symbols"], chars),
        "upper": share(c["n_upper"], chars),
        "repeats": share(c["n_repeat_words"], n),
        "dup_lines": share(c["n_dup_lines"], np.maximum(c["n_lines"], 1)),
        "marks": share(c["n_punctuation"], chars),
    }


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the five counts, base_failed and the vector x, from every whole text."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("source", pa.string()), *[(c, pa.int64()) for c in COUNTS], ("base_failed", pa.bool_()), *[(v, pa.float64()) for v in VECTOR]])

    def run(batches):
        for b in batches:
            texts = b.column(3).to_pylist()
            for lo, hi in slices(texts):
                c = statistics(texts[lo:hi])
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                yield pa.RecordBatch.from_arrays([*[b.column(i).slice(lo, hi - lo) for i in range(3)], *[pa.array(c[n]) for n in COUNTS], pa.array(failed), *[pa.array(v) for v in vectors(c).values()]], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), *[F.col(c).cast("string") for c in ("lang", "source", "text")])
    longs, doubles = ", ".join(f"{c} long" for c in COUNTS), ", ".join(f"{v} double" for v in VECTOR)
    return rows.mapInArrow(run, f"doc_id long, lang string, source string, {longs}, base_failed boolean, {doubles}")


def grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """rows with g, the group whose estimate judges them, and fits, the groups whose estimates they enter (none for rows that failed).

    Groups are "2" and the language and source, "1" and the language, "0" for all; the wider ones are made only where a narrower one needs them."""
    pair, lang = F.concat(F.lit("2"), F.to_json(F.struct("lang", "source"))), F.concat(F.lit("1"), F.to_json(F.struct("lang")))
    rows = rows.withColumns({"pair": pair, "own": lang})
    pairs = rows.where(~F.col("base_failed")).groupBy("pair", "own").agg(F.count("*").alias("n"))
    pairs = scratch.table(pairs.withColumn("big", F.col("n") >= LEAST), "pairs")
    langs = pairs.groupBy("own").agg(F.sum("n").alias("in_lang"), F.max(~F.col("big")).alias("rare"))
    langs = scratch.table(langs.withColumn("wide", F.col("in_lang") >= LEAST), "langs")
    every = not langs.where(F.col("rare") & ~F.col("wide")).isEmpty()
    levels = pairs.join(langs, "own").select(
        "pair",
        F.when(F.col("big"), F.col("pair")).when(F.col("wide"), F.col("own")).otherwise("0").alias("g"),
        F.filter(F.array(F.when(F.col("big"), F.col("pair")), F.when(F.col("rare") & F.col("wide"), F.col("own")), F.lit("0" if every else None).cast("string")), lambda x: x.isNotNull()).alias("fits"),
    )
    return beside(rows, scratch.table(levels, "levels"), "pair").drop("pair", "own")


def _distance(fit: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance under their group's fit (null without one)."""
    x = [F.col(v) - F.col("mean")[i] for i, v in enumerate(VECTOR)]
    terms: Column = F.lit(0.0)
    p = len(VECTOR)
    for i in range(p):
        for j in range(i, p):
            terms = terms + (1.0 if i == j else 2.0) * x[i] * x[j] * F.col("inverse")[i * p + j]
    return beside(rows, fit, "g").withColumn("d2", terms)


def _scatter(n: float, s, ss) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance, with the floor, from sums and sums of products (upper triangle, row by row)."""
    p = len(VECTOR)
    mean = np.asarray(s, float) / n
    cov = np.zeros((p, p))
    cov[np.triu_indices(p)] = np.asarray(ss, float) / n
    return mean, cov + np.triu(cov, 1).T - np.outer(mean, mean) + np.diag(np.array(list(VECTOR.values())) ** 2)


def _fit(sums: DataFrame) -> DataFrame:
    """From n, the sums s and the sums of products ss of each group: g, n, mean, inverse (row by row) and the determinant's logarithm."""

    def run(frames):
        for f in frames:
            fits = [_scatter(*x) for x in zip(f["n"], f["s"], f["ss"])]
            yield pd.DataFrame({"g": f["g"], "mean": [m.tolist() for m, _ in fits], "inverse": [np.linalg.inv(c).ravel().tolist() for _, c in fits], "logdet": [float(np.linalg.slogdet(c)[1]) for _, c in fits]})

    return sums.mapInPandas(run, _FIT)


_FIT = "g string, mean array<double>, inverse array<double>, logdet double"


def _signed(sums: DataFrame) -> DataFrame:
    """The start from spatial signs: sd and the sums ss of products of unit vectors of the standardized statistics of n rows."""

    def run(frames):
        p = len(VECTOR)
        for f in frames:
            out = []
            for n, sd, ss in zip(f["n"], f["sd"], f["ss"]):
                cov = np.zeros((p, p))
                cov[np.triu_indices(p)] = np.asarray(ss, float) / n * p
                sd = np.asarray(sd, float)
                cov = (cov + np.triu(cov, 1).T) * np.outer(sd, sd) + np.diag(np.array(list(VECTOR.values())) ** 2)
                out.append(np.linalg.inv(cov).ravel().tolist())
            yield pd.DataFrame({"g": f["g"], "mean": f["mean"], "inverse": out, "logdet": 0.0})

    return sums.mapInPandas(run, _FIT)


def _sums(rows: DataFrame) -> DataFrame:
    names = list(VECTOR)
    s = F.array(*[F.sum(v) for v in names])
    ss = F.array(*[F.sum(F.col(a) * F.col(b)) for i, a in enumerate(names) for b in names[i:]])
    return rows.groupBy("g").agg(F.count("*").alias("n"), s.alias("s"), ss.alias("ss"))


def _cuts(rows: DataFrame, share: float) -> DataFrame:
    """g, cut: the first bin of the distance histogram up to which at least `share` of a group's rows lie."""
    bins = rows.groupBy("g", "bin").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("g").orderBy("bin")
    bins = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy("g")))
    return bins.where(F.col("upto") >= share * F.col("all")).groupBy("g").agg(F.min("bin").alias("cut"))


def _binned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bin", F.floor(F.log2(F.greatest("d2", F.lit(1e-6))) * BINS).cast("int"))


def _step(fit: DataFrame, rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """One concentration step: the estimates from the rows nearest to the estimates `fit`."""
    cuts = _cuts(_binned(_distance(fit, rows).select("g", "d2")), COVER).coalesce(4)
    cut = scratch.table(fit.join(cuts, "g").select("g", "mean", "inverse", "cut"), f"{name}-cut")
    near = _binned(_distance(cut, rows)).where(F.col("bin") <= F.col("cut"))
    return scratch.table(_fit(_sums(near).coalesce(4)), name)


def estimate(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """g, mean, inverse, scale: the estimates of each group, scale being what makes the median squared distance a normal one's.  rows: the
    statistics with g, a row for every group that a document's row enters."""
    names, p = list(VECTOR), len(VECTOR)
    medians = scratch.table(rows.groupBy("g").agg(F.array(*[F.percentile_approx(v, 0.5, 1000) for v in VECTOR]).alias("mean")).coalesce(4), "medians")
    spread = F.array(*[F.greatest(F.percentile_approx(F.abs(F.col(v) - F.col("mean")[i]), 0.5, 1000) * 1.4826, F.lit(s)) for i, (v, s) in enumerate(VECTOR.items())])
    centres = scratch.table(medians.join(beside(rows, medians, "g").groupBy("g").agg(spread.alias("sd")), "g").coalesce(4), "centres")
    inverse = F.array(*[1 / (F.col("sd")[i] * F.col("sd")[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])
    plain = centres.select("g", "mean", inverse.alias("inverse"), F.lit(0.0).alias("logdet"))
    z = [(F.col(v) - F.col("mean")[i]) / F.col("sd")[i] for i, v in enumerate(names)]
    norm = sum((x * x for x in z[1:]), z[0] * z[0])
    products = F.array(*[F.sum(F.coalesce(F.try_divide(z[i] * z[j], norm), F.lit(0.0))) for i in range(p) for j in range(i, p)])
    signs = beside(rows, centres, "g").groupBy("g").agg(F.count("*").alias("n"), products.alias("ss")).join(centres, "g").coalesce(4)
    starts = [f.withColumn("g", F.concat("g", F.lit(f"#{k}"))) for k, f in enumerate((plain, _signed(signs)))]
    fit = scratch.table(starts[0].unionByName(starts[1]), "starts")
    both = rows.withColumn("g", F.explode(F.array(*[F.concat("g", F.lit(f"#{k}")) for k in range(2)])))
    for k in range(FIRST):
        fit = _step(fit, both, scratch, f"first{k}")
    best = fit.groupBy(F.expr("left(g, length(g) - 2)").alias("g")).agg(F.min_by(F.struct("mean", "inverse"), F.struct("logdet", "g")).alias("f"), F.min("logdet").alias("logdet"))
    fit = scratch.table(best.select("g", "f.mean", "f.inverse", "logdet").coalesce(4), "best")
    for k in range(MOST):
        new = _step(fit, rows, scratch, f"step{k}")
        fell = new.join(fit.select("g", F.col("logdet").alias("was")), "g").agg(F.max(F.col("was") - F.col("logdet")).alias("x")).first()["x"]
        fit = new
        if fell is None or fell <= SETTLED:
            break
    middle = _cuts(_binned(_distance(fit, rows).select("g", "d2")), 0.5)
    scale = F.pow(F.lit(2.0), (F.col("cut") + 0.5) / BINS) / chi2(p, 0.5)
    return scratch.table(fit.join(middle.select("g", scale.alias("scale")), "g").select("g", "mean", "inverse", "scale").coalesce(4), "estimates")


def outliers(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """measure() with d2 (scaled to a chi-squared distance; null where every row of the table failed) and kept."""
    scratch = scratch or Scratch(docs.sparkSession, "rules")
    rows = scratch.table(grouped(scratch.table(measure(docs), "measured"), scratch), "grouped")
    fit = estimate(rows.where(~F.col("base_failed")).select(F.explode("fits").alias("g"), *VECTOR), scratch)
    for name in scratch.names - {"grouped", "estimates"}:
        scratch.drop(name)
    judged = _distance(fit, rows).withColumn("d2", F.col("d2") / F.greatest("scale", F.lit(1.0)))
    kept = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= chi2(len(VECTOR), CUT))
    return judged.withColumn("kept", kept)


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return outliers(docs).select("doc_id", *COUNTS, "base_failed", "kept", "d2")
