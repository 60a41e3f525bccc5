"""Quality classifier by co-training.

Two logistic models see a document from two sides: its text (shares of letters, marks, repeats, ...) and its page's
metadata (lang, source, n_chars, hashed).  Both start from the labelled sample.  In each round each model labels the part of all unlabelled
documents of which it is surest, and the other learns from that.  Each is then calibrated on held-out labels, as is the sum of both
calibrated log-odds; that score judges every document.

The labelled sample is bounded: the LABELLED documents with the least hash of doc_id.  The features of all documents are written once.
A round is a pass that counts the log-odds of the unlabelled ones in histograms, whose cut-offs select the surest, a pass that writes these
with their new labels, and a pass over all written so far for each Newton step, which sums gradient and Hessian; together the selected weigh at most
half as much as the labelled ones.  Newton's steps start from the round before and end below TOLERANCE, or after STEPS.  Scores come from the
written features.  Documents are rejected when the score is below THRESHOLD.

Nulls: a null text is empty, null metadata is a value of its own, labels without doc_id or quality are ignored; of a document's
several labels the least counts.  With no labels, or of one kind only, the score is 1.0 and nothing is rejected.  Repeated
rows get equal scores; an empty table gives no rows; other columns are kept by keep() and ignored by score()."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, release, releasing, ship, slices
from .textstats import statistics

LABELLED = 6000
ROUNDS, CONFIDENT, SHARE = 3, 0.95, 0.1
#: Newton steps of a round over the selected documents, and the change of weights that ends them.
STEPS, TOLERANCE = 6, 1e-3
THRESHOLD = 0.5
RIDGE = 1.0
#: Columns of the hashed metadata.
HASHED = 64
#: Columns of the content view, which come first in a row of features.
CONTENT = 15
#: Bins of a histogram for each unit of log-odds, which are clipped to 30.
BINS = 64


def content_view(texts: list[str | None]) -> np.ndarray:
    c = {k: v.astype(float) for k, v in statistics(texts).items()}
    n, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["n_chars"], 1), np.maximum(c["n_lines"], 1)

    def share(x, of):
        return np.sqrt(np.minimum(x / of, 1))

    columns = [
        np.log1p(c["n_words"]),
        c["word_chars"] / n,
        share(c["n_symbols"], chars),
        share(c["n_upper"], chars),
        share(c["n_digits"], chars),
        share(c["n_punctuation"], chars),
        share(c["n_bangs"], chars),
        share(c["n_distinct"], n),
        c["n_distinct"] / np.sqrt(n),
        share(c["n_same_next"], n),
        share(c["n_repeat_words"], n),
        share(c["n_dup_lines"], lines),
        share(c["n_capital_words"], n),
        np.log(n / lines),
        np.minimum(n, 50) / 50,
    ]
    return np.stack(columns, 1) if len(texts) else np.zeros((0, len(columns)))


def metadata_view(lang, source, n_chars) -> np.ndarray:
    """Hashed one-hot columns for language, source, both, and the order of magnitude of n_chars."""
    out = np.zeros((len(lang), HASHED + 1))
    for i, (a, b, n) in enumerate(zip(lang, source, n_chars)):
        size = -1 if n is None or n != n else int(np.log2(max(n, 0) + 1))
        for name in (f"l{a}", f"s{b}", f"x{a}|{b}", f"n{size}"):
            out[i, xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) % HASHED] += 1
        out[i, HASHED] = size / 10
    return out


def _sums(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-likelihood at w, the last column of x being ones."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (y - p)), (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x


def _ones(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.ones((len(x), 1))])


def fit_logistic(own: list[tuple], ridge: float = RIDGE, start: list[np.ndarray] | None = None, more=None, steps: int = 30, tolerance: float = 1e-6) -> list[np.ndarray]:
    """Weights (the last is the intercept) for each (x, y, weight) by damped Newton steps.  more(weights) gives gradient and Hessian
    of further rows for each."""
    own = [(_ones(x), y, weight) for x, y, weight in own]
    ws = [w.copy() for w in start] if start else [np.zeros(x.shape[1]) for x, _, _ in own]
    for _ in range(steps):
        far, largest = more(ws) if more else None, 0.0
        for k, (x, y, weight) in enumerate(own):
            gradient, hessian = _sums(x, y, weight, ws[k])
            if far:
                gradient, hessian = gradient + far[k][0], hessian + far[k][1]
            penalty = np.full(x.shape[1], ridge)
            penalty[-1] = 1e-6
            step = np.linalg.solve(hessian + np.diag(penalty), gradient - penalty * ws[k])
            ws[k] = ws[k] + step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            largest = max(largest, np.abs(step).max())
        if largest < tolerance:
            break
    return ws


@dataclass
class View:
    mean: np.ndarray
    sd: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -8, 8)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.scaled(x) @ self.weights[:-1] + self.weights[-1], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


@dataclass
class Model:
    content: View
    metadata: View
    combine: np.ndarray
    #: Unlabelled rows that took part, and rows given to each view.
    offered: int = 0
    given: tuple[int, int] = (0, 0)

    def score(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.logit(content), self.metadata.logit(metadata)
        both = np.clip(self.combine[0] * a + self.combine[1] * b + self.combine[2], -30, 30)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (a, b, both))


def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x[:, :CONTENT], x[:, CONTENT:]


def _given(history: list[tuple], x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which rows are still free after the rounds of history, and the label that each view was given (-1: none).  A round is its views
    and, for each view and label, the bin of its cut-off and the share of that bin's rows that is taken, by u."""
    free, labels, parts = np.ones(len(x), bool), [np.full(len(x), -1) for _ in range(2)], _sides(x)
    for views, cuts in history:
        taken = np.zeros(len(x), bool)
        for k in range(2):
            bins, label = _bins(views[k].raw(parts[k]))
            for t in (0, 1):
                at, share = cuts[k][t]
                hit = free & (label == t) & ((bins > at) | ((bins == at) & (u < share)))
                labels[1 - k][hit] = t
                taken |= hit
        free &= ~taken
    return free, labels


def _bins(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each row's log-odds, and the label that they are sure of (-1: none)."""
    return (np.abs(raw) * BINS).astype(int), np.where(np.abs(raw) >= np.log(CONFIDENT / (1 - CONFIDENT)), (raw > 0).astype(int), -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _totals(rows: DataFrame, size: int, add) -> np.ndarray:
    """The sum of add(batch), a vector of `size`, over the batches of rows."""

    def run(batches):
        total = np.zeros(size)
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                total += add(b.slice(lo, 4096))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.float64())], names=["i", "v"])

    found = rows.mapInArrow(releasing(run), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # at most `size` rows
    out = np.zeros(size)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def _cut(counts: np.ndarray, quota: int) -> tuple[int, float]:
    """The bin in which the quota is reached from above, and the share of its rows that fills it; all sure rows if they are fewer."""
    above = 0
    for at in np.flatnonzero(counts)[::-1]:
        if above + counts[at] >= quota:
            return int(at), float((quota - above) / counts[at])
        above += counts[at]
    return -1, 1.0


def cotrain(x: np.ndarray, y: np.ndarray, held: np.ndarray, pool: DataFrame, scratch: Scratch) -> Model:
    """x: the features of labelled rows; held: those kept for calibration; pool: x and u of all unlabelled rows, written."""
    views = _sides(x)
    own = [((v - v.mean(0)) / np.maximum(v.std(0), 1e-3), v.mean(0), np.maximum(v.std(0), 1e-3)) for v in views]
    base = [(np.clip(z[~held], -8, 8), y[~held].astype(float), np.ones((~held).sum())) for z, _, _ in own]
    prior, n = y[~held].mean(), pool.count()

    def models(ws: list[np.ndarray]) -> list[View]:
        return [View(mean, sd, w) for (_, mean, sd), w in zip(own, ws)]

    ws, history, given = fit_logistic(base), [], (0, 0)
    top, dims = 30 * BINS + 1, [v.shape[1] + 1 for v in views]
    selected: DataFrame | None = None
    for k in range(ROUNDS if n else 0):
        now = models(ws)

        def histogram(b, now=now, done=tuple(history)):
            x = _matrix(b)
            free, _ = _given(done, x, b.column("u").to_numpy())
            out = np.zeros((2, 2, top))
            for k, part in enumerate(_sides(x)):
                bins, label = _bins(now[k].raw(part))
                for t in (0, 1):
                    out[k, t] = np.bincount(bins[free & (label == t)], minlength=top)
            return out.ravel()

        counts = _totals(pool, 4 * top, histogram).reshape(2, 2, top)
        if not counts.any():
            break
        most = int(n * SHARE)
        history.append((now, [[_cut(counts[k, t], max(1, int(most * part))) for t, part in ((0, 1 - prior), (1, prior))] for k in range(2)]))

        def select(batches, done=tuple(history)):
            for b in batches:
                x, u = _matrix(b), b.column("u").to_numpy()
                labels = _given(done, x, u)[1]
                new = _given(done[:-1], x, u)[0] & ((labels[0] >= 0) | (labels[1] >= 0))
                yield pa.RecordBatch.from_arrays([b.column("x").filter(pa.array(new)), *[pa.array(own[new], pa.int32()) for own in labels]], names=["x", "content", "metadata"])

        new = scratch.table(pool.mapInArrow(releasing(select), "x array<double>, content int, metadata int"), f"selected{k}")
        selected = new if selected is None else selected.unionByName(new)

        def more(ws, now=now, rows=selected):
            nonlocal given

            def gather(b):
                out = []
                for view, w, part, name in zip(now, ws, _sides(_matrix(b)), ("content", "metadata")):
                    label = b.column(name).to_numpy()
                    hit = label >= 0
                    g, h = _sums(_ones(view.scaled(part[hit])), label[hit].astype(float), np.ones(hit.sum()), w)
                    out += [np.array([hit.sum()]), g, h.ravel()]
                return np.concatenate(out)

            total, at, out, given = _totals(rows, sum(1 + d + d * d for d in dims), gather), 0, [], ()
            for k, d in enumerate(dims):
                count, g, h = total[at], total[at + 1 : at + 1 + d], total[at + 1 + d : at + 1 + d + d * d].reshape(d, d)
                weight = 0.5 * min(1.0, len(base[k][1]) / max(count, 1.0))
                out.append((weight * g, weight * h))
                given += (int(count),)
                at += 1 + d + d * d
            return out

        ws = fit_logistic(base, start=ws, more=more, steps=STEPS, tolerance=TOLERANCE)
    found = models(ws)
    t = (y[held].astype(float), np.ones(held.sum()))
    for k, m in enumerate(found):
        (w,) = fit_logistic([(m.raw(views[k][held])[:, None], *t)], 1e-2)
        m.slope, m.shift = max(float(w[0]), 0.0), float(w[1])
    both = np.stack([m.logit(views[k][held]) for k, m in enumerate(found)], 1)
    return Model(found[0], found[1], fit_logistic([(both, *t)], 1e-2)[0], n, given)


def _least(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)


def features(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, x (both views), y (the label, or null) and u of every row, written."""
    ship(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("y"))
    # doc_id goes through pandas as a string: a null among numbers would round them.
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), *[F.col(c).cast("string") for c in ("text", "lang", "source")], F.col("n_chars").cast("double"))

    def run(frames):
        for f in frames:
            texts = f["text"].tolist()
            for lo, hi in slices(texts):
                g = f.iloc[lo:hi]
                x = np.hstack([content_view(texts[lo:hi]), metadata_view(g["lang"], g["source"], g["n_chars"])])
                yield pd.DataFrame({"doc_id": g["doc_id"], "x": list(x)})

    found = rows.mapInPandas(releasing(run), "doc_id string, x array<double>").withColumn("doc_id", F.col("doc_id").cast("long")).join(marks, "doc_id", "left")
    # u orders rows of one bin, whatever the order of rows in the table.
    return scratch.table(found.withColumn("u", F.pmod(F.xxhash64("x", "doc_id"), F.lit(1 << 30)) / (1 << 30)), "features")


def fit(rows: DataFrame, scratch: Scratch) -> Model | None:
    """Co-train on features(): the labelled sample and all unlabelled rows; None if the labels are of one kind or none."""
    known = rows.where(F.col("y").isNotNull())
    # At most LABELLED numbers: a bound that lets them be broadcast.
    chosen = _least(known.select("doc_id").distinct(), LABELLED)
    got = known.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min_by("x", F.xxhash64("x")).alias("x")).toPandas()  # a row each
    if got.empty:
        return None
    got = got.sort_values("doc_id")
    x, y = np.stack(got["x"]), got["y"].to_numpy().astype(int)
    held = np.array([xxhash.xxh3_64_intdigest(str(i).encode(), seed=7) % 4 == 0 for i in got["doc_id"]], bool)
    if not all(len(set(y[m].tolist())) == 2 for m in (held, ~held)):
        return None
    return cotrain(x, y, held, rows.where(F.col("y").isNull()).select("x", "u"), scratch)


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled sample and all unlabelled documents."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = fit(features(docs, labels, scratch), scratch)
    scratch.drop()
    return model


def scored(model: Model | None) -> Column:
    """A struct of content, metadata and score for each row."""
    if model is None:
        one = F.lit(1.0)
        return F.struct(one.alias("content"), one.alias("metadata"), one.alias("score"))

    @F.pandas_udf("content double, metadata double, score double")
    def run(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        texts, out = text.tolist(), []
        for lo, hi in slices(texts):
            b = metadata_view(lang.iloc[lo:hi], source.iloc[lo:hi], n_chars.iloc[lo:hi])
            out.append(np.stack(model.score(content_view(texts[lo:hi]), b), 1))
        release()
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 3)), columns=["content", "metadata", "score"])

    # Else a filter on the score would have it computed again.
    return run.asNondeterministic()(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("double"))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, content_score, metadata_score, score, kept for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), scored(model).alias("q"))
    return rows.select("doc_id", F.col("q.content").alias("content_score"), F.col("q.metadata").alias("metadata_score"), F.col("q.score").alias("score"), (F.col("q.score") >= THRESHOLD).alias("kept"))


def keep(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that the classifier accepts."""
    return docs.select(F.struct("*").alias("row"), scored(model)["score"].alias("score")).where(F.col("score") >= THRESHOLD).select("row.*")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """train() and score() with one reading of the texts: scores come from the written features."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = features(docs, labels, scratch)
    model = fit(rows, scratch)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                part = b.slice(lo, 4096)
                x = _matrix(part)
                each = np.ones((3, len(x))) if model is None else model.score(*_sides(x))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(v) for v in each], pa.array(each[2] >= THRESHOLD)], names=["doc_id", "content_score", "metadata_score", "score", "kept"])

    return rows.select("doc_id", "x").mapInArrow(releasing(run), "doc_id long, content_score double, metadata_score double, score double, kept boolean")


def query(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    return classify(docs, labels)
