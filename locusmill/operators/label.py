"""External labelling: batches, prompts, an injected labeler, validated answers, evaluation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANSWER = "struct<items: array<struct<id: string, label: string, confidence: string, reason: string>>>"


def todo(names: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    return names.join(labelled.select(key).distinct(), key, "left_anti")


def prompts(chunks: DataFrame, fields: list[str]) -> DataFrame:
    """chunk, n, prompt: a tab-separated line n0, n1, ... per row; a chunk has a fixed size."""
    line = F.concat_ws("\t", F.concat(F.lit("n"), "pos"), *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"])
    return chunks.groupBy("chunk").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("prompt"))


def params(requests: DataFrame, model: str, instructions: str, most_tokens: int = 16_000, effort: str | None = "low") -> DataFrame:
    """requests with `params`: the body of a call as JSON, with the answer's schema; effort is left out where a model has none."""
    string = F.struct(F.lit("string").alias("type"))
    item = F.struct(*[string.alias(k) for k in ("id", "label", "confidence", "reason")])
    schema = F.struct(F.lit("object").alias("type"), F.struct(F.struct(F.lit("array").alias("type"), F.struct(F.lit("object").alias("type"), item.alias("properties")).alias("items")).alias("items")).alias("properties"))
    output = [F.struct(F.lit("json_schema").alias("type"), schema.alias("schema")).alias("format"), *([F.lit(effort).alias("effort")] if effort else [])]
    message = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(F.lit(model).alias("model"), F.lit(most_tokens).alias("max_tokens"), F.lit(instructions).alias("system"), F.array(message).alias("messages"), F.struct(*output).alias("output_config"))
    return requests.withColumn("params", F.to_json(body))


def ask(requests: DataFrame, labeler: Callable[[str], str], attempts: int = 1, fatal: tuple[type[Exception], ...] = (), pause: float = 5.0) -> DataFrame:
    """chunk, answer, error: the labeler is called for each prompt, up to `attempts` times with growing pauses; a failure is recorded, to be sent
    again.  A fatal kind, which no repetition mends (a wrong key, a bad request), ends the job."""

    def run(frames):
        import time

        for f in frames:
            answers, errors = [], []
            for p in f["prompt"]:
                answer = error = None
                for k in range(attempts):
                    try:
                        answer, error = labeler(p), None
                        break
                    except fatal:
                        raise
                    except Exception as e:  # noqa: BLE001 - whatever the service raises
                        error = str(e)
                        if k + 1 < attempts:
                            time.sleep(pause * (k + 1))
                answers.append(answer)
                errors.append(error)
            yield pd.DataFrame({"chunk": f["chunk"], "answer": answers, "error": errors})

    return requests.select("chunk", "prompt").mapInPandas(run, "chunk long, answer string, error string")


def collected(answers: DataFrame, chunks: DataFrame, labels: list[str], confidences: tuple[str, ...] = ("high", "mid", "low")) -> DataFrame:
    """chunks with label, confidence, reason; ids that were not asked and values outside the enumerations are dropped."""
    item = F.explode(F.from_json("answer", ANSWER)["items"]).alias("item")
    a = answers.where(F.col("answer").isNotNull()).select("chunk", item).select("chunk", F.regexp_extract("item.id", r"^n(\d+)$", 1).try_cast("int").alias("pos"), "item.label", "item.confidence", "item.reason")
    return chunks.join(a.where(F.col("label").isin(*labels) & F.col("confidence").isin(*confidences)), ["chunk", "pos"])


def size_estimate(requests: DataFrame) -> DataFrame:
    return requests.agg(F.count("*").alias("requests"), F.sum("n").cast("long").alias("names"), F.sum(F.length("prompt")).cast("long").alias("chars"))


def evaluation(rows: DataFrame, truth: str, a: str, b: str) -> DataFrame:
    """Of two label sets: adopted, correct, agreement, and alike but wrong."""
    def count(c: Column) -> Column:
        return F.count_if(c)

    x, y, t = F.col(a), F.col(b), F.col(truth)
    return rows.agg(F.count("*").alias("n"), count(x.isNotNull()).alias("a_adopted"), count(y.isNotNull()).alias("b_adopted"), count(x == t).alias("a_correct"), count(y == t).alias("b_correct"), count(x == y).alias("same"), count((x == y) & (x != t)).alias("same_wrong"))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float, asked: Column, total: Column, batch: float = 0.5) -> Column:
    """What a run over `total` names costs, from a trial over `asked`."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6 * total / F.greatest(asked, F.lit(1)) * batch
