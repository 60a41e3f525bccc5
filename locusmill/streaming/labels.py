"""Collecting answers once and only once: answer files as a stream, a manifest of what was sent, answered and failed, and what to send again.

Everything lies under one folder: sent/attempt=k (chunk), status/batch=n (chunk, state, error) and labels/batch=n (the accepted rows).  A batch of
the stream overwrites its own folders, so a batch that is replayed after a failure leaves what it left before, and it passes over chunks that an
earlier batch answered, so an answer that arrives twice counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import label

_STATUS = "chunk long, state string, error string, batch int"


class Collection:
    """Chunks (chunk, pos, keys) and what became of them.  A failed or missing chunk is pending until an answer of it is accepted."""

    def __init__(self, spark: SparkSession, root: str, chunks: DataFrame, labels: list[str], confidences: tuple[str, ...] = ("high", "mid", "low")):
        self.spark, self.root, self.chunks, self.allowed, self.confidences = spark, root.rstrip("/"), chunks, labels, confidences

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        return self.spark.createDataFrame([], schema)

    def sent(self, requests: DataFrame, attempt: int) -> None:
        """Note that these requests (chunk, ...) are on their way; noting an attempt again replaces it."""
        requests.select(F.col("chunk").cast("long").alias("chunk")).write.mode("overwrite").parquet(f"{self.root}/sent/attempt={attempt}")

    def add(self, answers: DataFrame, batch: int) -> None:
        """Take in one batch of answers (chunk, answer, error).  Of several answers to a chunk in a batch, one that can be used goes first."""
        before = self._read("status", _STATUS).where((F.col("batch") < batch) & (F.col("state") == "answered")).select("chunk")
        items = F.from_json("answer", label.ANSWER)["items"]
        bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("answer").isNull(), "no answer").when(items.isNull(), "not readable")
        each = answers.join(before, "chunk", "left_anti").withColumn("bad", bad)
        one = each.groupBy("chunk").agg(F.min(F.struct(F.col("bad").isNotNull(), "answer", "bad")).alias("m")).select("chunk", "m.answer", F.col("m.bad").alias("error"))
        known = one.join(self.chunks.select("chunk").distinct(), "chunk", "left_semi")
        good = known.where("error is null").select("chunk", "answer")
        label.collected(good, self.chunks, self.allowed, self.confidences).write.mode("overwrite").parquet(f"{self.root}/labels/batch={batch}")
        state = F.when(F.col("error").isNull(), "answered").otherwise("failed")
        known.select(F.col("chunk").cast("long").alias("chunk"), state.alias("state"), "error").write.mode("overwrite").parquet(f"{self.root}/status/batch={batch}")

    def collect(self, answers: str, checkpoint: str, files: int = 1000) -> StreamingQuery:
        """Take in JSON lines of (chunk, answer, error) as they arrive, `files` at most in a batch; ends when all are read."""
        stream = self.spark.readStream.schema("chunk long, answer string, error string").option("maxFilesPerTrigger", files).json(answers)
        return stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def manifest(self) -> DataFrame:
        """chunk, attempts, state (answered, failed or sent), error (of the last failure): a row per chunk that was sent."""
        sent = self._read("sent", "chunk long, attempt int").groupBy("chunk").agg(F.count_distinct("attempt").alias("attempts"))
        last = self._read("status", _STATUS).groupBy("chunk").agg(F.max_by(F.struct("state", "error"), F.struct(F.col("state") == "answered", "batch")).alias("s"))
        return sent.join(last, "chunk", "left").select("chunk", "attempts", F.coalesce("s.state", F.lit("sent")).alias("state"), "s.error")

    def pending(self, requests: DataFrame) -> DataFrame:
        """The requests whose chunk has no accepted answer: what a next attempt sends."""
        return requests.join(self._read("status", _STATUS).where("state = 'answered'").select("chunk"), "chunk", "left_anti")

    def labels(self) -> DataFrame:
        """The accepted rows, each chunk's from the first batch that answered it, so that a lost checkpoint doubles nothing either."""
        columns = [*self.chunks.columns, "label", "confidence", "reason"]
        kind = {f.name: f.dataType.simpleString() for f in self.chunks.schema.fields}
        rows = self._read("labels", ", ".join(f"`{c}` {kind.get(c, 'string')}" for c in columns) + ", batch int")
        first = self._read("status", _STATUS).where("state = 'answered'").groupBy("chunk").agg(F.min("batch").alias("batch"))
        return rows.join(first, ["chunk", "batch"], "left_semi").select(columns)


def collect_answers(spark: SparkSession, answers: str, chunks: DataFrame, out: str, checkpoint: str, labels: list[str]) -> StreamingQuery:
    """Reads JSON lines of (chunk, answer, error) as they arrive into a collection under `out`; ends when all files are read."""
    return Collection(spark, out, chunks, labels).collect(answers, checkpoint)
