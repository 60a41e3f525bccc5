"""Answers are collected once, whatever is replayed; places are laid out so that a box skips row groups."""

import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from locusmill.operators import label, order
from locusmill.sources import places
from locusmill.streaming import labels


def made(items):
    return json.dumps({"items": [{"id": i, "label": x, "confidence": "high", "reason": ""} for i, x in items]})


def test_each_answer_counts_once(spark, tmp_path):
    chunks = order.chunked(spark.createDataFrame([(i,) for i in range(8)], "doc_id long"), "doc_id", 2)
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    requests = label.prompts(chunks, ["doc_id"])
    found = labels.Collection(spark, str(tmp_path / "found"), chunks, ["a", "b"])
    assert found.labels().collect() == [] and found.manifest().collect() == []
    found.sent(requests, 0)
    found.sent(requests, 0)
    (tmp_path / "in").mkdir()

    def file(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"chunk": c, "answer": a, "error": e}) + "\n" for c, a, e in rows))

    def state():
        return {r["chunk"]: (r["attempts"], r["state"], r["error"]) for r in found.manifest().collect()}

    def got():
        return sorted((r["doc_id"], r["label"]) for r in found.labels().collect())

    file("1.json", (0, made([("n0", "a"), ("n1", "b")]), None), (0, made([("n0", "b")]), None), (1, None, "busy"), (2, "{oops", None), (77, made([("n0", "a")]), None))

    def run():
        found.collect(str(tmp_path / "in"), str(tmp_path / "checkpoint")).awaitTermination()

    run()
    first = got()
    assert len({d for d, _ in first}) == len(first) >= 1 and state() == {0: (1, "answered", None), 1: (1, "failed", "busy"), 2: (1, "failed", "not readable"), 3: (1, "sent", None)}
    rest = found.pending(requests)
    assert sorted(r["chunk"] for r in rest.collect()) == [1, 2, 3]
    found.sent(rest, 1)
    file("2.json", (0, made([("n0", "a"), ("n1", "a")]), None), (1, made([("n1", "b")]), None), (3, made([("n0", "a")]), None))
    # The batch is done but not committed: the stream starts again from its checkpoint and replays it.
    run()
    done = got()
    commits = sorted((tmp_path / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
        p.unlink(missing_ok=True)
    run()
    assert got() == done == sorted([*first, (3, "b"), (6, "a")])
    assert state() == {0: (1, "answered", None), 1: (2, "answered", None), 2: (2, "failed", "not readable"), 3: (2, "answered", None)}
    # All answers again in a batch of a later number, and a checkpoint that is lost.
    found.add(spark.read.schema("chunk long, answer string, error string").json(str(tmp_path / "in")), 9)
    assert got() == done
    found.collect(str(tmp_path / "in"), str(tmp_path / "other")).awaitTermination()
    assert len(got()) == len({d for d, _ in got()})


def test_failures_are_tried_again_or_end_the_job(spark, tmp_path):
    requests = spark.createDataFrame([(0, "x"), (1, "y")], "chunk long, prompt string")
    log = str(tmp_path / "calls")

    def flaky(prompt):
        with open(f"{log}-{prompt}", "a+") as f:
            f.write(".")
            f.seek(0)
            if prompt == "x" or len(f.read()) < 3:
                raise RuntimeError("busy")
        return "done"

    got = {r["chunk"]: (r["answer"], r["error"]) for r in label.ask(requests.coalesce(1), flaky, attempts=3, pause=0.0).collect()}
    assert got == {0: (None, "busy"), 1: ("done", None)} and len(open(f"{log}-x").read()) == 3

    def wrong(prompt):
        raise PermissionError("key")

    with pytest.raises(Exception, match="key"):
        label.ask(requests, wrong, attempts=3, fatal=(PermissionError,), pause=0.0).collect()
    body = json.loads(label.params(requests, "m", "say", 9).where("chunk = 0").first()["params"])
    assert body["messages"] == [{"role": "user", "content": "x"}] and body["max_tokens"] == 9 and body["output_config"]["effort"] == "low"
    assert "effort" not in json.loads(label.params(requests, "m", "say", effort=None).first()["params"])["output_config"]


def test_a_box_skips_row_groups(spark, tmp_path):
    n, box = 40_000, (10.0, 10.0, 30.0, 25.0)
    x, y = F.col("id") * 7919 % 36000 / 100 - 180, F.col("id") * 104729 % 18000 / 100 - 90
    rows = spark.range(n).select("id", F.when(F.col("id") % 500 > 0, F.struct(x.alias("xmin"), (x + 0.1).alias("xmax"), y.alias("ymin"), (y + 0.1).alias("ymax"))).alias("bbox"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 3).alias("name"))
    places.write(rows, str(tmp_path / "laid"), group_bytes=64 << 10)
    found = places.read(spark, str(tmp_path / "laid"), box)
    plan = found._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and all(f"(bbox.{c}" in plan for c in ("xmin", "xmax", "ymin", "ymax"))
    want = rows.where("bbox.xmin >= 10 and bbox.xmax <= 30 and bbox.ymin >= 10 and bbox.ymax <= 25")
    assert sorted(r["id"] for r in found.select("id").collect()) == sorted(r["id"] for r in want.select("id").collect())
    groups = kept = 0
    for p in (tmp_path / "laid").glob("*.parquet"):
        meta = pq.ParquetFile(p).metadata
        at = {meta.schema.column(k).path: k for k in range(meta.num_columns)}
        for g in range(meta.num_row_groups):
            low, high = {}, {}
            for c in ("xmin", "xmax", "ymin", "ymax"):
                s = meta.row_group(g).column(at[f"bbox.{c}"]).statistics
                low[c], high[c] = s.min, s.max
            groups += 1
            kept += high["xmin"] >= box[0] and low["xmax"] <= box[2] and high["ymin"] >= box[1] and low["ymax"] <= box[3]
    assert groups > 20 and 0 < kept < groups / 4, (kept, groups)
    assert places.curve(F.lit(None).cast("double"), F.lit(1.0)) is not None and spark.range(1).select(places.curve(F.lit(180.0), F.lit(90.0)).alias("c")).first()["c"] == 2**32 - 1
