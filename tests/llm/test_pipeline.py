"""The whole pipeline on an awkward table against plain loops, and what near-dedup links by similarity."""

import re
import zlib

import numpy as np
import pytest

pytest.importorskip("locusmill.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
from locusmill.llm import neardup, queries  # noqa: E402

RNG = np.random.default_rng(31)
WORDS = ["".join(RNG.choice(list("etaoinshrdlu"), RNG.integers(2, 9))) for _ in range(400)]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, row string, score string, hit string, digest string, spans string, ids string"


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


def grams(t):
    w = t.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def similar(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def write(spark, folder, docs, labels, items):
    extra = [f"x{k}" for k in range(7)]
    rows = [(i, t, "en" if k % 7 else None, f"s{k % 4}" if k % 11 else None, None if t is None else len(t), *extra) for k, (i, t) in enumerate(docs)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_pipeline_against_plain_loops(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, copies, benchmark passages, secrets and clashing columns through all five stages."""
    from tokenizers import Tokenizer

    docs = [(i, " ".join(w.upper() + "!!" for w in prose(90).split()) if i % 5 == 0 else prose(int(RNG.integers(60, 150)))) for i in range(400)]
    text = dict(docs)
    near = text[2].split()
    near[len(near) // 2] = "changed"
    item = prose(40)
    docs += [(401, text[1]), (402, text[1]), (403, " ".join(near)), (404, f"{prose(50)} {item} {prose(50)}"), (405, f"{prose(60)} {'0a1b' * 10} {prose(30)}"), (406, prose(6000))]
    docs += [(407, None), (408, ""), (None, prose(100)), (3, text[3]), (3, text[3])]
    write(spark, tmp_path, docs, [(i, int(i % 5 > 0), 0) for i in range(0, 300)] + [(None, 1, 0), (4, None, None)], [(1, item), (2, prose(25)), (3, None), (4, "")])

    good = [(i, t) for i, t in docs if t and not t.endswith("!!")]
    kept, sets = [], []
    for i, t in sorted(good, key=lambda d: (d[0] is None, d[0])):  # no chains here: every class is its first text's neighbours
        g = grams(t)
        if not any(similar(g, s) for s in sets):
            kept.append((i, t))
            sets.append(g)
    wanted, size = grams(item), len(item.split())
    kept = [(i, t) for i, t in kept if not any(similar(grams(" ".join(t.split()[k : k + size])), wanted) for k in range(max(len(t.split()) - size, 0) + 1))]
    kept = {i: re.sub("[0-9a-f]{32,}", "[secret]", t) for i, t in kept}
    assert {401, 402, 403, 404}.isdisjoint(kept) and {1, 2, 3, 405, 406, None} <= set(kept) and "[secret]" in kept[405]

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert ids - {407} == set(kept)  # of the texts without words at most the first stays, as the classifier likes
    tok = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    by, sequences = {}, {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, pieces in by.items():
        want, at = np.array(tok.encode(kept.get(i, ""), add_special_tokens=False).ids + [1], "<u4"), 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(want)
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    """No documents, no labels, no items: no rows, and all stages but the last return the columns of documents."""
    write(spark, tmp_path, [], [], [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_links_by_similarity(spark):
    """Pairs of texts with more and more changed words: all at 0.8 or more are one class, none below."""
    pairs, rows = [], []
    for k in range(240):
        a = prose(int(RNG.integers(40, 300))).split()
        b = list(a)
        for c in RNG.integers(0, len(a), int(RNG.integers(0, 1 + len(a) // 25))):
            b[c] = f"changed{k}"
        x, y = grams(" ".join(a)), grams(" ".join(b))
        pairs.append(len(x & y) / len(x | y))
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    got = {r["doc_id"]: r["class_id"] for r in neardup.query(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    share = {}
    for k, s in enumerate(pairs):
        share.setdefault(min(int(s * 10), 9), []).append(got[2 * k] == got[2 * k + 1])
    assert all(len(share[b]) >= 10 for b in (7, 8, 9)), {b: len(v) for b, v in share.items()}
    assert all(all(v) if b >= 8 else not any(v) for b, v in share.items()), {b: np.mean(v) for b, v in share.items()}
