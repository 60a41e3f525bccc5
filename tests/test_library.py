"""Small frames for what the driver's tables do not reach."""

import json
import math

import pytest
from pyspark.sql import functions as F

from locusmill.functions import geo, rules, text
from locusmill.operators import label, link, order, sequential, spatial, stats
from locusmill.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    assert one(spark, text.core_name(F.lit("ＡＢＣ　珈琲 駅前店"))) == "abc珈琲駅前"
    assert one(spark, text.core_name(F.lit("a店"))) == "a店"
    assert one(spark, text.name_score(F.lit("tide"), F.lit("diet"))) == 0.25
    assert one(spark, text.name_score(F.lit("diet"), F.lit("tide"))) == 0.5
    assert one(spark, text.name_score(F.lit("cafe"), F.lit("cafe blue"))) == 0.9
    assert one(spark, text.name_score(F.lit(""), F.lit(""))) == 0.0
    assert one(spark, text.longest_common(F.lit("abcd"), F.lit("xbcy"))) == 2
    assert one(spark, text.romaji(F.lit("カフェ・ラッテ abc"))) == "kafueratte"
    assert [one(spark, text.romaji(F.lit(x))) for x in ("シャトー", "キョク", "カャ", "ッア", "ッー", "ひら")] == ["shato", "kyoku", "kya", "aa", "", ""]
    assert [one(spark, text.round_half_even(F.lit(x), n)) for x, n in ((2.675, 2), (0.12345, 4), (2.5, 0))] == [2.67, 0.1235, 2.0]
    assert tuple(one(spark, text.town_and_chome(F.lit("本町二十三丁目")))) == ("本町", 23) and tuple(one(spark, text.town_and_chome(F.lit("本町")))) == ("本町", 0)
    assert one(spark, text.nfkc(F.lit(None).cast("string"))) is None
    assert [one(spark, text.kanji_number(F.lit(s))) for s in ("十", "二十三", "七", "9")] == [10, 23, 7, 9]


def test_tiers(spark):
    def t(dist, a, b):
        args = [F.lit(float(dist)), text.name_score(F.lit(a), F.lit(b)), F.lit(a), F.lit(b), text.longest_common(F.lit(a), F.lit(b)), text.latin_only(F.lit(a)), text.latin_only(F.lit(b))]
        return one(spark, text.tier(*args))

    assert t(650, "blue cafe", "blue cafe") == "a"
    assert t(701, "blue cafe", "blue cafe") is None
    assert t(150, "blue", "blue cafe") == "b"
    assert t(25, "xxblue", "yyblue") == "d" and t(25, "xxblu", "yyblu") is None and t(31, "xxblue", "yyblue") is None


def test_tiered_matches_and_routing(spark):
    """Reasons expected from the rules: same name far away, contained near by, kana for Latin letters; the nearest with a reason wins."""
    step = 1 / geo.M_PER_DEG
    left = spark.createDataFrame([(1, "blue garden", 35.0, 139.0), (2, "harbor", 35.1, 139.0), (3, "mirano bar", 35.2, 139.0), (4, "lonely", 35.3, 139.0)], "row_id long, core string, lat double, lng double")
    right = [(10, "blue garden", "", 35.0 + 600 * step, 139.0), (11, "harbor light", "", 35.1 + 150 * step, 139.0), (12, "harbors", "", 35.1 + 190 * step, 139.0), (13, "喫茶", "ミラノ", 35.2 + 20 * step, 139.0), (14, "other", "", 35.3 + 20 * step, 139.0)]
    right = spark.createDataFrame(right, "other_id long, other_core string, other_kana string, lat double, lng double")
    found = link.tiered_nearest(left, right, [], [])
    assert sorted((r["row_id"], r["other_id"], r["reason"]) for r in found.collect()) == [(1, 10, "a"), (2, 11, "b"), (3, 13, "e")]
    status = link.routed(left, found, F.col("row_id") < 10, F.col("core") == "lonely").collect()
    assert {r["row_id"]: r["status"] for r in status} == {1: "matched", 2: "matched", 3: "matched", 4: "uncertain"}


def test_fuzzy_nearest_is_brute_force(spark):
    import difflib

    a = [(i, n, 35 + i / 3000, 139.0) for i, n in enumerate(("tide", "diet", "cafe blue", "x", "blue"))]
    b = [(i, n, 35 + i / 4000, 139.0002) for i, n in enumerate(("diet", "tides", "blue", "cafe", "tide", "blues"))]

    def score(x, y):
        short, long = sorted((x, y), key=len)
        return 1.0 if x == y else 0.9 if len(short) >= 3 and short in long else difflib.SequenceMatcher(None, x, y).ratio()

    want = {}
    for i, x, la, lo in a:
        near = []
        for j, y, lb, lp in b:
            h = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lp - lo) / 2) ** 2
            m = 2 * geo.EARTH_M * math.asin(math.sqrt(h))
            if m <= 120 and score(x, y) >= 0.6:
                near.append((-score(x, y), round(m, 3), j))
        if near:
            want[i] = min(near)[2]
    got = link.fuzzy_nearest(spark.createDataFrame(a, "row_id long, core string, lat double, lng double"), spark.createDataFrame(b, "other_id long, other_core string, lat double, lng double"), 120.0)
    assert {r["row_id"]: r["other_id"] for r in got.collect()} == want and len(want) >= 3


def test_notes_census_and_stations(spark, tmp_path):
    rows, notes = spark.createDataFrame([("a",), ("b",)], "name string"), spark.createDataFrame([("a", "x"), ("z", "y")], "name string, note string")
    with pytest.raises(ValueError, match="z"):
        stats.with_notes(rows, notes, "name")
    assert {tuple(r) for r in stats.with_notes(rows, notes.where("name = 'a'"), "name").collect()} == {("a", "x"), ("b", None)}
    cells = spark.createDataFrame([("131a", "761_x", 3), ("131a", "762_y", 4), ("999", "761_x", 9), ("131a", "761x", 5)], "area string, item string, n long")
    assert files.census_cells(cells, "131", ["761", "762"], 1).count() == 2
    with pytest.raises(ValueError):
        files.census_cells(cells, "131", ["761", "762"], 2)
    (tmp_path / "s.csv").write_text('key,name,lat,lng,passengers\na,"x ""y""",35,139,\nb,z,35,139,12\n')
    assert [(r["name"], r["passengers"]) for r in files.station_list(spark, str(tmp_path / "s.csv"), []).orderBy("key").collect()] == [('x "y"', None), ("z", 12)]
    assert files.station_list(spark, None, [("k", "n", 1.0, 2.0, None)]).count() == 1


def test_answers_as_a_stream(spark, tmp_path):
    """Answers that arrive in two files; an id that was not asked and a label out of the list are dropped; what is left can be asked again."""
    from locusmill.streaming import labels as stream

    chunks = order.chunked(spark.createDataFrame([(i,) for i in range(5)], "doc_id long"), "doc_id", 3)
    chunks.write.parquet(str(tmp_path / "chunks"))
    chunks = spark.read.parquet(str(tmp_path / "chunks"))
    (tmp_path / "in").mkdir()

    def answer(name, chunk, items):
        made = json.dumps({"items": [{"id": i, "label": x, "confidence": "high", "reason": ""} for i, x in items]})
        (tmp_path / "in" / name).write_text(json.dumps({"chunk": chunk, "answer": made, "error": None}) + "\n")

    def run():
        stream.collect_answers(spark, str(tmp_path / "in"), chunks, str(tmp_path / "out"), str(tmp_path / "checkpoint"), ["a", "b"]).awaitTermination()
        return sorted(r["doc_id"] for r in found.labels().collect())

    found = stream.Collection(spark, str(tmp_path / "out"), chunks, ["a", "b"])

    answer("1.json", 0, [("n0", "a"), ("n2", "c"), ("n9", "a")])
    assert run() == [0]
    answer("2.json", 1, [("n1", "b")])
    assert run() == [0, 4]
    rest = label.todo(chunks.select("doc_id"), found.labels(), "doc_id")
    assert sorted(r["doc_id"] for r in rest.collect()) == [1, 2, 3]


def test_mesh_and_coverage(spark):
    b = one(spark, geo.mesh_bounds(F.lit("53394611")))
    assert math.isclose(b["lat"], 53 / 1.5 + 4 / 12 + 1 / 120) and math.isclose(b["dlat"], 1 / 120)
    for r, want in ((1.0, 0.0), (1e6, 1.0)):
        assert one(spark, geo.coverage(F.lit(35.0), F.lit(139.0), F.lit(0.01), F.lit(0.01), F.lit(35.005), F.lit(139.005), F.lit(r))) == want


def test_polygon(spark):
    ring = "array(" + ", ".join(f"named_struct('x', {x}d, 'y', {y}d)" for x, y in ((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))) + ")"
    assert one(spark, geo.inside(F.expr(ring), F.lit(1.0), F.lit(3.0))) is True
    assert one(spark, geo.inside(F.expr(ring), F.lit(5.0), F.lit(3.0))) is False
    assert one(spark, geo.ring_area(F.expr(ring))) == 16.0
    assert one(spark, geo.edge_distance(F.expr(ring), F.lit(1.0), F.lit(2.0), 1.0, 1.0)) == 1.0


def test_cell_join_is_the_theta_join(spark):
    a = spark.range(40).select(F.col("id").alias("station"), (35 + F.rand(1) / 20).alias("lat"), (139 + F.rand(2) / 20).alias("lng"))
    b = spark.range(300).select("id", (35 + F.rand(3) / 20).alias("lat"), (139 + F.rand(4) / 20).alias("lng"))
    a, b = a.toPandas(), b.toPandas()
    got = {(r["station"], r["id"]) for r in spatial.cell_pairs(spark.createDataFrame(a), spark.createDataFrame(b), 700.0).collect()}

    def dist(p, q):
        x, y = math.radians(p.lat), math.radians(q.lat)
        h = math.sin((y - x) / 2) ** 2 + math.cos(x) * math.cos(y) * math.sin(math.radians(q.lng - p.lng) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert got == {(p.station, q.id) for p in a.itertuples() for q in b.itertuples() if dist(p, q) <= 700}


def test_shares_sum_to_one_and_quotients_weigh_to_one(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (1, "b", "z"), (1, "unknown", "unknown"), (2, "a", "x")], "s int, major string, mid string")
    t = stats.shares(stats.tally(rows, ["s"]), ["s"])
    got = t.groupBy("s", "level").agg(F.sum("share").alias("x")).collect()
    assert all(math.isclose(r["x"], 1) for r in got)
    base = stats.shares(stats.tally(rows, []), [])
    lq = stats.quotients(t.where("s = 2"), base).where("level = 'mid' and mid = 'x'").first()
    assert math.isclose(lq["lq"], 2.0)


def test_weights_formula(spark):
    counts = spark.createDataFrame([("w", "a", 10), ("w", "b", 0), ("w", "unknown", 10)], "ward string, code string, n long")
    census = spark.createDataFrame([("w", "a", 30), ("w", "b", 10), ("v", "a", 5)], "ward string, code string, n long")
    got = {(r["ward"], r["code"]): r["weight"] for r in stats.weights(counts, census).collect()}
    assert got == {("w", "a"): 1.5, ("w", "b"): 2.0, ("w", "all"): 2.0, ("v", "a"): 0.0, ("v", "all"): 0.0}
    rows = spark.createDataFrame([("w", "unknown"), ("x", "a")], "ward string, code string")
    assert {r["ward"]: r["weight"] for r in stats.weighted(rows, stats.weights(counts, census)).collect()} == {"w": 2.0, "x": 1.0}


def test_link_edge_cases(spark):
    rows = spark.createDataFrame([(1, 35.0, 139.0, "cafe", "a"), (2, 35.0, 139.0001, "cafe", "unresolved"), (3, 35.0, 139.0002, "cafe", "b"), (4, 35.0, 139.0, "", "a")], "row_id long, lat double, lng double, core string, genre string")
    pairs = link.near_pairs(rows)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (2, 3)}
    comp = link.components(rows, pairs)
    assert {r[0]: r[1] for r in comp.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    rep = link.representatives(rows.join(comp, "row_id")).where("row_id = 2").first()
    assert (rep["component_genre"], rep["cluster"]) == ("a", 1)
    assert {r[0]: r[1] for r in link.components(rows, pairs.limit(0)).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}


def test_order_dependent_groups(spark):
    g = spark.createDataFrame([("n", 0, 35.0, 139.0, 1), ("n", 1, 35.003, 139.0, 1), ("n", 2, 35.2, 139.0, 1)], "name string, ord long, lat double, lng double, n long")
    assert {r["ord"]: r["into"] for r in sequential.merged_groups(g).collect()} == {0: 0, 1: 0, 2: 2}
    r = spark.createDataFrame([("z", 1, "blue", 35.0, 139.0), ("z", 2, "blue cafe", 35.0, 139.0001), ("z", 3, "red", 35.0, 139.0)], "block string, row_id long, core string, lat double, lng double")
    assert {x["row_id"]: x["dup_of"] for x in sequential.greedy_duplicates(r).collect()} == {1: None, 2: 1, 3: None}


def test_rules(spark):
    df = spark.createDataFrame([({"cuisine": "x;Ramen"},), ({"amenity": "bar"},), ({"shop": "deli"},), ({"a": "b"},)], "tags map<string, string>")
    got = [r[0] for r in df.select(rules.tag_genre(F.col("tags"), {"ramen": "noodles"}, {"bar": "bar"}, {"deli": "shop"})).collect()]
    assert got == ["noodles", "bar", "shop", ""]
    assert one(spark, rules.line_name(F.lit("o"), F.lit("3号線東西線(支)"), {}, {"o": "O "})) == "O 東西線"
    assert one(spark, rules.line_kind(F.lit("JR x"), F.lit(""), ["m"], "^JR")) == "jr"
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1)], "id int, v string, ord int")
    assert [r["v"] for r in rules.last_wins(rows, ["id"], "ord").collect()] == ["b"]
    assert one(spark, rules.fused([("x", F.lit("g"))], F.lit(None).cast("double")))["method"] == "low_confidence"


def test_labelling(spark):
    rows = spark.createDataFrame([(i, f"name{i}") for i in range(7)], "id long, name string")
    chunks = order.chunked(rows, "id", 3)

    def labeler(prompt):
        if "name6" in prompt:
            raise RuntimeError("busy")
        return json.dumps({"items": [{"id": "n0", "label": "a", "confidence": "high", "reason": "r"}, {"id": "n9", "label": "a", "confidence": "high", "reason": ""}, {"id": "n1", "label": "zzz", "confidence": "high", "reason": ""}]})

    answers = label.ask(label.prompts(chunks, ["name"]), labeler).cache()
    assert {r["id"] for r in label.collected(answers, chunks, ["a"]).collect()} == {0, 3}
    assert answers.where("error is not null").count() == 1
    assert label.size_estimate(label.prompts(chunks, ["name"])).first()["names"] == 7


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("KEY_CODE,T1,T2\n,total,男\n533946,1,2\nx,9,9\n".encode("cp932"))
    (tmp_path / "b.csv").write_bytes("﻿KEY_CODE,T1\n,total\n533946,5\n".encode())
    got = {(r["code"], r["col"]): (r["label"], r["value"]) for r in files.two_header(spark, [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"]).collect()}
    assert got == {("533946", "T1"): ("total", "5"), ("533946", "T2"): ("男", "2")}
    assert files.resolve("p=total,q=T2+otal", {"T1": "total", "T2": "men"}) == {"p": ["T1"], "q": ["T2", "T1"]}
    with pytest.raises(KeyError):
        files.resolve("x=none", {"T1": "total"})
    (tmp_path / "m.json").write_text(json.dumps({"elements": [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"name": "x"}}, {"type": "way", "id": 2, "center": {"lat": 3.0, "lon": 4.0}, "tags": {"brand": "b"}}, {"type": "node", "id": 3, "lat": 1.0, "lon": 1.0, "tags": {}}]}))
    assert [(r["id"], r["lat"], r["names"]) for r in files.map_elements(spark, f"{tmp_path}/m.json").orderBy("id").collect()] == [(1, 1.0, ["x"]), (2, 3.0, ["b"])]
    (tmp_path / "g.json").write_text(json.dumps({"features": [{"properties": {"n": "a"}, "geometry": {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}}]}))
    r = files.geojson(spark, f"{tmp_path}/g.json", "n: string").first()
    assert (r["n"], [tuple(v) for v in r["vertices"]]) == ("a", [(1.0, 2.0), (3.0, 4.0)])
    assert files.optional(spark, f"{tmp_path}/none.csv", "a int").count() == 0
    (tmp_path / "q.csv").write_text('id,j\n1,"{""a"": 1}"\n')
    assert files.csv(spark, f"{tmp_path}/q.csv", "id int, j string").first()["j"] == '{"a": 1}'
    df = spark.createDataFrame([(1, "x", 3)], "a int, b string, c int")
    files.write_csv(df, f"{tmp_path}/out", ["b", "a"], mark=True)
    assert next((tmp_path / "out").glob("part-*")).read_bytes().startswith(b"\xef\xbb\xbfb,a") or next((tmp_path / "out").glob("part-*")).read_bytes()[:3] == b"\xef\xbb\xbf"
    assert files.newest(spark, f"{tmp_path}/*.csv").endswith("q.csv")
    assert json.loads(files.column_json(df, "a", ["b", "c"]).first()["json"]) == {"b": ["x"], "c": [3]}
    assert spark.createDataFrame([('{"data": [{"a": 1}]}',), ('[{"a": 2}]',), ("{}",)], "r string").select(files.items(F.col("r"), "struct<a: int>").alias("i")).select(F.explode("i").alias("x")).select("x.a").count() == 2
