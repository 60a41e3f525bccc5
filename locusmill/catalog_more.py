"""Further queries with their SQL: predicates, joins, evidence, roll-ups, orders and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .catalog import _ALL, _NEAR, _PAIRS, _SPOT, H, S, V, _base, _counts, _every_radius, _lq, _stub, _tally, left_anti_todo, query
from .functions import geo, rules, text
from .operators import chains, cover, label, link, order, sequential, spatial, stats
from .plans import driver as d
from .scratch import Scratch
from .sources import files, places
from .streaming import labels

#: part with nested fields as a place source has them: a list of levels that may be missing, hold null or be empty, and a list of sources.
_NESTED = """nested AS (SELECT p_partkey AS id, p_type AS basic, CASE p_partkey % 5 WHEN 0 THEN ['food', p_brand] WHEN 1 THEN NULL WHEN 2 THEN [NULL] WHEN 3 THEN ['shop'] ELSE [] END AS hierarchy,
CASE WHEN p_partkey % 3 > 0 THEN p_name END AS name, CASE WHEN p_partkey % 4 > 0 THEN p_brand END AS freeform, p_brand AS brand, 'set' || CAST(p_partkey % 3 AS VARCHAR) AS d1, 'set' || CAST(p_partkey % 2 AS VARCHAR) AS d2 FROM part)"""


def _nested(spark, sf):
    p = d.table(spark, sf, "part")
    none = F.lit(None).cast("array<string>")
    hierarchy = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("food"), F.col("p_brand"))).when(F.col("p_partkey") % 5 == 1, none).when(F.col("p_partkey") % 5 == 2, F.array(F.lit(None).cast("string"))).when(F.col("p_partkey") % 5 == 3, F.array(F.lit("shop"))).otherwise(F.array().cast("array<string>"))
    names = F.when(F.col("p_partkey") % 3 > 0, F.struct(F.col("p_name").alias("primary")))
    addresses = F.when(F.col("p_partkey") % 4 > 0, F.array(F.struct(F.col("p_brand").alias("freeform"))))
    sources = F.array(*[F.struct(F.concat(F.lit("set"), (F.col("p_partkey") % n).cast("string")).alias("dataset"), (F.col("p_partkey") % n).alias("license")) for n in (3, 2)])
    return p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("basic"), hierarchy.alias("hierarchy"), names.alias("names"), addresses.alias("addresses"), sources.alias("sources"), "p_brand")


@query(f"WITH {_NESTED} SELECT id, coalesce(hierarchy[1] = 'food' OR (hierarchy IS NULL AND basic IN ('LARGE', 'SMALL')), false) AS by_list, coalesce(hierarchy[1] = 'food' OR (hierarchy[1] IS NULL AND basic IN ('LARGE', 'SMALL')), false) AS by_first FROM nested")
def taxonomy_predicate(spark, sf):
    n, basics = _nested(spark, sf), ["LARGE", "SMALL"]
    a, b = (f(F.col("hierarchy"), F.col("basic"), "food", basics) for f in (rules.in_taxonomy, rules.in_taxonomy_first))
    return n.select("id", F.coalesce(a, F.lit(False)).alias("by_list"), b.alias("by_first"))


@query(f"WITH {_NESTED} SELECT id, coalesce(name, '') AS name, coalesce(freeform, '') AS address, coalesce(array_to_string(hierarchy, '|'), '') AS levels, CASE WHEN d1 <= d2 THEN CASE WHEN d1 = d2 THEN d1 ELSE d1 || '|' || d2 END ELSE d2 || '|' || d1 END AS datasets, CASE WHEN id % 3 > 0 AND id % 2 > 0 AND d1 <> d2 THEN least(d1, d2) || '|' || greatest(d1, d2) WHEN id % 3 > 0 THEN d1 WHEN id % 2 > 0 THEN d2 ELSE '' END AS licensed FROM nested")
def flat_records(spark, sf):
    kept = rules.distinct_field(F.col("sources"), "dataset", lambda s: s["license"] > 0)
    return _nested(spark, sf).select("id", F.coalesce("names.primary", F.lit("")).alias("name"), F.coalesce(F.get("addresses", F.lit(0))["freeform"], F.lit("")).alias("address"), F.coalesce(F.array_join("hierarchy", "|"), F.lit("")).alias("levels"), F.array_join(rules.distinct_field(F.col("sources"), "dataset"), "|").alias("datasets"), F.array_join(kept, "|").alias("licensed"))


@query("SELECT p_partkey AS id FROM part WHERE contains(p_name, 'gear') OR contains(p_brand, 'gear') OR contains(p_name, '#1') OR contains(p_brand, '#1')")
def attribution_filter(spark, sf):
    return d.table(spark, sf, "part").where(rules.attributed(F.array("p_name", "p_brand"), ["gear", "#1"])).select(F.col("p_partkey").alias("id"))


@query("SELECT event_id, value FROM events WHERE value >= 50 AND event_type = 'click'")
def pushed_scan(spark, sf):
    return d.table(spark, sf, "events").where((F.col("value") >= 50) & (F.col("event_type") == "click")).select("event_id", "value")


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1")
def parquet_relation(spark, sf):
    return spark.sql(f"SELECT l_returnflag, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM parquet.`{sf}/lineitem.parquet` WHERE l_discount >= 0.05D GROUP BY 1")


@query("SELECT column_name AS name, column_index AS ord FROM (VALUES ('p_partkey', 0), ('p_name', 1), ('p_brand', 2), ('p_type', 3), ('p_size', 4), ('p_retailprice', 5)) t(column_name, column_index)")
def inspect_columns(spark, sf):
    return files.inspect(d.table(spark, sf, "part")).select("name", "ord")


@query("SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k = 1")
def first_of_label(spark, sf):
    return link.first_wins(d.table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], [F.col("vec_id")])


_CLUSTER = f"WITH RECURSIVE {V}, {_NEAR}, e2 AS (SELECT a, b FROM e JOIN venues x ON x.id = a JOIN venues y ON y.id = b WHERE x.label <> 'excluded' AND y.label <> 'excluded'), s AS (SELECT a AS x, b AS y FROM e2 UNION SELECT b, a FROM e2), r(x, y) AS (SELECT id, id FROM venues WHERE label <> 'excluded' UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x), c AS (SELECT x, min(y) AS component FROM r GROUP BY x), o AS (SELECT c.*, row_number() OVER (PARTITION BY component ORDER BY genre = 'unresolved', x) AS k FROM c JOIN b ON b.id = c.x), f AS (SELECT o.x, g.x AS cluster FROM o JOIN o g ON g.component = o.component AND g.k = 1) "


def _near_rows(spark, sf):
    return d.venues(spark, sf).select(F.col("id").alias("row_id"), "lat", "lng", F.split("name", " ")[1].alias("core"), F.col("label").alias("genre"))


@query(_CLUSTER + "SELECT venues.id AS row_id, coalesce(cluster, -1) AS cluster FROM venues LEFT JOIN f ON f.x = venues.id")
def venue_clusters(spark, sf):
    return link.clusters(_near_rows(spark, sf), lambda rows: link.near_components(rows, 400.0, 0.01))


@query(_CLUSTER + "SELECT x AS row_id FROM f WHERE x = cluster")
def representative_rows(spark, sf):
    return venue_clusters(spark, sf).where("cluster = row_id").select("row_id")


@query(f"WITH {V} SELECT id AS row_id, CASE WHEN label = 'excluded' THEN -1 ELSE id END AS cluster FROM venues")
def dedupe_off(spark, sf):
    return link.clusters(_near_rows(spark, sf), None, on=False)


_BOX = (139.7, 35.65, 139.75, 35.7)


@query(f"""WITH l AS (SELECT a.*, b.lng AS x2, b.lat AS y2 FROM (SELECT s_suppkey AS id, {d.PLACE.format(k='s_suppkey*37+11')} FROM supplier) a JOIN (SELECT s_suppkey AS id, {d.PLACE.format(k='s_suppkey*13+5')} FROM supplier) b USING (id)),
t AS (SELECT id, lng, lat, x2 - lng AS dx, y2 - lat AS dy FROM l),
u AS (SELECT id, CASE WHEN dx = 0 THEN lng BETWEEN 139.7e0 AND 139.75e0 ELSE true END AND CASE WHEN dy = 0 THEN lat BETWEEN 35.65e0 AND 35.7e0 ELSE true END AS slab,
  CASE WHEN dx = 0 THEN 0 ELSE least((139.7e0 - lng)/dx, (139.75e0 - lng)/dx) END AS ex, CASE WHEN dx = 0 THEN 1 ELSE greatest((139.7e0 - lng)/dx, (139.75e0 - lng)/dx) END AS lx,
  CASE WHEN dy = 0 THEN 0 ELSE least((35.65e0 - lat)/dy, (35.7e0 - lat)/dy) END AS ey, CASE WHEN dy = 0 THEN 1 ELSE greatest((35.65e0 - lat)/dy, (35.7e0 - lat)/dy) END AS ly FROM t)
SELECT id FROM u WHERE slab AND greatest(0e0, ex, ey) <= least(1e0, lx, ly)""")
def lines_in_box(spark, sf):
    s = d.table(spark, sf, "supplier")
    ends = [F.struct(x.alias("x"), y.alias("y")) for y, x in (d.place(F.col("s_suppkey") * a + b) for a, b in ((37, 11), (13, 5)))]
    return s.select(F.col("s_suppkey").alias("id"), F.array(*ends).alias("line")).where(geo.line_crosses_box(F.col("line"), _BOX)).select("id")


_CODE = "'1' || CAST(2 + c_custkey % 3 AS VARCHAR) || lpad(CAST(90 + c_custkey % 50 AS VARCHAR), 3, '0')"


@query(f"SELECT c_custkey, {_CODE} AS code FROM customer WHERE ({_CODE})[1:2] = '13' AND CAST(({_CODE})[3:5] AS INT) BETWEEN 101 AND 123")
def admin_codes(spark, sf):
    k = F.col("c_custkey")
    code = F.concat(F.lit("1"), (2 + k % 3).cast("string"), F.lpad((90 + k % 50).cast("string"), 3, "0"))
    c = d.table(spark, sf, "customer").select("c_custkey", code.alias("code"))
    return c.where((F.substring("code", 1, 2) == "13") & F.substring("code", 3, 3).try_cast("int").between(101, 123))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def history_filter(spark, sf):
    return d.table(spark, sf, "orders").where((F.col("o_orderstatus") != "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey")


@query(f"WITH {V} SELECT id FROM venues WHERE (lng > 139.65 AND lng < 139.75 AND lat > 35.65 AND lat < 35.75) OR (lng > 139.70001 AND lng < 139.82 AND lat > 35.62 AND lat < 35.78001)")
def point_in_union(spark, sf):
    areas = [(spatial.open_box(139.65, 35.65, 139.75, 35.75),), (spatial.open_box(139.70001, 35.62, 139.82, 35.78001),)]
    return spatial.in_union(d.venues(spark, sf).select("id", "lat", "lng"), spark.createDataFrame(areas, "ring array<struct<x: double, y: double>>")).select("id")


_FUZZY = f"""a AS (SELECT c_custkey AS row_id, split_part(p_name, ' ', 1) AS core, {d.PLACE.format(k='c_custkey*3')} FROM customer JOIN part ON p_partkey = c_custkey),
b AS (SELECT p_partkey AS other_id, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) ELSE replace(p_name, ' ', '') END AS other_core, {d.PLACE.format(k='p_partkey')} FROM part),
m AS (SELECT row_id, other_id, CASE WHEN core = other_core THEN 1e0 WHEN (length(core) <= length(other_core) AND contains(other_core, core) AND length(core) >= 3) OR (length(core) > length(other_core) AND contains(core, other_core) AND length(other_core) >= 3) THEN 0.9e0 END AS score, round({H('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 3) AS dist_m FROM a, b WHERE {H('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 1000)"""


@query(f"WITH {_FUZZY} SELECT row_id, other_id, score, dist_m FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, dist_m, other_id) AS k FROM m WHERE score >= 0.9) WHERE k = 1")
def fuzzy_nearest(spark, sf):
    p = d.table(spark, sf, "part")
    first = F.split("p_name", " ")[0]
    a = d.table(spark, sf, "customer").join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("row_id"), first.alias("core"), *d.place(F.col("c_custkey") * 3))
    b = p.select(F.col("p_partkey").alias("other_id"), F.when(F.col("p_partkey") % 2 == 0, first).otherwise(F.replace("p_name", F.lit(" "), F.lit(""))).alias("other_core"), *d.place(F.col("p_partkey")))
    return link.fuzzy_nearest(a, b, 1000.0, 0.9)


_SCORES = f"""ca AS (SELECT c_custkey AS row_id, split_part(p_name, ' ', 1) AS core, {d.PLACE.format(k='c_custkey*3')} FROM customer JOIN part ON p_partkey = c_custkey),
cb AS (SELECT p_partkey AS other_id, reverse(split_part(p_name, ' ', 2)) || CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1)[2:] ELSE split_part(p_name, ' ', 1)[1:3] END AS other_core, {d.PLACE.format(k='p_partkey')} FROM part),
near AS MATERIALIZED (SELECT row_id, other_id, core, other_core, round({H('ca.lat', 'ca.lng', 'cb.lat', 'cb.lng')}, 3) AS dist_m FROM ca, cb WHERE {H('ca.lat', 'ca.lng', 'cb.lat', 'cb.lng')} <= 1000),
names AS (SELECT DISTINCT core AS a, other_core AS b FROM near),
holds AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0e0 WHEN a = b THEN 1e0 WHEN (length(a) <= length(b) AND contains(b, a) AND length(a) >= 3) OR (length(a) > length(b) AND contains(a, b) AND length(b) >= 3) THEN 0.9e0 END AS known, 2e0 * list_sum([least(len(string_split(a, c)), len(string_split(b, c))) - 1 FOR c IN list_distinct(string_split(a, ''))]) / (length(a) + length(b)) AS bound FROM names)"""
_MATCH = "list_sort(flatten(flatten([[[{'k': k, 'i': -i, 'j': -j} FOR k IN range(1, least(ah - i, bh - j) + 1) IF a[i + 1:i + k] = b[j + 1:j + k]] FOR j IN range(bl, bh)] FOR i IN range(al, ah)])), 'DESC')[1]"
#: Longest matching blocks as a recursion: the longest common run of a piece, of these the first, then the pieces before and behind it.
_RATIO = f"""blocks AS (SELECT a, b, {_MATCH} AS m, al, ah, bl, bh FROM (SELECT a, b, CAST(0 AS BIGINT) AS al, length(a) AS ah, CAST(0 AS BIGINT) AS bl, length(b) AS bh FROM holds WHERE known IS NULL)
UNION ALL SELECT a, b, {_MATCH}, al, ah, bl, bh FROM (SELECT a, b, unnest([{{'al': al, 'ah': -m.i, 'bl': bl, 'bh': -m.j}}, {{'al': m.k - m.i, 'ah': ah, 'bl': m.k - m.j, 'bh': bh}}], recursive := true) FROM blocks WHERE m.k > 0) WHERE al < ah AND bl < bh),
scores AS (SELECT a, b, coalesce(known, 2e0 * (SELECT coalesce(sum(m.k), 0) FROM blocks x WHERE x.a = h.a AND x.b = h.b) / (length(a) + length(b))) AS score FROM holds h)"""


def _named(spark, sf):
    p = d.table(spark, sf, "part")
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    a = d.table(spark, sf, "customer").join(p, F.col("p_partkey") == F.col("c_custkey")).select(F.col("c_custkey").alias("row_id"), first.alias("core"), *d.place(F.col("c_custkey") * 3))
    other = F.concat(F.reverse(second), F.when(F.col("p_partkey") % 3 == 0, F.expr("substring(split(p_name, ' ')[0], 2)")).otherwise(F.substring(first, 1, 3)))
    return a, p.select(F.col("p_partkey").alias("other_id"), other.alias("other_core"), *d.place(F.col("p_partkey")))


@query(f"WITH RECURSIVE {_SCORES}, {_RATIO} SELECT row_id, other_id, score, dist_m FROM (SELECT row_id, other_id, score, dist_m, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, dist_m, other_id) AS k FROM near JOIN scores ON a = core AND b = other_core WHERE score >= 0.4) WHERE k = 1")
def scored_nearest(spark, sf):
    """Names that need the ratio: no pair is decided by containment alone."""
    return link.fuzzy_nearest(*_named(spark, sf), 1000.0, 0.4)


@query(f"WITH {_SCORES} SELECT count(*) AS near, count(*) FILTER (coalesce(known, 0) >= 0.4) AS known, count(*) FILTER (known IS NULL AND bound >= 0.4) AS verified FROM near JOIN holds ON a = core AND b = other_core")
def name_filter(spark, sf):
    """How many pairs within reach the bound leaves for the exact ratio."""
    return link.filter_report(*_named(spark, sf), 1000.0, 0.4)


@query()
def tiered_matches(spark, sf):
    p = d.table(spark, sf, "part")
    a = p.where(F.col("p_partkey") % 2 == 0).select(F.col("p_partkey").alias("row_id"), F.lower("p_name").alias("core"), *d.place(F.col("p_partkey")))
    b = p.where(F.col("p_partkey") % 2 == 1).select(F.col("p_partkey").alias("other_id"), F.lower(F.concat("p_name", F.lit("店"))).alias("other_core"), F.lit("ギア").alias("other_kana"), *d.place(F.col("p_partkey")))
    return link.tiered_nearest(a, b, ["blue"], ["anvil"])


@query("WITH m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase') SELECT c_custkey AS row_id, CASE WHEN m.user_id IS NOT NULL THEN 'matched' WHEN c_mktsegment = 'BUILDING' THEN 'nonfood' WHEN c_acctbal < 0 THEN 'uncertain' ELSE 'added' END AS status FROM customer LEFT JOIN m ON m.user_id = c_custkey")
def status_routing(spark, sf):
    m = d.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("row_id")).distinct()
    c = d.table(spark, sf, "customer").withColumnRenamed("c_custkey", "row_id")
    return link.routed(c, m, F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal") < 0).select("row_id", "status")


@query("WITH l AS (SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM events) WHERE k = 1) SELECT c_custkey, event_type, value FROM customer LEFT JOIN l ON user_id = c_custkey")
def lookup_last_wins(spark, sf):
    last = rules.last_wins(d.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")
    return d.table(spark, sf, "customer").join(last, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "event_type", "value")


@query("WITH l AS (SELECT name, arg_max(size, id) AS size FROM (SELECT p_partkey AS id, trim(' ' || p_name || '  ') AS name, p_size AS size FROM part) GROUP BY 1) SELECT p_partkey AS id, l.size FROM part LEFT JOIN l ON l.name = trim(p_name)")
def name_labels(spark, sf):
    p = d.table(spark, sf, "part")
    names = p.select(text.trimmed(F.concat(F.lit(" "), "p_name", F.lit("　 "))).alias("name"), F.col("p_size").alias("size"), F.col("p_partkey").alias("ord"))
    labels = rules.last_wins(names, ["name"], "ord").select("name", "size")
    return p.select(F.col("p_partkey").alias("id"), text.trimmed(F.col("p_name")).alias("name")).join(labels, "name", "left").select("id", "size")


@query("SELECT n_name AS name, CASE WHEN n_nationkey < 5 THEN 'note ' || CAST(n_nationkey AS VARCHAR) END AS note FROM nation")
def note_override(spark, sf):
    n = d.table(spark, sf, "nation")
    notes = n.where("n_nationkey < 5").select(F.col("n_name").alias("name"), F.concat(F.lit("note "), F.col("n_nationkey").cast("string")).alias("note"))
    return stats.with_notes(n.select(F.col("n_name").alias("name")), notes, "name")


_EV = """e AS (SELECT d.doc_id, CASE WHEN lang = 'fr' THEN 'french' END AS name, CASE WHEN source IS NULL THEN NULL WHEN d.doc_id % 7 = 0 THEN 'web' END AS category, CASE WHEN d.doc_id % 11 = 0 THEN 'permit' END AS permit, CASE WHEN d.doc_id % 13 = 0 THEN 'tag' END AS tags,
CASE WHEN l.toxic = 1 THEN 'excluded' WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'unresolved' END AS answer, CASE d.doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS confidence, n_chars / 5000.0e0 AS score
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) l USING (doc_id))"""


def _evidence(spark, sf):
    lab = d.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    k = F.col("doc_id")
    return d.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars").join(lab, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("lang") == "fr", "french").alias("name"),
        F.when(F.col("source").isNotNull() & (k % 7 == 0), "web").alias("category"),
        F.when(k % 11 == 0, "permit").alias("permit"),
        F.when(k % 13 == 0, "tag").alias("tags"),
        F.when(F.col("toxic") == 1, "excluded").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "unresolved").alias("answer"),
        F.when(k % 3 == 0, "high").when(k % 3 == 1, "mid").otherwise("low").alias("confidence"),
        (F.col("n_chars") / F.lit(5e3)).alias("score"),
    )


_STATION = "f AS (SELECT doc_id, coalesce(name, category, permit, tags, CASE WHEN answer = 'excluded' OR (confidence <> 'low' AND answer <> 'unresolved') THEN answer END, 'unresolved') AS label, CASE WHEN name IS NOT NULL THEN 'name' WHEN category IS NOT NULL THEN 'category' WHEN permit IS NOT NULL THEN 'permit' WHEN tags IS NOT NULL THEN 'tags' WHEN answer = 'excluded' OR (confidence <> 'low' AND answer <> 'unresolved') THEN 'answer' ELSE 'unresolved' END AS method FROM e)"


@query(f"WITH {_EV}, {_STATION} SELECT doc_id, label, method FROM f")
def station_evidence(spark, sf):
    cols = [F.col(c) for c in ("name", "category", "permit", "tags", "answer", "confidence")]
    return _evidence(spark, sf).select("doc_id", rules.station_evidence(*cols).alias("f")).select("doc_id", "f.label", "f.method")


@query(f"WITH {_EV}, {_STATION} SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND method NOT IN ('name', 'permit', 'tags', 'answer') THEN 'excluded' ELSE label END AS label FROM f")
def uncertain_records(spark, sf):
    return station_evidence(spark, sf).select("doc_id", rules.keep_uncertain(F.col("doc_id") % 2 == 0, F.col("label"), F.col("method")).alias("label"))


@query(f"WITH {_EV}, g AS (SELECT *, coalesce(name, category) AS rule, coalesce(answer, 'unresolved') <> 'unresolved' AS said FROM e) SELECT doc_id, CASE WHEN score < 0.05 THEN 'unresolved' WHEN rule IS NOT NULL THEN rule WHEN said AND confidence <> 'low' THEN answer ELSE 'unresolved' END AS label, CASE WHEN score < 0.05 THEN 'low_confidence' WHEN rule IS NOT NULL THEN 'rule' WHEN said AND confidence <> 'low' THEN 'answer' ELSE 'unresolved' END AS method, CASE WHEN score >= 0.05 AND rule IS NULL AND said AND confidence = 'low' THEN answer ELSE '' END AS low FROM g")
def area_evidence(spark, sf):
    f = rules.area_evidence(F.coalesce("name", "category"), F.lit("rule"), F.col("answer"), F.col("confidence"), F.col("score"), 0.05)
    return _evidence(spark, sf).select("doc_id", f.alias("f")).select("doc_id", "f.*")


@query(f"WITH {V}, r AS (SELECT id, major, mid, CASE category WHEN 'SMALL' THEN 'home' WHEN 'MEDIUM' THEN 'industry' END AS by_category, CASE WHEN id % 3 = 0 THEN 'industry' ELSE 'unknown' END AS low_major FROM venues) SELECT id, CASE WHEN major <> 'unknown' THEN major ELSE coalesce(by_category, low_major) END AS major, mid FROM r")
def rollup_fallback(spark, sf):
    low = F.when(F.col("id") % 3 == 0, "bulk").otherwise("")
    major, mid = rules.rolled_up_with_fallback(F.col("label"), F.col("category"), low, d.TAXONOMY, {"SMALL": "home", "MEDIUM": "industry"})
    return d.venues(spark, sf).select("id", major.alias("major"), mid.alias("mid"))


@query(f"WITH {V} SELECT id, CASE WHEN mid = 'fancy' THEN 'retail' WHEN mid = 'moving' THEN '761' WHEN mid = 'table' THEN '763' WHEN major = 'industry' AND mid <> 'unknown' THEN '762' ELSE 'unknown' END AS code FROM venues")
def census_codes(spark, sf):
    code = rules.census_code(F.col("major"), F.col("mid"), {"moving": "761", "table": "763"}, ("fancy",), "industry", "762")
    return d.venues(spark, sf).select("id", code.alias("code"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'sushi' WHEN p_partkey % 4 = 1 THEN 'noodles' WHEN p_partkey % 2 = 0 AND p_size > 10 THEN 'bar' WHEN p_size % 2 = 0 THEN 'bakery' ELSE '' END AS genre FROM part")
def tag_genres(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    cuisine = F.when(k % 4 == 0, "odd;Su Shi;ramen").when(k % 4 == 1, "ramen").otherwise("odd")
    tags = F.create_map(F.lit("cuisine"), cuisine, F.lit("amenity"), F.when((k % 2 == 0) & (size > 10), "pub").otherwise("bench"), F.lit("shop"), F.when(size % 2 == 0, "bread").otherwise("x"))
    genre = rules.tag_genre(tags, {"sushi": "sushi", "ramen": "noodles"}, {"pub": "bar"}, {"bread": "bakery"})
    return d.table(spark, sf, "part").select(k.alias("id"), genre.alias("genre"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Ring' WHEN s_suppkey % 3 = 1 THEN 'Metro' || s_name ELSE s_name END AS line, CASE WHEN s_suppkey % 5 = 0 THEN 'jr' WHEN s_suppkey % 3 = 1 OR s_nationkey % 2 = 0 THEN 'subway' ELSE 'private' END AS kind FROM supplier")
def line_names(spark, sf):
    k = F.col("s_suppkey")
    operator = F.when(k % 5 == 0, "East Rail").when(k % 3 == 1, "City Metro").otherwise("Other")
    line = F.when(k % 3 == 0, "大環線").otherwise(F.concat((k % 9).cast("string"), F.lit("号線"), "s_name", F.lit("（支線）")))
    metro = F.when(k % 3 == 1, "City Metro").otherwise("Other")
    name = rules.line_name(metro, line, {"大環線": "Ring"}, {"City Metro": "Metro"})
    kind = rules.line_kind(operator, F.when((F.col("s_nationkey") % 2 == 0) | (k % 3 == 1), "subway").otherwise("rail"), ["City Metro"], "^East Rail")
    return d.table(spark, sf, "supplier").select(k.alias("id"), name.alias("line"), kind.alias("kind"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(list(o_orderpriority)))[1:2], '・') || CASE WHEN count(DISTINCT o_orderpriority) > 2 THEN 'など' ELSE '' END AS shown FROM orders GROUP BY 1")
def first_two_names(spark, sf):
    return d.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("n")).select("o_custkey", rules.first_two(F.col("n")).alias("shown"))


@query("SELECT n_nationkey AS area, CASE WHEN c / s >= 2 THEN 'office' WHEN c / s <= 0.5 THEN 'residential' WHEN c >= 100 THEN 'dense' WHEN s / 4e0 >= 1.5 THEN 'special' ELSE 'mixed' END AS word FROM (SELECT n_nationkey, CAST((SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS DOUBLE) AS c, greatest(CAST((SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) * 10 AS DOUBLE), 1e0) AS s FROM nation)")
def narratives(spark, sf):
    c = d.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").cast("double").alias("c"))
    s = d.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg((F.count("*") * 10).cast("double").alias("s"))
    n = d.table(spark, sf, "nation").join(c, "n_nationkey", "left").join(s, "n_nationkey", "left").na.fill(0.0, ["c", "s"]).withColumn("s", F.greatest("s", F.lit(1.0)))
    return n.select(F.col("n_nationkey").alias("area"), rules.narrative(F.col("c") / F.col("s"), F.col("c"), F.col("s") / 4).alias("word"))


@query(f"WITH {V}, {S}, {_PAIRS} SELECT station, radius, count(*) AS total, count(*) FILTER (major = 'unknown') AS unknown_major, count(*) FILTER (mid = 'unknown') AS unknown_mid FROM pairs GROUP BY 1, 2")
def station_totals(spark, sf):
    own, counts = _counts(spark, sf, ["major", "mid"])
    return own.join(stats.totals(counts, _SPOT, summed=True), "spot").select("station", "radius", "total", "unknown_major", "unknown_mid")


@query(f"WITH {V}, u AS (SELECT id, name, category, 'a' || CAST(id % 17 AS VARCHAR) AS address FROM venues WHERE label = 'unresolved'), c AS (SELECT name, category, count(*) AS n, min(id) AS f FROM u GROUP BY 1, 2), m AS (SELECT name, category FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, f) AS k FROM c) WHERE k = 1) SELECT name, count(*) AS n, any_value(m.category) AS category, arg_min(address, id) AS address FROM u JOIN m USING (name) GROUP BY name")
def unresolved_names(spark, sf):
    v = d.venues(spark, sf).where("label = 'unresolved'").withColumn("address", F.concat(F.lit("a"), (F.col("id") % 17).cast("string")))
    return stats.name_rollup(v.select("id", "name", "category", "address"), "id")


@query(f"SELECT id, round((35.6e0 * 2 + a + b) / 2, 6) AS y FROM (SELECT s_suppkey AS id, ((CAST(s_suppkey*37+11 AS BIGINT)*7919) % 2000)/1e4 AS a, ((CAST(s_suppkey*13+5 AS BIGINT)*7919) % 2000)/1e4 AS b FROM supplier)")
def centroids(spark, sf):
    ends = [F.struct(x.alias("x"), y.alias("y")) for y, x in (d.place(F.col("s_suppkey") * a + b) for a, b in ((37, 11), (13, 5)))]
    c = d.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), geo.centroid(F.array(*ends)).alias("c"))
    return c.select("id", F.round("c.y", 6).alias("y"))


@query(f"WITH {V} SELECT id, major AS a, CASE WHEN category IN ('LARGE', 'MEDIUM') THEN 'industry' ELSE 'home' END AS b FROM venues WHERE major <> 'unknown' AND major <> CASE WHEN category IN ('LARGE', 'MEDIUM') THEN 'industry' ELSE 'home' END")
def rule_disagreements(spark, sf):
    b = F.when(F.col("category").isin("LARGE", "MEDIUM"), "industry").otherwise("home")
    return stats.disagreements(d.venues(spark, sf).select("id", F.when(F.col("major") != "unknown", F.col("major")).alias("a"), b.alias("b")), "a", "b")


@query("SELECT count(*) AS n, round(sum(n_chars) * 1.0 / 1e6 * 32196 / count(*) * 0.5, 6) AS cost FROM documents")
def label_cost(spark, sf):
    t = d.table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("c"))
    return t.select("n", F.round(label.cost(F.col("c"), F.lit(0.0), 1.0, 1.0, F.col("n"), F.lit(32196)), 6).alias("cost"))


@query("SELECT CASE l.doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'mid' ELSE 'low' END AS band, count(*) AS n, count(*) FILTER (quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) AS correct, count(*) FILTER (quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS rate FROM labels l JOIN documents USING (doc_id) GROUP BY 1")
def accuracy_by_band(spark, sf):
    k = F.col("doc_id") % 3
    rows = d.table(spark, sf, "labels").join(d.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("t")), "doc_id")
    return stats.accuracy_by(rows.withColumn("band", F.when(k == 0, "high").when(k == 1, "mid").otherwise("low")), "band", "t", "quality")


@query(f"WITH {V}, {S}, {_PAIRS} SELECT CAST(station AS VARCHAR) AS station, radius, count(*) AS n FROM pairs GROUP BY 1, 2 UNION ALL SELECT '_area', 0, count(*) FROM venues WHERE label <> 'excluded'")
def area_row(spark, sf):
    own, counts = _counts(spark, sf, [])
    rows = own.join(counts, "spot").select(F.col("station").cast("string").alias("station"), "radius", "n")
    return stats.with_area_row(rows, d.counted(d.venues(spark, sf)).agg(F.count("*").alias("n")))


@query("WITH m AS (SELECT c_nationkey AS town, CAST(c_custkey % 4 AS INTEGER) AS chome, CAST(floor(avg(c_custkey * 100) + 0.5) AS BIGINT) AS lat5, CAST(floor(avg(c_custkey * 7) + 0.5) AS BIGINT) AS lng5 FROM customer GROUP BY 1, 2) SELECT town, string_agg(CAST(chome AS VARCHAR) || ':' || CAST(lat5 AS VARCHAR) || ':' || CAST(lng5 AS VARCHAR), ',' ORDER BY chome) AS chomes FROM m GROUP BY 1")
def address_rollup(spark, sf):
    c = d.table(spark, sf, "customer").select(F.col("c_nationkey").alias("town"), (F.col("c_custkey") % 4).cast("int").alias("chome"), (F.col("c_custkey") * 100).alias("lat5"), (F.col("c_custkey") * 7).alias("lng5"))
    shown = F.transform("chomes", lambda x: F.concat_ws(":", x["chome"], x["lat5"], x["lng5"]))
    return stats.address_rollup(c).select("town", F.array_join(shown, ",").alias("chomes"))


@query("SELECT code, round(sum(observed) / CAST(sum(census) AS DOUBLE), 2) AS ratio_all, round(sum(observed) FILTER (ward < 5) / CAST(sum(census) FILTER (ward < 5) AS DOUBLE), 2) AS ratio_central, round(sum(observed) FILTER (ward >= 20) / CAST(sum(census) FILTER (ward >= 20) AS DOUBLE), 2) AS ratio_outer FROM (SELECT c_mktsegment AS code, c_nationkey AS ward, count(*) AS census, count(*) FILTER (c_acctbal > 0) AS observed FROM customer GROUP BY 1, 2) GROUP BY 1")
def area_ratios(spark, sf):
    c = d.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("code"), F.col("c_nationkey").alias("ward")).agg(F.count("*").alias("census"), F.count_if(F.col("c_acctbal") > 0).alias("observed"))
    return stats.ratios(c, "ward", {"central": list(range(5)), "outer": list(range(20, 25))})


def _ring(corners):
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in (*corners, corners[0])])


def _box(x0, y0, x1, y1):
    return _ring([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])


_HOLLOW = "p AS (SELECT n_nationkey AS k, 139.6e0 + n_nationkey * 0.009e0 + 0.00003e0 AS x, 35.6e0 + n_nationkey * 5 % 25 * 0.006e0 + 0.00003e0 AS y FROM nation)"


@query(f"WITH {V}, {_HOLLOW}, h AS (SELECT v.id, min(k) AS area FROM venues v, p WHERE (lng > x AND lng < x + 0.08e0 AND lat > y AND lat < y + 0.05e0 AND NOT (lng > x + 0.02e0 AND lng < x + 0.06e0 AND lat > y + 0.01e0 AND lat < y + 0.04e0)) OR (lng > x + 0.03e0 AND lng < x + 0.05e0 AND lat > y + 0.02e0 AND lat < y + 0.03e0) OR (lng > x + 0.1e0 AND lng < x + 0.11e0 AND lat > y AND lat < y + 0.05e0) GROUP BY 1) SELECT v.id, h.area FROM venues v LEFT JOIN h USING (id)")
def hollow_areas(spark, sf):
    """Areas with a hole, an island in it and a part of their own; a venue lies in the first that holds it."""
    n = d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_nationkey").alias("ord"), (F.lit(139.6) + F.col("n_nationkey") * 0.009 + 0.00003).alias("x"), (F.lit(35.6) + F.col("n_nationkey") * 5 % 25 * 0.006 + 0.00003).alias("y"))
    boxes = [(0.0, 0.0, 0.08, 0.05), (0.02, 0.01, 0.06, 0.04), (0.03, 0.02, 0.05, 0.03), (0.1, 0.0, 0.11, 0.05)]
    rings = F.array(*[_box(F.col("x") + a, F.col("y") + b, F.col("x") + c, F.col("y") + e) for a, b, c, e in boxes])
    return cover.located(d.venues(spark, sf).select("id", "lat", "lng"), n.select("id", "ord", rings.alias("rings"))).select("id", "area")


@query("""WITH RECURSIVE f AS (SELECT s_nationkey AS area, s_suppkey * 7919 % 40 AS x, s_suppkey * 104729 % 40 AS y, 6 + s_suppkey % 5 AS w, 6 + s_suppkey % 7 AS h FROM supplier),
g AS (SELECT DISTINCT area, i AS x, j AS y FROM f, range(0, 52) a(i), range(0, 54) b(j) WHERE i >= x AND i < x + w AND j >= y AND j < y + h AND NOT (i >= x + 2 AND i < x + w - 2 AND j >= y + 2 AND j < y + h - 2)),
o AS (SELECT DISTINCT area, CAST(-1 AS BIGINT) AS x, CAST(-1 AS BIGINT) AS y FROM f UNION
  SELECT o.area, o.x + a, o.y + b FROM o, range(-1, 2) p(a), range(-1, 2) q(b) WHERE o.x + a BETWEEN -1 AND 53 AND o.y + b BETWEEN -1 AND 55 AND NOT EXISTS (SELECT 1 FROM g WHERE g.area = o.area AND g.x = o.x + a AND g.y = o.y + b))
SELECT g.area, round(count(*) * 90e0 * 111e0 / 4096, 3) AS km2, round((55 * 57 - any_value(n)) * 90e0 * 111e0 / 4096, 3) AS filled_km2 FROM g JOIN (SELECT area, count(*) AS n FROM o GROUP BY 1) o ON o.area = g.area GROUP BY 1""")
def area_union(spark, sf):
    """Hollow boxes of each nation's suppliers, united; the SQL counts cells of a fine grid, and floods it from outside to find the holes."""
    k = F.col("s_suppkey")
    x, y, w, h = k * 7919 % 40, k * 104729 % 40, 6 + k % 5, 6 + k % 7
    hollow = F.array(*[_box((x + i) / 64, (y + i) / 64, (x + w - i) / 64, (y + h - i) / 64) for i in (0, 2)])
    p = d.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("area"), hollow.alias("rings"))
    t = cover.sizes(p, Scratch(spark, "union"), 90.0, 111.0)
    return t.select("area", F.round("km2", 3).alias("km2"), F.round("filled_km2", 3).alias("filled_km2"))


@query(f"WITH {V} SELECT id, least(abs(lng - 139.65e0), abs(139.75e0 - lng)) * 90000 < 500 AND lat BETWEEN 35.64e0 AND 35.76e0 OR least(abs(lat - 35.64e0), abs(35.76e0 - lat)) * 111000 < 500 AND lng BETWEEN 139.65e0 AND 139.75e0 AS near_edge FROM venues WHERE lng BETWEEN 139.65e0 AND 139.75e0 AND lat BETWEEN 35.64e0 AND 35.76e0")
def edge_flags(spark, sf):
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((139.65, 35.64), (139.75, 35.64), (139.75, 35.76), (139.65, 35.76), (139.65, 35.64))])
    v = d.venues(spark, sf).where(F.col("lng").between(139.65, 139.75) & F.col("lat").between(35.64, 35.76))
    return v.select("id", geo.near_edge(F.array(ring), F.col("lng"), F.col("lat"), 90000.0, 111000.0, F.lit(500.0)).alias("near_edge"))


@query("SELECT n_nationkey AS id, round((1 + n_nationkey % 3) * 2 * 90e0 * 111e0 + 90e0 * 111e0, 3) AS km2 FROM nation")
def area_sizes(spark, sf):
    w = (1 + F.col("n_nationkey") % 3).cast("double")

    def box(x0, width, height):
        return F.array(*[F.struct((F.lit(x0) + a * width).alias("x"), F.lit(b * height).alias("y")) for a, b in ((0, 0.0), (1, 0.0), (1, 1.0), (0, 1.0), (0, 0.0))])

    parts = F.array(box(0.0, w, 2.0), box(100.0, F.lit(1.0), 1.0))
    return d.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.round(geo.area_km2(parts, 90.0, 111.0), 3).alias("km2"))


@query("SELECT n_regionkey AS line, arg_max(n_name, n_nationkey) AS operator, count(*) AS n, CAST(sum(n_nationkey) AS BIGINT) AS stops FROM nation GROUP BY 1")
def grouped_lines(spark, sf):
    n = d.table(spark, sf, "nation")
    return n.groupBy(F.col("n_regionkey").alias("line")).agg(F.max_by("n_name", "n_nationkey").alias("operator"), F.count("*").alias("n"), F.sum("n_nationkey").cast("long").alias("stops"))


@query(_ALL + ", r AS (SELECT *, n - coalesce(lag(n) OVER (PARTITION BY station, level, major, mid ORDER BY radius), 0) AS ring_n FROM t), rs AS (SELECT *, CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN CAST(ring_n AS DOUBLE) / nullif(sum(CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN ring_n END) OVER (PARTITION BY station, radius, level), 0) END AS rshare FROM r) SELECT station, radius, level, major, mid, ring_n, round(rshare, 6) AS share, round(CASE WHEN base_share <> 0 THEN rshare / base_share END, 6) AS lq FROM rs LEFT JOIN base USING (level, major, mid)")
def ring_lq(spark, sf):
    """Counts, shares and quotients of the rings between radii."""
    own, t = _tally(spark, sf)
    r = stats.ring_quotients(t, ["spot"], _base(spark, sf)).withColumns({c: F.round(c, 6) for c in ("share", "lq")})
    return own.join(r, "spot").select("station", "radius", "level", "major", "mid", "ring_n", "share", "lq")


@query(f"""WITH {V}, {S}, {_PAIRS}, n AS (SELECT station, radius, count(*) AS n FROM pairs GROUP BY 1, 2),
e AS (SELECT station, radius, CASE WHEN lng BETWEEN 139.65e0 AND 139.75e0 AND lat BETWEEN 35.64e0 AND 35.76e0 THEN least((lng - 139.65e0) * 90000, (139.75e0 - lng) * 90000, (lat - 35.64e0) * 111000, (35.76e0 - lat) * 111000)
  ELSE sqrt(pow(greatest(139.65e0 - lng, lng - 139.75e0, 0) * 90000, 2) + pow(greatest(35.64e0 - lat, lat - 35.76e0, 0) * 111000, 2)) END < radius AS near_edge FROM stations, (VALUES (1000), (2000), (5000)) r(radius))
SELECT e.station, e.radius, coalesce(n.n, 0) AS n, e.near_edge FROM e LEFT JOIN n ON n.station = e.station AND n.radius = e.radius""")
def completion_edges(spark, sf):
    """Every station and radius: its count or 0, and whether its circle reaches over the area's border.  SQL's greatest passes over nulls, so a
    station without a place is 0 from the border."""
    own, counts = _counts(spark, sf, [])
    ring = _box(*[F.lit(v) for v in (139.65, 35.64, 139.75, 35.76)])
    near = geo.near_edge(F.array(ring), F.col("lng"), F.col("lat"), 90000.0, 111000.0, F.col("radius"))
    places = own.select("spot", "lat", "lng").distinct().crossJoin(spark.createDataFrame([(r,) for r in d.RADII], "radius int"))
    flags = places.select("spot", "radius", F.coalesce(near, F.lit(True)).alias("near_edge"))
    return stats.completed(_every_radius(own), counts, _SPOT, ["n"], flags).select("station", "radius", "n", "near_edge")


@query("""WITH l AS (SELECT s_suppkey, n_name, i FROM supplier, range(0, 3) r(i), nation WHERE i < s_suppkey % 4 AND n_nationkey = (s_nationkey + i) % 25),
s AS (SELECT s_suppkey, 'N' || CAST(s_nationkey % 20 AS VARCHAR) AS name FROM supplier), h AS (SELECT s_suppkey, string_agg(n_name, '・' ORDER BY i) FILTER (i < 2) || CASE WHEN count(*) > 2 THEN 'など' ELSE '' END AS hint FROM l GROUP BY 1)
SELECT s.s_suppkey, CASE WHEN count(*) OVER (PARTITION BY name) > 1 AND hint IS NOT NULL THEN name || '（' || hint || '）' ELSE name END AS shown FROM s LEFT JOIN h ON h.s_suppkey = s.s_suppkey""")
def station_names(spark, sf):
    """Stations of one name are told apart by their first two lines."""
    s = d.table(spark, sf, "supplier")
    runs = s.select("s_suppkey", "s_nationkey", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).where("i < s_suppkey % 4")
    named = runs.join(d.table(spark, sf, "nation").select((F.col("n_nationkey")).alias("k"), "n_name"), F.col("k") == (F.col("s_nationkey") + F.col("i")) % 25)
    lines = stats.ordered_names(named, ["s_suppkey"], "n_name", [F.col("i")])
    rows = s.select("s_suppkey", F.concat(F.lit("N"), (F.col("s_nationkey") % 20).cast("string")).alias("name")).join(lines, "s_suppkey", "left")
    return stats.disambiguated(rows, "name", F.when(F.size("names") > 0, rules.first_two(F.col("names")))).select("s_suppkey", "shown")


@query(f"WITH {S} SELECT station FROM stations WHERE passengers > 0 AND station IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def served_stations(spark, sf):
    """Stations with passengers and a key that the facts have."""
    facts = d.table(spark, sf, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("station"))
    return d.stations(spark, sf).where("passengers > 0").join(facts, "station", "left_semi").select("station")


@query("SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'Ring' WHEN s_suppkey % 3 = 1 THEN 'Metro' || CAST(s_nationkey AS VARCHAR) ELSE 'L' || CAST(s_nationkey AS VARCHAR) END AS name, count(*) AS n, arg_max(CASE WHEN s_suppkey % 5 = 0 THEN 'East Rail' WHEN s_suppkey % 3 = 1 THEN 'City Metro' ELSE 'Other' END, s_suppkey) AS operator, arg_max(CASE WHEN s_suppkey % 5 = 0 THEN 'jr' WHEN s_suppkey % 3 = 1 OR s_nationkey % 2 = 0 THEN 'subway' ELSE 'private' END, s_suppkey) AS kind FROM supplier GROUP BY 1")
def lines_by_name(spark, sf):
    """Lines grouped by their derived name; the last one's operator and kind win."""
    k = F.col("s_suppkey")
    operator = F.when(k % 5 == 0, "East Rail").when(k % 3 == 1, "City Metro").otherwise("Other")
    line = F.when(k % 3 == 0, "大環線").otherwise(F.concat((k % 9).cast("string"), F.lit("号線"), F.when(k % 3 == 1, "").otherwise("L"), F.col("s_nationkey").cast("string"), F.lit("（支線）")))
    name = rules.line_name(F.when(k % 3 == 1, "City Metro").otherwise("Other"), line, {"大環線": "Ring"}, {"City Metro": "Metro"})
    kind = rules.line_kind(operator, F.when((F.col("s_nationkey") % 2 == 0) | (k % 3 == 1), "subway").otherwise("rail"), ["City Metro"], "^East Rail")
    rows = d.table(spark, sf, "supplier").select(k.alias("ord"), operator.alias("operator"), kind.alias("kind"), name.alias("__name"))
    return stats.grouped_last(rows, F.col("__name"), "ord", ["operator", "kind"])


@query(f"WITH p AS (SELECT s_nationkey AS line, s_suppkey AS k, {d.PLACE.format(k='s_suppkey*37+11')} FROM supplier), s AS (SELECT line, hypot_ AS m FROM (SELECT line, sqrt(pow((lng - lag(lng) OVER w) * 90000, 2) + pow((lat - lag(lat) OVER w) * 111000, 2)) AS hypot_ FROM p WINDOW w AS (PARTITION BY line ORDER BY k)) WHERE hypot_ IS NOT NULL) SELECT line, count(*) + 1 AS points, round(sum(m), 3) AS m FROM s GROUP BY 1".replace("pow(", "power("))
def merged_routes(spark, sf):
    """Each nation's suppliers joined by segments, which are merged to one line again.  Suppliers are points of their own, also at one place."""
    s = d.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("k"), *d.place(F.col("s_suppkey") * 37 + 11))
    w = Window.partitionBy("key").orderBy("k")
    even = F.col("k") % 2 == 0  # segments point either way
    ends = s.withColumns({f"{c}0": F.lag(c).over(w) for c in ("lat", "lng", "k")}).where("lat0 is not null")
    segments = ends.select("key", *[F.when(even, F.col(a)).otherwise(F.col(b)).alias(f"{c}{i}") for c, col in (("x", "lng"), ("y", "lat"), ("n", "k")) for i, a, b in ((1, f"{col}0", col), (2, col, f"{col}0"))])
    lines = chains.merged_lines(segments, Scratch(spark, "routes"))
    measured = lines.select("key", F.size("points").cast("long").alias("n"), F.round(chains.length_m(F.col("points"), 90000.0, 111000.0), 3).alias("m"))
    return measured.withColumnsRenamed({"key": "line", "n": "points"})


@query("SELECT r_name AS area, n_nationkey AS part, round((1 + n_nationkey % 3) * 0.5e0, 6) AS size FROM nation JOIN region ON r_regionkey = n_regionkey")
def rekeyed_areas(spark, sf):
    """Parts of areas, known by number, get the areas' names."""
    w = (1 + F.col("n_nationkey") % 3).cast("double")
    p = d.table(spark, sf, "nation").select(F.col("n_regionkey").cast("string").alias("area"), F.col("n_nationkey").alias("part"), _box(F.lit(0.0), F.lit(0.0), w, F.lit(0.5)).alias("ring"))
    names = d.table(spark, sf, "region").select(F.col("r_regionkey").cast("string").alias("area"), F.col("r_name").alias("name"))
    return spatial.rekeyed(p, names, "area", "name").select("area", "part", F.round(geo.ring_area(F.col("ring")), 6).alias("size"))


@query("SELECT r_name AS area, n_name AS key FROM nation JOIN region ON r_regionkey = n_regionkey")
def area_keys(spark, sf):
    return d.table(spark, sf, "nation").join(d.table(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("area"), F.col("n_name").alias("key"))


@query("SELECT p_partkey AS id, row_number() OVER (ORDER BY CASE WHEN p_size > 25 THEN p_type END NULLS LAST, p_name NULLS LAST, p_partkey) AS place FROM part")
def ordered_nulls_last(spark, sf):
    p = d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("category"), "p_name")
    return order.numbered(p, F.col("category").asc_nulls_last(), F.col("p_name").asc_nulls_last(), F.col("id")).select("id", "place")


@query(f"WITH {S} SELECT station, row_number() OVER (ORDER BY passengers DESC NULLS LAST, station) AS place FROM stations")
def stable_ranking(spark, sf):
    return order.numbered(d.stations(spark, sf).select("station", "passengers"), F.col("passengers").desc_nulls_last(), F.col("station")).select("station", "place")


@query(f"WITH {V} SELECT id, CAST(CASE mid " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(d.MIDS)) + f" ELSE {len(d.MIDS) + 1} END AS INTEGER) AS place FROM venues")
def categorical_order(spark, sf):
    return d.venues(spark, sf).select("id", stats.categorical(F.col("mid"), d.MIDS).alias("place"))


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, sf):
    return d.table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")).union(d.table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query(_ALL + "SELECT station, mid, place FROM (SELECT station, mid, row_number() OVER (PARTITION BY mid ORDER BY round(lq, 6) DESC, station) AS place FROM lq WHERE level = 'mid' AND radius = 5000 AND lq IS NOT NULL) WHERE place <= 5")
def ranked_by_lq(spark, sf):
    """The first five stations of a genre: of a place only its first five can be among them, and a task hands on five of what it has."""
    own, t = _lq(spark, sf, [5000])
    k = F.row_number().over(Window.partitionBy("spot").orderBy("station"))
    firsts = own.where("lat IS NOT NULL").withColumn("k", k).where("k <= 5").drop("k")
    ranked = firsts.join(t.where("level = 'mid' AND lq IS NOT NULL").withColumn("lq", F.round("lq", 6)), "spot")
    w = Window.partitionBy("mid").orderBy(F.col("lq").desc(), "station")
    return ranked.withColumn("place", F.row_number().over(w)).where("place <= 5").select("station", "mid", F.col("place").cast("long").alias("place"))


@query(_ALL + "SELECT mid, " + ", ".join(f"max(CASE WHEN station = {k} THEN n END) AS s{k}" for k in (1, 2, 3, 4, 5)) + " FROM lq WHERE level = 'mid' AND radius = 5000 AND station <= 5 GROUP BY mid")
def compared_stations(spark, sf):
    own, t = _lq(spark, sf, [5000], d.stations(spark, sf).where("station <= 5"))
    found = own.join(t.where("level = 'mid'"), "spot").groupBy("mid").pivot("station", [1, 2, 3, 4, 5]).agg(F.first("n"))
    return found.withColumnsRenamed({str(k): f"s{k}" for k in range(1, 6)})


@query(f"WITH {V} SELECT id, round(lng - 1000 * 1.05e0 / 111320 / cos(radians(lat)), 9) AS x0, round(lat + 1000 * 1.05e0 / 111320, 9) AS y1 FROM venues")
def circle_boxes(spark, sf):
    v = d.venues(spark, sf).select("id", geo.column_circle_bbox(F.col("lat"), F.col("lng"), F.lit(1000.0)).alias("b"))
    return v.select("id", F.round("b.x0", 9).alias("x0"), F.round("b.y1", 9).alias("y1"))


@query("SELECT p_partkey AS id, replace(lower(p_name), ' ', '') AS core, regexp_replace(lower(p_type || p_name), '[^a-z]', '', 'g') AS latin, CASE WHEN p_partkey % 3 = 0 THEN 'shato' WHEN p_partkey % 3 = 1 THEN 'kafuerattekyoku' ELSE '' END AS kana, CAST(p_partkey % 100 AS INTEGER) AS number FROM part")
def name_forms(spark, sf):
    k = F.col("p_partkey") % 100
    one = F.translate((k % 10).cast("string"), "0123456789", "〇一二三四五六七八九")
    ten = F.translate(F.floor(k / 10).cast("string"), "0123456789", "〇一二三四五六七八九")
    kanji = F.when(k < 10, one).otherwise(F.concat(F.when(F.floor(k / 10) > 1, ten).otherwise(""), F.lit("十"), F.when(k % 10 > 0, one).otherwise("")))
    wide = F.translate("p_name", "abcde", "ａｂｃｄｅ")
    kana = F.when(F.col("p_partkey") % 3 == 0, "シャトー").when(F.col("p_partkey") % 3 == 1, "カフェ・ラッテキョク").otherwise("ひらがな abc")
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.core_name(wide).alias("core"), text.latin_only(F.concat("p_type", wide)).alias("latin"), text.romaji(kana).alias("kana"), text.town_and_chome(F.concat(F.lit("町"), kanji, F.lit("丁目")))["chome"].alias("number"))


@query(f"WITH {V} SELECT id, CAST(round(lat * 1e5) AS BIGINT) AS lat5, CAST(round(lng * 1e5) AS BIGINT) AS lng5, round((lng - 139.6e0) * 1000, 6) AS x, round((35.8e0 - lat) * 1000, 6) AS y FROM venues")
def map_positions(spark, sf):
    v = d.venues(spark, sf)
    xy = geo.map_xy(F.col("lng"), F.col("lat"), 139.6, 35.8, 1000.0, 1000.0)
    return v.select("id", geo.fixed_point(F.col("lat")).alias("lat5"), geo.fixed_point(F.col("lng")).alias("lng5"), F.round(xy["x"], 6).alias("x"), F.round(xy["y"], 6).alias("y"))


@query("SELECT l_orderkey, l_linenumber, l_quantity + l_tax AS total FROM lineitem")
def column_spec(spark, sf):
    found = files.resolve("total=l_quantity+Tax", {"l_quantity": "Quantity", "l_tax": "Tax paid", "l_discount": "Discount"})
    total = sum((F.col(c) for c in found["total"][1:]), F.col(found["total"][0]))
    return d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", total.alias("total"))


@query()
def exact_rounding(spark, sf):
    return d.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.round_half_even(F.col("l_extendedprice") / 8, 2).alias("eighth"))


@query("SELECT p_partkey AS id, '{\"shop\":\"' || p_type || '\"' || CASE WHEN p_size > 20 THEN ',\"cuisine\":\"' || p_name || '\"' ELSE '' END || '}' AS tags FROM part")
def tag_json(spark, sf):
    keys = [F.lit("shop"), F.col("p_type"), F.lit("note"), F.col("p_brand")]
    tags = F.when(F.col("p_size") > 20, F.create_map(*keys, F.lit("cuisine"), F.col("p_name"))).otherwise(F.create_map(*keys))
    return d.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.tag_json(tags, ["shop", "cuisine"]).alias("tags"))


_FOLD = f"""g AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS k FROM (SELECT 'N' || CAST(station % 10 AS VARCHAR) AS name, station AS ord, lat, lng FROM stations)),
f AS (SELECT name, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(o BIGINT, lat DOUBLE, lng DOUBLE, n DOUBLE)[]) AS kept, CAST(-1 AS BIGINT) AS ord, CAST(-1 AS BIGINT) AS into_ FROM g WHERE k = 1
UNION ALL SELECT name, k, CASE WHEN p = 0 THEN list_append(kept, {{'o': ord, 'lat': lat, 'lng': lng, 'n': 1e0}}) ELSE [CASE WHEN i = p THEN {{'o': x.o, 'lat': (x.lat * x.n + lat) / (x.n + 1), 'lng': (x.lng * x.n + lng) / (x.n + 1), 'n': x.n + 1}} ELSE x END FOR x, i IN kept] END, ord, CASE WHEN p = 0 THEN ord ELSE kept[p].o END
  FROM (SELECT g.*, f.kept, coalesce(list_position([{H('x.lat', 'x.lng', 'g.lat', 'g.lng')} <= 3000 FOR x IN f.kept], true), 0) AS p FROM f JOIN g ON g.name = f.name AND g.k = f.k + 1))"""


@query(f"WITH RECURSIVE {S}, {_FOLD} SELECT name, ord, into_ AS into FROM f WHERE k > 0")
def merged_groups(spark, sf):
    s = d.stations(spark, sf)
    return sequential.merged_groups(s.select(F.concat(F.lit("N"), (F.col("station") % 10).cast("string")).alias("name"), F.col("station").alias("ord"), "lat", "lng", F.lit(1.0).alias("n")), 3000.0)


@query(f"""WITH RECURSIVE {V}, c AS (SELECT id, split_part(name, ' ', 2) AS core, lat, lng FROM venues), n AS (SELECT b.id, list_sort(list(a.id)) AS before FROM c a JOIN c b ON a.id < b.id AND length(a.core) >= 2 AND length(b.core) >= 2 AND (contains(a.core, b.core) OR contains(b.core, a.core)) AND abs(a.lat - b.lat) < 0.004 AND {H('a.lat', 'a.lng', 'b.lat', 'b.lng')} <= 400 GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY id) AS k FROM n), f AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS dropped, CAST(-1 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS owner
UNION ALL SELECT k, CASE WHEN owner IS NULL THEN dropped ELSE list_append(dropped, id) END, id, owner FROM (SELECT o.k, f.dropped, o.id, list_min(list_filter(o.before, lambda x: NOT list_contains(f.dropped, x))) AS owner FROM f JOIN o ON o.k = f.k + 1))
SELECT venues.id AS row_id, f.owner AS dup_of FROM venues LEFT JOIN f ON f.id = venues.id""")
def greedy_duplicates(spark, sf):
    v = d.venues(spark, sf).select(F.col("id").alias("row_id"), F.split("name", " ")[1].alias("core"), "lat", "lng")
    return sequential.greedy_duplicates(v, 400.0).select("row_id", "dup_of")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def answers_collected(spark, sf):
    """Chunks are sent, answered in files and collected as a stream; those that fail the first time are sent again."""
    scratch = Scratch(spark, "answers")
    chunks = scratch.table(order.chunked(left_anti_todo(spark, sf), "doc_id", 20), "chunks")
    requests = label.prompts(chunks, ["doc_id"])
    found = labels.Collection(spark, scratch.path("found"), chunks, ["even", "odd"])
    for attempt in range(2):
        todo = scratch.table(found.pending(requests), f"requests-{attempt}")
        found.sent(todo, attempt)
        answers = label.ask(todo, _stub)
        if attempt == 0:  # each third chunk fails once
            late = F.col("chunk") % 3 == 0
            answers = answers.select("chunk", F.when(~late, F.col("answer")).alias("answer"), F.when(late, "busy").alias("error"))
        answers.write.json(scratch.path(f"answers/{attempt}"))
        found.collect(scratch.path("answers/*"), scratch.path("checkpoint"), 3).awaitTermination()
    return found.labels().select("doc_id", "label")


@query(f"WITH {V} SELECT id, round(lat, 4) AS lat FROM venues WHERE lng >= 139.7 AND lng <= 139.75 AND lat >= 35.65 AND lat <= 35.7")
def curve_scan(spark, sf):
    """Venues written along a curve and read back by a nested box."""
    scratch = Scratch(spark, "curve")
    b = F.struct(F.col("lng").alias("xmin"), F.col("lng").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    places.write(d.venues(spark, sf).select("id", "lat", b.alias("bbox")), scratch.path("places"))
    return places.read(spark, scratch.path("places"), _BOX).select("id", F.round("lat", 4).alias("lat"))
