"""All queries by name, each with the SQL that states it (none where SQL cannot)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import geo, rules, text
from .operators import circles, label, link, order, spatial, stats
from .plans import driver as d
from .scratch import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


H = d.sql_haversine
V, S = d.SQL_VENUES, d.SQL_STATIONS
_PAIRS = f"pairs AS (SELECT s.station, s.passengers, v.id, v.ward, v.major, v.mid, r.radius FROM stations s, venues v, (VALUES (1000), (2000), (5000)) r(radius) WHERE v.label <> 'excluded' AND {H('s.lat', 's.lng', 'v.lat', 'v.lng')} <= r.radius)"
_TALLY = """t AS (SELECT station, radius, major, CASE WHEN grouping(mid) = 1 THEN '' ELSE mid END AS mid, CASE WHEN grouping(mid) = 1 THEN 'major' ELSE 'mid' END AS level, count(*) AS n FROM pairs GROUP BY GROUPING SETS ((station, radius, major), (station, radius, major, mid)))"""
_SHARE = """sh AS (SELECT *, CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN CAST(n AS DOUBLE) / sum(CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN n END) OVER (PARTITION BY station, radius, level) END AS share FROM t)"""
_BASE = """bt AS (SELECT major, CASE WHEN grouping(mid) = 1 THEN '' ELSE mid END AS mid, CASE WHEN grouping(mid) = 1 THEN 'major' ELSE 'mid' END AS level, count(*) AS n FROM venues WHERE label <> 'excluded' GROUP BY GROUPING SETS ((major), (major, mid))),
base AS (SELECT *, CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN CAST(n AS DOUBLE) / sum(CASE WHEN (level = 'major' AND major <> 'unknown') OR (level = 'mid' AND mid <> 'unknown') THEN n END) OVER (PARTITION BY level) END AS base_share FROM bt)"""
_LQ = "lq AS (SELECT sh.*, base_share, CASE WHEN base_share <> 0 THEN share / base_share END AS lq FROM sh LEFT JOIN base USING (level, major, mid))"
_SPOT = ["spot", "radius"]
_ALL = f"WITH {V}, {S}, {_PAIRS}, {_TALLY}, {_SHARE}, {_BASE}, {_LQ} "


def _by_place(stations: DataFrame, rows: DataFrame, radii: list[int], keys: list[str], weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations, each once, with the times it comes and its spot, and spot, radius, keys, n[, n_w].  As SQL counts a station's pairs as often as it
    comes, its spot is a place and these times."""
    once = stations.groupBy("station", "lat", "lng").agg(F.max("passengers").alias("passengers"), F.count("*").cast("int").alias("times"))
    own, per = circles.place_tallies(once, rows, radii, keys, weight)
    kinds = own.where("spot IS NOT NULL").select("spot", "times").distinct()
    spot, sums = F.struct("spot", "times").alias("spot"), ["n"] + (["n_w"] if weight else [])
    return own.withColumn("spot", spot), per.join(kinds, "spot").select(spot, "radius", *keys, *[(F.col(c) * F.col("times")).alias(c) for c in sums])


def _counts(spark: SparkSession, sf: str, keys: list[str], radii: list[int] = d.RADII, stations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations with their spot, and spot, radius, keys, n: the pairs counted by place, without making them."""
    v = d.counted(d.venues(spark, sf)).select("lat", "lng", *keys)
    return _by_place(d.stations(spark, sf) if stations is None else stations, v, radii, keys)


def _every_radius(own: DataFrame) -> DataFrame:
    """station, spot, radius: every station as often as it comes."""
    radii = F.flatten(F.array_repeat(F.array(*[F.lit(r) for r in d.RADII]), F.col("times")))
    return own.select("station", "spot", F.explode(radii).alias("radius"))


def _tally(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Stations with their spot, and spot, radius, level, major, mid, n."""
    own, counts = _counts(spark, sf, ["major", "mid"])
    return own, stats.tally(counts, _SPOT, summed=True)


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return stats.shares(stats.tally(d.counted(d.venues(spark, sf)), []), [])


def _lq(spark: SparkSession, sf: str, radii: list[int] = d.RADII, stations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Stations with their spot, and its shares and quotients: stations at one place have all of these in common."""
    own, counts = _counts(spark, sf, ["major", "mid"], radii, stations)
    return own, stats.quotients(stats.shares(stats.tally(counts, _SPOT, summed=True), _SPOT), _base(spark, sf))


@query(f"WITH {V} SELECT id, round(lat, 4) AS lat, round(lng, 4) AS lng FROM venues WHERE lng >= 139.7 AND lng <= 139.8 AND lat >= 35.65 AND lat <= 35.75")
def bbox_scan(spark, sf):
    b = F.struct(F.col("lng").alias("xmin"), F.col("lng").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax"))
    return spatial.in_bbox(d.venues(spark, sf).withColumn("bbox", b), (139.7, 35.65, 139.8, 35.75)).select("id", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng"))


@query(f"WITH {V} SELECT id, round({H('35.7e0', '139.7e0', 'lat', 'lng')}, 3) AS dist_m FROM venues WHERE {H('35.7e0', '139.7e0', 'lat', 'lng')} <= 3000")
def radius_filter(spark, sf):
    dist = geo.haversine(F.lit(35.7), F.lit(139.7), F.col("lat"), F.col("lng"))
    return d.venues(spark, sf).withColumn("dist_m", dist).where("dist_m <= 3000").select("id", F.round("dist_m", 3).alias("dist_m"))


@query(f"WITH {V} SELECT id, label, method FROM venues")
def rule_classify(spark, sf):
    return d.venues(spark, sf).select("id", "label", "method")


@query(f"WITH {V} SELECT major, mid, count(*) AS n FROM venues WHERE label <> 'excluded' GROUP BY 1, 2")
def taxonomy_rollup(spark, sf):
    return d.counted(d.venues(spark, sf)).groupBy("major", "mid").agg(F.count("*").alias("n"))


@query(f"WITH {V}, {S}, {_PAIRS} SELECT station, id, radius FROM pairs")
def station_range_join(spark, sf):
    return spatial.id_pairs(d.stations(spark, sf), d.counted(d.venues(spark, sf)), d.RADII, "station", "id").select("station", "id", "radius")


@query(f"WITH {V}, {S}, {_PAIRS}, {_TALLY} SELECT station, radius, level, major, mid, n FROM t")
def station_tally(spark, sf):
    own, t = _tally(spark, sf)
    return own.join(t, "spot").select("station", "radius", "level", "major", "mid", "n")


@query(_ALL + "SELECT station, radius, level, major, mid, round(share, 6) AS share FROM sh")
def station_share(spark, sf):
    own, t = _lq(spark, sf)
    return own.join(t.withColumn("share", F.round("share", 6)), "spot").select("station", "radius", "level", "major", "mid", "share")


@query(_ALL + "SELECT station, radius, level, major, mid, n, round(share, 6) AS share, round(base_share, 6) AS base_share, round(lq, 6) AS lq FROM lq")
def station_lq(spark, sf):
    own, t = _lq(spark, sf)
    rounded = {c: F.round(c, 6) for c in ("share", "base_share", "lq")}
    return own.join(t.withColumns(rounded), "spot").select("station", "radius", "level", "major", "mid", "n", *rounded)


@query(_ALL + "SELECT station, " + ", ".join(f"max(CASE WHEN mid = '{m}' THEN round(lq, 6) END) AS {m}" for m in d.MIDS) + " FROM lq WHERE level = 'mid' AND radius = 5000 GROUP BY station")
def lq_pivot(spark, sf):
    own, t = _lq(spark, sf, [5000])
    mids = t.where("level = 'mid'").withColumn("lq", F.round("lq", 6))
    return own.join(stats.wide(mids, ["spot"], "mid", "lq", d.MIDS), "spot").select("station", *d.MIDS)


@query(_ALL + "SELECT station, major, mid, radius, n, n - coalesce(lag(n) OVER (PARTITION BY station, level, major, mid ORDER BY radius), 0) AS ring_n FROM t WHERE level = 'mid'")
def ring_difference(spark, sf):
    own, t = _tally(spark, sf)
    r = stats.rings(t.where("level = 'mid'"), ["spot", "level", "major", "mid"])
    return own.join(r, "spot").select("station", "major", "mid", "radius", "n", "ring_n")


_WEIGHTS = f"""c AS (SELECT ward, CASE WHEN mid = 'unknown' THEN 'unknown' ELSE mid END AS code, count(*) AS n FROM venues WHERE label <> 'excluded' GROUP BY 1, 2),
cen AS (SELECT CAST(c_nationkey AS BIGINT) AS ward, CASE c_mktsegment WHEN 'BUILDING' THEN 'moving' WHEN 'AUTOMOBILE' THEN 'fixing' WHEN 'MACHINERY' THEN 'heavy' WHEN 'HOUSEHOLD' THEN 'table' ELSE 'basic' END AS code, count(*) AS n FROM customer GROUP BY 1, 2),
w0 AS (SELECT ward, sum(CASE WHEN code <> 'unknown' THEN n END) AS known, sum(n) AS food FROM c GROUP BY ward),
w1 AS (SELECT ward, sum(n) AS census_all FROM cen GROUP BY ward),
wa AS (SELECT w1.ward, coalesce(CASE WHEN food > 0 THEN CAST(census_all AS DOUBLE) / food END, 0e0) AS w_all, coalesce(CASE WHEN known > 0 THEN CAST(food AS DOUBLE) / known END, 0e0) AS scale FROM w1 LEFT JOIN w0 USING (ward)),
w AS (SELECT cen.ward, cen.code, CASE WHEN coalesce(c.n, 0) * scale > 0 THEN CAST(cen.n AS DOUBLE) / (c.n * scale) ELSE w_all END AS weight FROM cen LEFT JOIN c USING (ward, code) JOIN wa ON wa.ward = cen.ward UNION ALL SELECT ward, 'all', w_all FROM wa)"""
_WJOIN = "wp AS (SELECT p.*, coalesce(w.weight, 1e0) AS weight FROM pairs p LEFT JOIN w ON w.ward = p.ward AND w.code = CASE WHEN p.mid = 'unknown' THEN 'all' ELSE p.mid END)"


def _weights(spark, sf):
    counts = d.counted(d.venues(spark, sf)).groupBy("ward", F.col("mid").alias("code")).agg(F.count("*").alias("n"))
    seg = F.col("c_mktsegment")
    code = F.when(seg == "BUILDING", "moving").when(seg == "AUTOMOBILE", "fixing").when(seg == "MACHINERY", "heavy").when(seg == "HOUSEHOLD", "table").otherwise("basic")
    census = d.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("ward"), code.alias("code")).agg(F.count("*").alias("n"))
    return stats.weights(counts, census)


@query(f"WITH {V}, {_WEIGHTS} SELECT ward, code, round(weight, 6) AS weight FROM w")
def area_weights(spark, sf):
    return _weights(spark, sf).select("ward", "code", F.round("weight", 6).alias("weight"))


@query(f"WITH {V}, {_WEIGHTS} SELECT code, round(min(weight), 6) AS least, round(max(weight), 6) AS most FROM w GROUP BY code")
def weight_range(spark, sf):
    return _weights(spark, sf).groupBy("code").agg(F.round(F.min("weight"), 6).alias("least"), F.round(F.max("weight"), 6).alias("most"))


def _weighted_counts(spark, sf, keys):
    """Stations with their spot, spot, radius, keys, n, n_w, and the weighed venues of the whole area."""
    area = stats.weighted(d.counted(d.venues(spark, sf)).withColumn("code", F.col("mid")), _weights(spark, sf)).select("lat", "lng", "major", "mid", "weight")
    return *_by_place(d.stations(spark, sf), area.select("lat", "lng", *keys, "weight"), d.RADII, keys, "weight"), area


@query(f"WITH {V}, {S}, {_PAIRS}, {_WEIGHTS}, {_WJOIN}, wt AS (SELECT station, radius, major, mid, sum(weight) AS nw FROM wp GROUP BY ALL), ws AS (SELECT *, CASE WHEN mid <> 'unknown' THEN nw / sum(CASE WHEN mid <> 'unknown' THEN nw END) OVER (PARTITION BY station, radius) END AS share FROM wt), wb0 AS (SELECT v.major, v.mid, sum(coalesce(w.weight, 1e0)) AS nw FROM venues v LEFT JOIN w ON w.ward = v.ward AND w.code = CASE WHEN v.mid = 'unknown' THEN 'all' ELSE v.mid END WHERE v.label <> 'excluded' GROUP BY 1, 2), wb AS (SELECT *, CASE WHEN mid <> 'unknown' THEN nw / sum(CASE WHEN mid <> 'unknown' THEN nw END) OVER () END AS base FROM wb0) SELECT station, radius, ws.major, ws.mid, round(ws.nw, 4) AS n_w, round(share / base, 6) AS lq_w FROM ws LEFT JOIN wb USING (major, mid)")
def weighted_lq(spark, sf):
    own, counts, area = _weighted_counts(spark, sf, ["major", "mid"])
    local = stats.shares(stats.tally(counts, _SPOT, "weight", summed=True), _SPOT, "n_w")
    base = stats.shares(stats.tally(area, [], "weight"), [], "n_w")
    t = stats.quotients(local, base).where("level = 'mid'").select("spot", "radius", "major", "mid", F.round("n_w", 4).alias("n_w"), F.round("lq", 6).alias("lq_w"))
    return own.join(t, "spot").select("station", "radius", "major", "mid", "n_w", "lq_w")


@query(f"WITH {V}, {S}, {_PAIRS}, {_WEIGHTS}, {_WJOIN} SELECT station, radius, round(sum(weight), 4) AS n_w, round(sum(weight) / nullif(max(passengers), 0) * 10000, 4) AS per_10k FROM wp GROUP BY 1, 2")
def per_10k(spark, sf):
    own, counts, _ = _weighted_counts(spark, sf, [])
    return own.join(counts, "spot").select("station", "radius", F.round("n_w", 4).alias("n_w"), F.round(stats.per_10k(F.col("n_w"), F.col("passengers")), 4).alias("per_10k"))


@query(_ALL + ", tot AS (SELECT station, radius, count(*) AS total FROM pairs GROUP BY 1, 2) SELECT station, radius, mid, n, CASE WHEN lq < 1 AND base_share * total >= 3 THEN 'low' WHEN lq > 1 AND n >= 3 THEN 'high' END AS note FROM lq JOIN tot USING (station, radius) WHERE level = 'mid'")
def notable_genres(spark, sf):
    own, t = _lq(spark, sf)
    mids = t.where("level = 'mid'").withColumn("total", F.sum("n").over(Window.partitionBy(*_SPOT)))
    return own.join(stats.notable(mids), "spot").select("station", "radius", "mid", "n", "note")


@query(f"WITH {V}, {S}, {_PAIRS}, n AS (SELECT station, radius, count(*) AS n FROM pairs GROUP BY 1, 2) SELECT s.station, r.radius, coalesce(n.n, 0) AS n FROM stations s CROSS JOIN (VALUES (1000), (2000), (5000)) r(radius) LEFT JOIN n ON n.station = s.station AND n.radius = r.radius")
def completion_zeros(spark, sf):
    own, counts = _counts(spark, sf, [])
    return stats.completed(_every_radius(own), counts, _SPOT, ["n"]).select("station", "radius", "n")


@query(f"WITH {V}, {S}, m AS (SELECT s.station, v.id, v.mid, {H('s.lat', 's.lng', 'v.lat', 'v.lng')} AS dist FROM stations s, venues v WHERE {H('s.lat', 's.lng', 'v.lat', 'v.lng')} <= 3000) SELECT station, id, round(dist, 3) AS dist_m FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY CASE WHEN mid = 'unknown' THEN 1 ELSE 0 END, round(dist, 3), id) AS k FROM m) WHERE k = 1")
def nearest_match(spark, sf):
    v = d.venues(spark, sf).select("id", "lat", "lng", "mid")
    return spatial.nearest(d.stations(spark, sf).select("station", "lat", "lng"), v, 3000, "id", first=F.when(F.col("mid") == "unknown", 1).otherwise(0)).select("station", "id", "dist_m")


@query(f"WITH {V}, {S}, m AS (SELECT s.station, v.id, round({H('s.lat', 's.lng', 'v.lat', 'v.lng')}, 3) AS dist_m FROM stations s, venues v WHERE {H('s.lat', 's.lng', 'v.lat', 'v.lng')} <= 2000) SELECT station, id, dist_m, k FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY dist_m, id) AS k FROM m) WHERE k <= 50")
def nearest_k(spark, sf):
    v = d.venues(spark, sf).select("id", "lat", "lng")
    return spatial.nearest_k(d.stations(spark, sf).select("station", "lat", "lng"), v, 2000, "id", 50).select("station", "id", "dist_m", "k")


_NEAR = f"""b AS (SELECT id, lat, lng, split_part(name, ' ', 2) AS core, label AS genre, CAST(floor(lat/0.01) AS BIGINT) AS cy, CAST(floor(lng/0.01) AS BIGINT) AS cx FROM venues),
e AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.id < b.id AND abs(a.cy - b.cy) <= 1 AND abs(a.cx - b.cx) <= 1 AND (a.genre = b.genre OR a.genre = 'unresolved' OR b.genre = 'unresolved') AND a.core = b.core
  AND sqrt(pow((b.lat - a.lat)*111320, 2) + pow((b.lng - a.lng)*111320*cos(radians(a.lat)), 2)) <= 400)"""


def _near(spark, sf):
    return d.venues(spark, sf).select(F.col("id").alias("row_id"), "lat", "lng", F.split("name", " ")[1].alias("core"), F.col("label").alias("genre"))


@query(f"WITH {V}, {_NEAR} SELECT a, b FROM e")
def near_pairs(spark, sf):
    return link.near_pairs(_near(spark, sf), 400.0, 0.01)


@query(f"WITH RECURSIVE {V}, {_NEAR}, s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT id, id FROM b UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x) SELECT x AS row_id, min(y) AS component FROM r GROUP BY x")
def dedupe_components(spark, sf):
    return link.near_components(_near(spark, sf), 400.0, 0.01)


@query(f"WITH RECURSIVE {V}, {_NEAR}, s AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r(x, y) AS (SELECT id, id FROM b UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x), c AS (SELECT x, min(y) AS component FROM r GROUP BY x), o AS (SELECT c.*, genre, row_number() OVER (PARTITION BY component ORDER BY genre = 'unresolved', x) AS k FROM c JOIN b ON b.id = c.x) SELECT o.x AS row_id, o.component, f.genre AS component_genre, f.x AS cluster FROM o JOIN o f ON f.component = o.component AND f.k = 1")
def representatives(spark, sf):
    rows = _near(spark, sf)
    return link.representatives(rows.join(link.near_components(rows, 400.0, 0.01), "row_id")).select("row_id", "component", "component_genre", "cluster")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def first_wins_dedupe(spark, sf):
    return link.first_wins(d.table(spark, sf, "events"), ["user_id", "event_type"], [F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END, CASE WHEN event_type = 'purchase' THEN -event_id ELSE event_id END) AS k FROM events) WHERE k = 1")
def flagged_dedupe(spark, sf):
    return link.flagged_wins(d.table(spark, sf, "events"), ["user_id"], F.col("event_type") == "purchase", "event_id").select("user_id", "event_id")


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def mode_first_seen(spark, sf):
    return stats.modes(d.table(spark, sf, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT o_custkey, round(sum(m), 2) AS total FROM (SELECT o_custkey, o_orderpriority, max(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1")
def max_then_sum(spark, sf):
    return stats.max_then_sum(d.table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "total").withColumn("total", F.round("total", 2))


_L = "l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1)"


@query(f"WITH {_L} SELECT d.doc_id, CASE WHEN coalesce(n_chars / 5000.0e0, 0) < 0.05 THEN 'unresolved' WHEN lang IN ('fr', 'de') THEN 'romance_or_german' WHEN l.quality = 1 THEN 'good' WHEN l.toxic = 1 THEN 'toxic' ELSE 'unresolved' END AS label, CASE WHEN coalesce(n_chars / 5000.0e0, 0) < 0.05 THEN 'low_confidence' WHEN lang IN ('fr', 'de') THEN 'name' WHEN l.quality = 1 THEN 'label' WHEN l.toxic = 1 THEN 'second' ELSE 'unresolved' END AS method FROM documents d LEFT JOIN l USING (doc_id)")
def evidence_fusion(spark, sf):
    docs = d.table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    lab = d.table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    ev = [("name", F.when(F.col("lang").isin("fr", "de"), "romance_or_german")), ("label", F.when(F.col("quality") == 1, "good")), ("second", F.when(F.col("toxic") == 1, "toxic"))]
    out = docs.join(lab, "doc_id", "left").withColumn("f", rules.fused(ev, F.col("n_chars") / 5000.0, 0.05))
    return out.select("doc_id", "f.label", "f.method")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def left_anti_todo(spark, sf):
    return label.todo(d.table(spark, sf, "documents").select("doc_id"), d.table(spark, sf, "labels"), "doc_id")


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS chunk, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 100 AS INTEGER) AS pos FROM documents")
def chunking(spark, sf):
    return order.chunked(d.table(spark, sf, "documents").select("doc_id"), "doc_id", 100).select("doc_id", "chunk", "pos")


@query("SELECT count(*) AS n, count(quality) AS a_adopted, count(toxic) AS b_adopted, count(*) FILTER (quality = t) AS a_correct, count(*) FILTER (toxic = t) AS b_correct, count(*) FILTER (quality = toxic) AS same, count(*) FILTER (quality = toxic AND quality <> t) AS same_wrong FROM (SELECT l.quality, l.toxic, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS t FROM labels l JOIN documents USING (doc_id))")
def label_eval(spark, sf):
    rows = d.table(spark, sf, "labels").join(d.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("t")), "doc_id")
    return label.evaluation(rows, "t", "quality", "toxic")


@query(f"WITH {V} SELECT count(*) AS compared, count(*) FILTER (a = b) AS agreed, CAST(count(*) FILTER (a = b) AS DOUBLE) / count(*) AS rate FROM (SELECT CASE WHEN major <> 'unknown' THEN major END AS a, CASE WHEN category IN ('LARGE', 'MEDIUM') THEN 'industry' WHEN category IN ('SMALL', 'ECONOMY') THEN 'home' END AS b FROM venues) WHERE a IS NOT NULL AND b IS NOT NULL")
def rule_agreement(spark, sf):
    v = d.venues(spark, sf)
    b = F.when(F.col("category").isin("LARGE", "MEDIUM"), "industry").when(F.col("category").isin("SMALL", "ECONOMY"), "home")
    return stats.agreement(v.select(F.when(F.col("major") != "unknown", F.col("major")).alias("a"), b.alias("b")), "a", "b")


@query("""WITH m AS (SELECT p_partkey AS id, '5339' || CAST(p_partkey % 8 AS VARCHAR) || CAST((p_partkey // 8) % 8 AS VARCHAR) || CAST(p_partkey % 10 AS VARCHAR) || CAST((p_partkey // 10) % 10 AS VARCHAR) || CAST(1 + p_partkey % 4 AS VARCHAR) AS code FROM part)
SELECT id, code, round(53/1.5e0 + CAST(code[5] AS INT)*(2e0/3)/8 + CAST(code[7] AS INT)*(2e0/3)/80 + ((CAST(code[9] AS INT)-1)//2)*(2e0/3)/160, 9) AS lat,
  round(39+100 + CAST(code[6] AS INT)/8e0 + CAST(code[8] AS INT)/80e0 + ((CAST(code[9] AS INT)-1)%2)/160e0, 9) AS lng FROM m""")
def mesh_bounds(spark, sf):
    k = F.col("p_partkey")
    code = F.concat(F.lit("5339"), (k % 8).cast("string"), (F.floor(k / 8) % 8).cast("string"), (k % 10).cast("string"), (F.floor(k / 10) % 10).cast("string"), (1 + k % 4).cast("string"))
    m = d.table(spark, sf, "part").select(k.alias("id"), code.alias("code")).withColumn("b", geo.mesh_bounds(F.col("code")))
    return m.select("id", "code", F.round("b.lat", 9).alias("lat"), F.round("b.lng", 9).alias("lng"))


@query(f"""WITH {V}, {S}, g AS (SELECT i, j FROM range(10) a(i), range(10) b(j)),
c AS (SELECT s.station, v.id, count(*) AS hundredths FROM stations s, venues v, g WHERE {H('s.lat', 's.lng', 'v.lat + (i + 0.5e0)*0.01e0/10', 'v.lng + (j + 0.5e0)*0.0125e0/10')} <= 2000 GROUP BY 1, 2)
SELECT station, CAST(sum(hundredths * (id % 97)) + 50 AS BIGINT) // 100 AS people, count(*) AS cells FROM c GROUP BY 1""")
def mesh_coverage(spark, sf):
    """Every part is a mesh cell.  Sums of hundredths are exact, so halves round alike in any order; cells at one place are covered alike."""
    scratch, s = Scratch(spark, "mesh"), d.stations(spark, sf).select("station", "lat", "lng")
    cells = d.venues(spark, sf).groupBy("lat", "lng").agg(F.sum(F.col("id") % 97).alias("people"), F.count("*").alias("cells"))
    p = scratch.table(spatial.place_pairs(s, cells, 2000 + 1500), "pairs")
    p = p.repartition(p.count() // 50_000 + 1)
    at = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumns({"i": F.floor(F.col("k") / 10), "j": F.col("k") % 10})
    near = geo.haversine(F.col("few_lat"), F.col("few_lng"), F.col("lat") + (F.col("i") + 0.5) * 0.01 / 10, F.col("lng") + (F.col("j") + 0.5) * 0.0125 / 10) <= 2000
    c = at.where(near).groupBy("few_lat", "few_lng", "lat", "lng").agg((F.count("*") / 100).cast("decimal(3,2)").alias("coverage"))
    c = c.join(cells, ["lat", "lng"]).withColumn("cells", F.col("cells") / F.col("coverage").cast("double"))
    per = stats.interpolated(c, ["people", "cells"], ["few_lat", "few_lng"]).withColumnsRenamed({"few_lat": "lat", "few_lng": "lng"})
    return s.join(per, ["lat", "lng"]).select("station", "people", "cells")


@query("SELECT event_id, coalesce(TRY_CAST(trim(json_extract_string(props, '$.k')) AS DOUBLE), 0) AS k, coalesce(TRY_CAST(trim(CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN '1,234' WHEN 2 THEN ' 12 ' ELSE '-' END) AS DOUBLE), 0) AS loose FROM events")
def lenient_number(spark, sf):
    e = F.col("event_id") % 4
    loose = F.when(e == 0, "*").when(e == 1, "1,234").when(e == 2, " 12 ").otherwise("-")
    return d.table(spark, sf, "events").select("event_id", text.lenient_number(F.get_json_object("props", "$.k")).alias("k"), text.lenient_number(loose).alias("loose"))


@query(f"WITH {V} SELECT id, CASE WHEN lng > 139.65 AND lng < 139.75 AND lat > 35.65 AND lat < 35.75 THEN 'west' ELSE 'east' END AS area FROM venues WHERE (lng > 139.65 AND lng < 139.75 AND lat > 35.65 AND lat < 35.75) OR (lng > 139.75001 AND lng < 139.82 AND lat > 35.62 AND lat < 35.78001)")
def point_in_polygon(spark, sf):
    areas = [("west", 0, spatial.open_box(139.65, 35.65, 139.75, 35.75)), ("east", 1, spatial.open_box(139.75001, 35.62, 139.82, 35.78001))]
    polygons = spark.createDataFrame(areas, "area string, ord int, ring array<struct<x: double, y: double>>")
    return spatial.polygon_join(d.venues(spark, sf).select("id", "lat", "lng"), polygons).select("id", "area")


@query(f"""WITH {V}, f AS (SELECT CAST(least(floor((lng - 139.6e0)/(139.6e0+0.25e0-139.6e0)*64), 63) AS BIGINT) AS x, CAST(least(floor((lat - 35.6e0)/(35.6e0+0.2e0-35.6e0)*64), 63) AS BIGINT) AS y FROM venues WHERE lng BETWEEN 139.6e0 AND 139.6e0+0.25e0 AND lat BETWEEN 35.6e0 AND 35.6e0+0.2e0),
c AS (SELECT d AS depth, x >> CAST(6 - d AS INTEGER) AS ix, y >> CAST(6 - d AS INTEGER) AS iy, count(*) AS n FROM f, range(7) r(d) GROUP BY ALL),
l AS (SELECT c.* FROM c LEFT JOIN c p ON p.depth = c.depth - 1 AND p.ix = c.ix >> 1 AND p.iy = c.iy >> 1 WHERE (c.depth = 0 OR p.n >= 40) AND (c.n < 40 OR c.depth = 6))
SELECT CAST(depth AS INTEGER) AS depth, ix, iy, n, CASE WHEN n >= 40 THEN 'saturated' ELSE 'ok' END AS status FROM l""")
def quadtree_leaves(spark, sf):
    return spatial.quadtree(d.venues(spark, sf), (139.6, 35.6, 139.6 + 0.25, 35.6 + 0.2), 40, 6)


@query("WITH s AS (SELECT s_suppkey, 'N' || CAST(s_nationkey % 10 AS VARCHAR) AS name, n_name AS line FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT s_suppkey, CASE WHEN count(*) OVER (PARTITION BY name) > 1 THEN name || '(' || line || ')' ELSE name END AS shown FROM s")
def disambiguate_names(spark, sf):
    s = d.table(spark, sf, "supplier").join(d.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    name = F.concat(F.lit("N"), (F.col("s_nationkey") % 10).cast("string"))
    s = s.select("s_suppkey", name.alias("name"), F.col("n_name").alias("line"))
    return s.select("s_suppkey", F.when(F.count("*").over(Window.partitionBy("name")) > 1, F.concat("name", F.lit("("), "line", F.lit(")"))).otherwise(F.col("name")).alias("shown"))


@query("WITH o AS (SELECT o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders), f AS (SELECT o_custkey, o_orderpriority, min(k) AS k FROM o GROUP BY 1, 2) SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY k) AS names FROM f GROUP BY 1")
def ordered_distinct_list(spark, sf):
    out = stats.ordered_names(d.table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey")])
    return out.select("o_custkey", F.array_join("names", "|").alias("names"))


@query("SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS bal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_sources(spark, sf):
    c = d.table(spark, sf, "customer").select(F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return c.unionByName(d.table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")))


@query("SELECT CAST(coalesce(c.k, s.k) AS BIGINT) AS nation, coalesce(c.n, 0) AS customers, coalesce(s.n, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s ON c.k = s.k")
def full_outer_stats(spark, sf):
    c = d.table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("customers"))
    s = d.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").na.fill(0)


@query(f"WITH {V}, f AS (SELECT label, count(*) AS n FROM venues GROUP BY 1), r AS (SELECT label, count(*) AS n FROM venues WHERE method = 'name' OR method = 'unresolved' GROUP BY 1), a AS (SELECT label, count(*) AS n FROM venues WHERE label <> 'excluded' GROUP BY 1), j AS (SELECT f.label, f.n AS final_n, coalesce(r.n, 0) AS rules_n, coalesce(a.n, 0) AS area_n FROM f LEFT JOIN r USING (label) LEFT JOIN a USING (label)), s AS (SELECT *, round(CAST(final_n AS DOUBLE) / sum(final_n) OVER (), 6) AS final_share, CASE WHEN label <> 'unresolved' THEN CAST(rules_n AS DOUBLE) / sum(CASE WHEN label <> 'unresolved' THEN rules_n END) OVER () END AS rs, CASE WHEN label <> 'unresolved' THEN CAST(area_n AS DOUBLE) / sum(CASE WHEN label <> 'unresolved' THEN area_n END) OVER () END AS ars FROM j) SELECT label, final_n, rules_n, area_n, final_share, round(rs, 6) AS rules_share, round(ars, 6) AS area_share, round(CASE WHEN ars <> 0 THEN rs / ars END, 6) AS lq FROM s")
def genre_table(spark, sf):
    v = d.venues(spark, sf).select("label", "method")
    t = stats.genre_table(v, v.where("method in ('name', 'unresolved')"), v.where("label <> 'excluded'"))
    return t.select("label", "final_n", "rules_n", "area_n", *[F.round(c, 6).alias(c) for c in ("final_share", "rules_share", "area_share", "lq")])


@query(f"WITH {V} SELECT label, row_number() OVER (ORDER BY min(id)) - 1 AS code FROM venues GROUP BY label")
def genre_dictionary(spark, sf):
    return order.dictionary(d.venues(spark, sf), "label", "id").select("label", F.col("code").cast("long").alias("code"))


@query(f"WITH {S} SELECT station, passengers, rank() OVER (ORDER BY passengers DESC) AS place FROM stations WHERE passengers IS NOT NULL")
def ridership_ranking(spark, sf):
    return order.ranked(d.stations(spark, sf).select("station", "passengers"), "passengers")


@query()
def name_scores(spark, sf):
    p = d.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("a"), F.concat(F.col("p_name"), F.lit(" "), F.lower("p_type")).alias("b"))
    a, b = text.core_name(F.col("a")), text.core_name(F.reverse("b"))
    return p.select("p_partkey", a.alias("core"), text.name_score(a, b).alias("score"), text.longest_common("a", "b").alias("common"), text.romaji("a").alias("latin"))


def _stub(prompt: str) -> str:
    import json

    rows = [line.split("\t") for line in prompt.split("\n")]
    return json.dumps({"items": [{"id": r[0], "label": "even" if int(r[1]) % 2 == 0 else "odd", "confidence": "high", "reason": ""} for r in rows]})


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS label FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def labeler_stub(spark, sf):
    chunks = order.chunked(left_anti_todo(spark, sf), "doc_id", 50)
    return label.collected(label.ask(label.prompts(chunks, ["doc_id"]), _stub), chunks, ["even", "odd"]).select("doc_id", "label")
