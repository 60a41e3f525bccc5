"""Tallies, shares, location quotients, weights and the other aggregations of place statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNKNOWN = "unknown"


def tally(rows: DataFrame, keys: list[str], weight: str | None = None, summed: bool = False) -> DataFrame:
    """keys, level (major or mid), major, mid, n[, n_w]: two grouping levels in one pass, partial sums before the shuffle.  summed: rows are
    sums already, with their number in n and, if weighted, their weight in n_w."""
    aggs = [(F.sum("n") if summed else F.count("*")).alias("n")] + ([F.sum("n_w" if summed else weight).alias("n_w")] if weight else [])
    sets = rows.groupingSets([[F.col(c) for c in (*keys, "major")], [F.col(c) for c in (*keys, "major", "mid")]], *[F.col(c) for c in (*keys, "major", "mid")])
    out = sets.agg(*aggs, F.grouping("mid").alias("__g"))
    return out.withColumn("level", F.when(F.col("__g") == 1, "major").otherwise("mid")).withColumn("mid", F.when(F.col("__g") == 0, F.col("mid")).otherwise(F.lit(""))).drop("__g")


def shares(t: DataFrame, keys: list[str], n: str = "n", out: str = "share") -> DataFrame:
    """Shares among known labels; the mid level's total spans all majors; unknown labels get null."""
    known = F.when(F.col("level") == "major", F.col("major") != UNKNOWN).otherwise(F.col("mid") != UNKNOWN)
    total = F.sum(F.when(known, F.col(n))).over(Window.partitionBy(*keys, "level"))
    return t.withColumn(out, F.when(known, F.try_divide(F.col(n).cast("double"), total)))


def quotients(local: DataFrame, base: DataFrame, share: str = "share", out: str = "lq") -> DataFrame:
    """Location quotient: the local share over the area's, from unrounded values; null where either is missing or the base is 0.
    base has a row per label, a number that the taxonomy bounds; the optimizer broadcasts it by its size."""
    b = base.select("level", "major", "mid", F.col(share).alias("base_share"))
    return local.join(b, ["level", "major", "mid"], "left").withColumn(out, F.try_divide(F.col(share), F.col("base_share")))


def per_10k(n: Column, passengers: Column) -> Column:
    return F.try_divide(n, F.nullif(passengers, F.lit(0))) * 10000


def weights(counts: DataFrame, census: DataFrame) -> DataFrame:
    """ward, code, weight, with a row `all` per ward.  counts: ward, code (a census code or unknown; retail left out), n; census: ward, code, n.

    food = known + unknown, scale = food / known; weight = census / (count * scale), or the ward's census / food where that is 0."""
    known = F.sum(F.when(F.col("code") != UNKNOWN, F.col("n")))
    ward = counts.groupBy("ward").agg(F.coalesce(known, F.lit(0)).alias("known"), F.sum("n").alias("food"))
    total = census.groupBy("ward").agg(F.sum("n").alias("census_all"))
    ward = total.join(ward, "ward", "left").withColumn("w_all", F.coalesce(F.try_divide(F.col("census_all").cast("double"), F.col("food")), F.lit(0.0)))
    scale = F.coalesce(F.try_divide(F.col("food").cast("double"), F.col("known")), F.lit(0.0))
    c = counts.select("ward", "code", F.col("n").alias("observed"))
    cell = census.select("ward", "code", "n").join(c, ["ward", "code"], "left").join(ward, "ward")
    w = F.try_divide(F.col("n").cast("double"), F.coalesce("observed", F.lit(0)) * scale)
    cells = cell.select("ward", "code", F.coalesce(w, F.col("w_all")).alias("weight"))
    return cells.unionByName(ward.select("ward", F.lit("all").alias("code"), F.col("w_all").alias("weight")))


def weighted(rows: DataFrame, w: DataFrame, plain: tuple[str, ...] = (UNKNOWN, "retail")) -> DataFrame:
    """rows (ward, code, ...) with weight: unknown and retail take the ward's, a missing one is 1.0."""
    key = F.when(F.col("code").isin(*plain), F.lit("all")).otherwise(F.col("code"))
    return rows.withColumn("__code", key).join(w.withColumnRenamed("code", "__code"), ["ward", "__code"], "left").drop("__code").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def wide(rows: DataFrame, keys: list[str], name: str, value: str, order: list[str]) -> DataFrame:
    """Long to wide with a column per name, in a fixed order."""
    return rows.groupBy(*keys).pivot(name, order).agg(F.first(value))


def rings(rows: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Counts between successive radii from counts within radii."""
    before = F.lag(n).over(Window.partitionBy(*keys).orderBy("radius"))
    return rows.withColumn("ring_n", F.col(n) - F.coalesce(before, F.lit(0)))


def ring_quotients(rows: DataFrame, keys: list[str], base: DataFrame) -> DataFrame:
    """rows (keys, radius, level, major, mid, n: counts within radii) with ring_n, and share and lq of the ring between a radius and the one
    before, from the ring's own counts.  A label without venues in a ring has quotient 0; a ring without known labels has none."""
    r = rings(rows, [*keys, "level", "major", "mid"])
    return quotients(shares(r, [*keys, "radius"], "ring_n"), base)


def completed(keys: DataFrame, facts: DataFrame, on: list[str], values: list[str], flags: DataFrame | None = None) -> DataFrame:
    """Every key, missing values 0; with flags (on, further columns), these come along for every key, whether it has facts or not."""
    out = keys.join(facts, on, "left").na.fill(0, values)
    return out if flags is None else out.join(flags, on, "left")


def grouped_last(rows: DataFrame, key: Column, ord_col: str, last: list[str], out: str = "name") -> DataFrame:
    """A row per derived key with its number of rows, n, and of the columns in `last` the values of the last row by ord_col."""
    return rows.groupBy(key.alias(out)).agg(F.count("*").alias("n"), F.max_by(F.struct(*last), ord_col).alias("__l")).select(out, "n", *[F.col(f"__l.{c}").alias(c) for c in last])


def disambiguated(rows: DataFrame, name: str, shown: Column, out: str = "shown") -> DataFrame:
    """rows with the name to show: a name that several rows have gets its hint in brackets, where it has one.  Rows of a name are counted before
    they meet the count, so a frequent name is one row of the smaller side."""
    often = rows.groupBy(name).agg(F.count("*").alias("__n"))
    several = (F.col("__n") > 1) & (F.coalesce(shown, F.lit("")) != "")
    return rows.join(often, name).withColumn(out, F.when(several, F.concat(F.col(name), F.lit("（"), shown, F.lit("）"))).otherwise(F.col(name))).drop("__n")


def notable(rows: DataFrame, total: str = "total", least: int = 3) -> DataFrame:
    """Marks few labels where at least `least` are expected, many where at least `least` are there."""
    expected = F.col("base_share") * F.col(total)
    return rows.withColumn("note", F.when((F.col("lq") < 1) & (expected >= least), "low").when((F.col("lq") > 1) & (F.col("n") >= least), "high"))


def modes(rows: DataFrame, keys: list[str], value: str, ord_col: str) -> DataFrame:
    """keys, value, n: the most frequent value, of ties the one seen first."""
    c = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(ord_col).alias("__first"))
    best = c.groupBy(*keys).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("__first"))).alias("__m"))
    return best.select(*keys, F.col(f"__m.{value}").alias(value), F.col("__m.n").alias("n"))


def max_then_sum(rows: DataFrame, keys: list[str], part: str, value: str, out: str) -> DataFrame:
    """Sum over parts of the largest value of each."""
    return rows.groupBy(*keys, part).agg(F.max(value).alias("__v")).groupBy(*keys).agg(F.sum("__v").alias(out))


def ordered_names(rows: DataFrame, keys: list[str], name: str, order: list[Column]) -> DataFrame:
    """keys, names: distinct names in order of first appearance."""
    first = rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).groupBy(*keys, name).agg(F.min("__k").alias("__k"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__k", name))).alias("__l")).select(*keys, F.col(f"__l.{name}").alias("names"))


def interpolated(pairs: DataFrame, values: list[str], keys: list[str]) -> DataFrame:
    """Area totals: each cell's values by its coverage, summed and rounded.  pairs: keys, coverage, values."""
    return pairs.groupBy(*keys).agg(*[F.round(F.sum(F.col(v) * F.col("coverage"))).cast("long").alias(v) for v in values])


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    return rows.agg(F.count_if(both).alias("compared"), F.count_if(both & (F.col(a) == F.col(b))).alias("agreed")).withColumn("rate", F.try_divide(F.col("agreed").cast("double"), F.col("compared")))


def genre_table(final: DataFrame, rules: DataFrame, area: DataFrame, label: str = "label", unresolved: str = "unresolved") -> DataFrame:
    """Counts of three sources side by side with shares and the quotient of the rules-only share to the area's; final shares count
    unresolved rows, the quotient's shares do not."""
    out = None
    for name, rows in (("final", final), ("rules", rules), ("area", area)):
        c = rows.groupBy(label).agg(F.count("*").alias(f"{name}_n"))
        out = c if out is None else out.join(c, label, "full")
    out = out.na.fill(0, ["final_n", "rules_n", "area_n"])
    known = F.col(label) != unresolved
    total = out.agg(F.sum("final_n").alias("t_final"), F.sum(F.when(known, F.col("rules_n"))).alias("t_rules"), F.sum(F.when(known, F.col("area_n"))).alias("t_area"))
    out = out.crossJoin(F.broadcast(total))  # one row of totals
    out = out.withColumns({"final_share": F.try_divide(F.col("final_n").cast("double"), "t_final"), "rules_share": F.when(known, F.try_divide(F.col("rules_n").cast("double"), "t_rules")), "area_share": F.when(known, F.try_divide(F.col("area_n").cast("double"), "t_area"))})
    return out.withColumn("lq", F.try_divide("rules_share", "area_share")).drop("t_final", "t_rules", "t_area")


def categorical(value: Column, order: list[str]) -> Column:
    """The place of a value in a fixed order; others come last."""
    at = F.array_position(F.array(*[F.lit(x) for x in order]), value)
    return F.when(at == 0, len(order) + 1).otherwise(at).cast("int")


def totals(rows: DataFrame, keys: list[str], summed: bool = False) -> DataFrame:
    """keys, total, unknown_major, unknown_mid.  summed: rows are sums already, with their number in n."""
    n = F.col("n") if summed else F.lit(1)
    unknown = [F.sum(F.when(F.col(c) == UNKNOWN, n).otherwise(0)).alias(f"unknown_{c}") for c in ("major", "mid")]
    return rows.groupBy(*keys).agg(F.sum(n).alias("total"), *unknown)


def name_rollup(rows: DataFrame, ord_col: str) -> DataFrame:
    """name, n, category, address: per name its count, most frequent category (first seen of ties) and first address."""
    base = rows.groupBy("name").agg(F.count("*").alias("n"), F.min_by("address", ord_col).alias("address"))
    return base.join(modes(rows, ["name"], "category", ord_col).select("name", "category"), "name")


def disagreements(rows: DataFrame, a: str, b: str) -> DataFrame:
    """The rows in which both are there and differ."""
    return rows.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))


def accuracy_by(rows: DataFrame, band: str, truth: str, said: str) -> DataFrame:
    """band, n, correct, rate."""
    return rows.groupBy(band).agg(F.count("*").alias("n"), F.count_if(F.col(said) == F.col(truth)).alias("correct")).withColumn("rate", F.col("correct") / F.col("n"))


def with_area_row(rows: DataFrame, whole: DataFrame, name: str = "_area") -> DataFrame:
    """Station rows and one row (radius 0) for the whole area.  rows: station, radius, values; whole: values."""
    return rows.unionByName(whole.select(F.lit(name).alias("station"), F.lit(0).alias("radius"), "*"))


def address_rollup(blocks: DataFrame) -> DataFrame:
    """town, chomes (a sorted list of chome, lat, lng): a chome lies at the rounded mean of its blocks' fixed-point positions."""
    mean = blocks.groupBy("town", "chome").agg(F.round(F.avg("lat5")).cast("long").alias("lat5"), F.round(F.avg("lng5")).cast("long").alias("lng5"))
    return mean.groupBy("town").agg(F.array_sort(F.collect_list(F.struct("chome", "lat5", "lng5"))).alias("chomes"))


def ratios(rows: DataFrame, key: str, groups: dict[str, list]) -> DataFrame:
    """code, ratio of all and of each group of areas: sums of `observed` over sums of `census`, rounded to 2 places."""
    def ratio(where: Column) -> Column:
        return F.round(F.try_divide(F.sum(F.when(where, F.col("observed"))).cast("double"), F.sum(F.when(where, F.col("census")))), 2)

    return rows.groupBy("code").agg(ratio(F.lit(True)).alias("ratio_all"), *[ratio(F.col(key).isin(*members)).alias(f"ratio_{g}") for g, members in groups.items()])


def with_notes(rows: DataFrame, notes: DataFrame, key: str) -> DataFrame:
    """rows with the note of their key; a note that fits no row is an error."""
    orphans = [r[key] for r in notes.join(rows, key, "left_anti").select(key).limit(5).collect()]
    if orphans:
        raise ValueError(f"notes without a row: {orphans}")
    return rows.join(notes, key, "left")
