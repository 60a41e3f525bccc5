"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with header; a byte-order mark is dropped and quotes within fields are doubled quotes."""
    return spark.read.csv(path, header=True, schema=schema, escape='"', enforceSchema=False)


def optional(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A CSV that may be absent: then an empty table."""
    if path:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return csv(spark, path, schema)
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def items(row: Column, schema: str) -> Column:
    """The list in a response of unsure shape: the array itself or one of the usual fields."""
    kind = f"array<{schema}>"
    fields = [F.from_json(F.get_json_object(row, f"$.{f}"), kind) for f in ("results", "items", "data", "pois", "features")]
    return F.coalesce(F.when(F.ltrim(row).startswith("["), F.from_json(row, kind)), *fields, F.array().cast(kind))


def map_elements(spark: SparkSession, path) -> DataFrame:
    """id, type, lat, lng, tags, names of map elements that have a place and a name."""
    schema = "elements array<struct<type: string, id: long, lat: double, lon: double, center: struct<lat: double, lon: double>, tags: map<string, string>>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("elements").alias("ord", "e")).select("ord", "e.*")
    names = F.filter(F.array(*[F.col("tags")[k] for k in ("name", "name:ja", "name:en", "alt_name", "brand")]), lambda n: n.isNotNull())
    out = e.select("ord", "type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lng"), "tags", names.alias("names"))
    return out.where(F.col("lat").isNotNull() & (F.size("names") > 0))


def geojson(spark: SparkSession, path, properties: str) -> DataFrame:
    """Features with their properties and vertices (array<struct<x, y>>) of points and lines."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    f = spark.read.schema(schema).json(path, multiLine=True).select(F.posexplode("features").alias("ord", "f"))
    return f.select("ord", "f.properties.*", F.col("f.geometry.type").alias("geometry"), vertices(F.col("f.geometry.type"), F.col("f.geometry.coordinates")).alias("vertices"))


def vertices(kind: Column, coordinates: Column) -> Column:
    point = F.array(F.from_json(coordinates, "array<double>"))
    line = F.from_json(coordinates, "array<array<double>>")
    lines = F.flatten(F.from_json(coordinates, "array<array<array<double>>>"))
    all_of = F.when(kind == "Point", point).when(kind == "LineString", line).when(kind.isin("MultiLineString", "Polygon"), lines).otherwise(F.raise_error(F.concat(F.lit("no vertices for "), kind)).cast("array<array<double>>"))
    return F.transform(all_of, lambda v: F.struct(F.get(v, 0).alias("x"), F.get(v, 1).alias("y")))


def two_header(spark: SparkSession, paths: list[str], key: str = "KEY_CODE") -> DataFrame:
    """code, col, label, value of CSV files with a row of column codes and a row of labels, in UTF-8 (with mark) or code page 932.
    A later file overrides an earlier one in the same cell; keys that are not digits are dropped."""
    import pandas as pd

    files = None
    for n, p in enumerate(paths):
        f = spark.read.format("binaryFile").load(p).select(F.lit(n).alias("file_no"), "content")
        files = f if files is None else files.unionByName(f)

    def run(frames):
        import csv as reader
        import io

        for f in frames:
            for no, content in zip(f["file_no"], f["content"]):
                try:
                    body = bytes(content).decode("utf-8-sig")
                except UnicodeDecodeError:
                    body = bytes(content).decode("cp932")
                rows = reader.reader(io.StringIO(body))
                codes, labels = next(rows), next(rows)
                at = codes.index(key)
                out = [(r[at].strip(), c, l, v, no) for r in rows if len(r) > at and r[at].strip().isdigit() for k, (c, l, v) in enumerate(zip(codes, labels, r)) if k != at]
                yield pd.DataFrame(out, columns=["code", "col", "label", "value", "file_no"])

    cells = files.mapInPandas(run, "code string, col string, label string, value string, file_no int")
    return cells.groupBy("code", "col").agg(F.max_by("label", "file_no").alias("label"), F.max_by("value", "file_no").alias("value"))


def resolve(spec: str, labels: dict[str, str]) -> dict[str, list[str]]:
    """out=a+b,... -> columns; a name is a code, a label, or part of a label, in this order; an unknown one is an error."""
    out = {}
    for item in filter(None, spec.split(",")):
        name, _, terms = item.partition("=")
        found = []
        for t in (terms or name).split("+"):
            hit = t if t in labels else next((c for c, l in labels.items() if l == t), None) or next((c for c, l in labels.items() if t in l), None)
            if hit is None:
                raise KeyError(f"no column for {t!r}")
            found.append(hit)
        out[name] = found
    return out


def newest(spark: SparkSession, pattern: str) -> str | None:
    """The last path, by name, that fits a glob."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []
    return max((s.getPath().toString() for s in found), default=None)


def write_csv(df: DataFrame, path: str, fields: list[str], mode: str = "errorifexists", mark: bool = False) -> None:
    """CSV with these fields in this order; mode append adds files; mark puts a byte-order mark before the first header name."""
    out = df.select(*fields)
    if mark:
        out = out.withColumnRenamed(fields[0], "﻿" + fields[0])
    out.write.mode(mode).csv(path, header=True, escape='"')


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_report(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).write.text(path)


def column_json(df: DataFrame, ord_col: str, fields: list[str]) -> DataFrame:
    """One row: the table as a JSON object of column arrays, rows in order.  For tables that fit one value."""
    rows = F.array_sort(F.collect_list(F.struct(ord_col, *fields)))
    return df.agg(rows.alias("r")).select(F.to_json(F.struct(*[F.col(f"r.{f}").alias(f) for f in fields])).alias("json"))


def inspect(df: DataFrame) -> DataFrame:
    """name, kind, ord of the columns."""
    return df.sparkSession.createDataFrame([(f.name, f.dataType.simpleString(), i) for i, f in enumerate(df.schema)], "name string, kind string, ord int")


def station_list(spark: SparkSession, path: str | None, constants: list[tuple]) -> DataFrame:
    """key, name, lat, lng, passengers from a CSV, an empty number of passengers being null, or from constants where there is no path."""
    if not path:
        return spark.createDataFrame(constants, "key string, name string, lat double, lng double, passengers long")
    rows = csv(spark, path, "key string, name string, lat double, lng double, passengers string")
    return rows.withColumn("passengers", F.trim("passengers").try_cast("long"))


def census_cells(rows: DataFrame, prefix: str, codes: list[str], areas: int) -> DataFrame:
    """area, code, n of a census sheet given as CSV (area, item, n): items that begin with a three-character code and "_", areas by prefix.
    Anything but `areas` areas with all codes each is an error."""
    code = F.substring("item", 1, 3)
    out = rows.where(F.col("area").startswith(prefix) & code.isin(*codes) & (F.substring("item", 4, 1) == "_")).select("area", code.alias("code"), "n")
    found = out.groupBy("area").agg(F.count_distinct("code").alias("k")).agg(F.count("*").alias("areas"), F.min("k").alias("least")).first()
    if found["areas"] != areas or found["least"] != len(codes):
        raise ValueError(f"expected {areas} areas with {len(codes)} codes, found {found['areas']} with {found['least']} or more")
    return out
