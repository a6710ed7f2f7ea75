"""Spatial layers as Parquet with WKT, GeoJSON, CSV and JDBC, and tables that are replaced as a whole; every path goes
through Spark's own readers and writers."""

from __future__ import annotations

import os
import time
import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import PARTS, bounds, from_wkt, oriented, point, to_wkt
from ..operators.spatial import simplify


BOUNDS = ("xmin", "ymin", "xmax", "ymax")


def scan_layer(spark: SparkSession, base: str, layer: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """One layer of a folder that is partitioned by layer, with its parts; box: only shapes whose bounds meet it, by the
    numbers beside the WKT, so that files and row groups elsewhere are not read."""
    rows = spark.read.parquet(base).where(F.col("layer") == layer)
    if box:
        rows = rows.where((F.col("xmin") <= box[2]) & (F.col("xmax") >= box[0]) & (F.col("ymin") <= box[3]) & (F.col("ymax") >= box[1]))
    return rows.drop(*BOUNDS).withColumn("parts", from_wkt(F.col("geometry_wkt")))


def write_layers(df: DataFrame, base: str, tasks: int | None = None) -> None:
    """df with layer and parts, as WKT by layer with the bounds of each shape. Rows of a layer are in order of a curve
    through the plane (the interleaved bits of their middle's place within the layers' bounds), so that a file holds
    neighbours. A null shape has null bounds."""
    b = bounds(F.col("parts"))
    df = df.withColumns({c: b[c] for c in BOUNDS})
    whole = df.agg(F.min("xmin").alias("x"), F.min("ymin").alias("y"), F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.lit(0.0))), F.max("xmax").alias("p"), F.max("ymax").alias("q")).first()
    order = [F.col("layer")]
    if whole.x is not None:
        step = max(whole.p - whole.x, whole.q - whole.y) / 65535 or 1.0
        place = lambda low, high, start: F.floor(((F.col(low) + F.col(high)) / 2 - start) / step).cast("long")
        order.append(curve(place("xmin", "xmax", whole.x), place("ymin", "ymax", whole.y)))
    rows = df.withColumn("geometry_wkt", to_wkt(F.col("parts"))).drop("parts")
    dealt = rows.repartitionByRange(tasks, *order) if tasks else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.partitionBy("layer").parquet(base)


def curve(x: Column, y: Column, bits: int = 16) -> Column:
    """The place on the curve that interleaves the bits of two whole numbers."""
    spread = lambda v, shift: [F.shiftleft(F.shiftright(v, k).bitwiseAND(F.lit(1).cast("long")), 2 * k + shift) for k in range(bits)]
    total = F.lit(0).cast("long")
    for bit in spread(x, 0) + spread(y, 1):
        total = total.bitwiseOR(bit)
    return total


def write_layer_csv(df: DataFrame, path: str) -> None:
    """A layer as CSV with a header, its shapes as WKT."""
    df.withColumn("geometry_wkt", to_wkt(F.col("parts"))).drop("parts").write.option("header", True).csv(path)


#: The file that names a table's present version.
POINTER = "CURRENT"


def replace_parquet(df: DataFrame, path: str, keep: int = 2) -> None:
    """df as the new version of the table at path, which read_current reads.

    A version is a folder of its own; the file POINTER names the present one and is replaced by one rename, so a reader
    meets the old or the new table and a job that fails on the way leaves the old one. The last `keep` versions stay, for
    readers that are still on the one before. On object stores without an atomic rename the pointer is a copy.
    """
    spark, version = df.sparkSession, f"v-{time.time_ns():020}-{uuid.uuid4().hex[:8]}"
    jvm = spark.sparkContext._jvm
    of = lambda name: jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = jvm.org.apache.hadoop.fs.FileSystem.newInstance(of(POINTER).toUri(), conf)
    files.setWriteChecksum(False)  # a checksum beside the pointer would be a second file to rename
    df.write.parquet(of(version).toString())
    out = files.create(of(f"{version}.next"), False)
    out.write(bytearray(version, "utf-8"))
    out.close()
    next_, pointer = (files.makeQualified(of(name)) for name in (f"{version}.next", POINTER))
    if files.getUri().getScheme() == "file":
        os.replace(next_.toUri().getPath(), pointer.toUri().getPath())
    else:
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf).rename(next_, pointer, how)
    held = sorted(f.getPath().getName() for f in files.listStatus(jvm.org.apache.hadoop.fs.Path(path)) if f.isDirectory())
    for old in [v for v in held if v.startswith("v-") and v <= version][:-keep]:
        files.delete(of(old), True)
    files.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The present version of a table that replace_parquet writes."""
    return spark.read.parquet(f"{path}/{spark.read.text(f'{path}/{POINTER}').first()[0]}")


def save_table(df: DataFrame, name: str, path: str | None = None) -> int:
    """df as a table of the session's catalog in place of one of that name, its files at path or in the warehouse. The rows that the table holds, which must
    be as many as were written."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    held = df.sparkSession.table(name).count()
    if held != seen.get["n"]:
        raise RuntimeError(f"{name} holds {held} rows of {seen.get['n']} written")
    return held


def register_views(scales: dict[str, DataFrame]) -> None:
    """Each scale's table as a view of its name, for SQL."""
    for name, df in scales.items():
        df.createOrReplaceTempView(name)


def scan_jdbc(spark: SparkSession, url: str, query: str, by: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A source query; its filter and grouping run in the database. by: (whole-number column of the query's result, low,
    high, tasks) reads it in ranges of that column, one connection a task; rows beyond low and high are read too."""
    if by is None:
        return spark.read.format("jdbc").options(url=url, query=query, **options).load()
    column, low, high, tasks = by
    ranges = {"partitionColumn": column, "lowerBound": low, "upperBound": high, "numPartitions": tasks}
    return spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **ranges, **options).load()


def scan_flows_csv(spark: SparkSession, path: str, columns: tuple[str, ...] = ("source", "sink", "count")) -> DataFrame:
    """Columns of a CSV file with a header, as texts."""
    return spark.read.option("header", True).csv(path).select(*columns)


def geojson(parts: Column, digits: int | None = None) -> Column:
    """The geometry as JSON text: Polygon for one part, MultiPolygon for more; outer rings turn left."""
    near = (lambda c: F.bround(c, digits)) if digits is not None else (lambda c: c)
    made = F.transform(oriented(parts), lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.array(near(v["x"]), near(v["y"])))))
    text = lambda kind, c: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), F.to_json(c), F.lit("}"))
    return F.when(F.size(parts) == 1, text("Polygon", made[0])).otherwise(text("MultiPolygon", made))


def features(df: DataFrame, id_column: str, geometry: Column, properties: list[str]) -> DataFrame:
    """(id, feature): each row as one GeoJSON feature with a top-level id, a line of newline-delimited GeoJSON."""
    head = F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(id_column).cast("string").alias("id"), F.struct(*properties).alias("properties")))
    body = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}"))
    return df.select(F.col(id_column).cast("string").alias("id"), body.alias("feature"))


def write_features(made: DataFrame, path: str) -> None:
    made.select("feature").write.text(path)


def write_collection(made: DataFrame, path: str, most: int = 100_000) -> None:
    """FeatureCollection documents. One document is one task, so a layer of more than `most` features becomes several
    documents of some `most` features each, dealt by id to folders, which read_collection reads as one."""
    n, document = -(-made.count() // most), F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}"))
    if n <= 1:
        made.coalesce(1).agg(document.alias("value")).write.text(path)
    else:
        at = F.pmod(F.xxhash64("id", "feature"), F.lit(n))
        made.groupBy(at.alias("document")).agg(document.alias("value")).write.partitionBy("document").text(path)


def _shapes(rows: DataFrame) -> DataFrame:
    """Features f as id, properties, geometry_type and parts; other geometries have null parts."""
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    read = F.when(kind == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))).when(kind == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    parts = F.transform(read, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: point(v[0], v[1]))))
    return rows.select("f.id", "f.properties.*", kind.alias("geometry_type"), parts.cast(PARTS).alias("parts"))


def read_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """id, properties, geometry_type and parts of newline-delimited features."""
    shape = f"type string, id string, properties struct<{properties}>, geometry struct<type:string,coordinates:string>"
    return _shapes(spark.read.text(path).select(F.from_json("value", shape).alias("f")))


def read_collection(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """The same of FeatureCollection documents (one document is one task)."""
    shape = f"type string, features array<struct<id:string,properties:struct<{properties}>,geometry:struct<type:string,coordinates:string>>>"
    rows = spark.read.option("multiLine", True).schema(shape).json(path)
    return _shapes(rows.select(F.explode("features").alias("f")))


def export_scale(df: DataFrame, id_column: str, name: str, folder: str, tolerance: float = 0.0, digits: int | None = None) -> Row:
    """Geometry as features (the id, and parts simplified by tolerance) at folder/name.geojson, and all attributes
    at folder/name_stats; both share the id. The numbers of rows, features and attribute columns written."""
    shapes = df.select(id_column, "parts")
    shapes = simplify(shapes, tolerance) if tolerance else shapes
    stats, geometry = Observation(), Observation()
    made = features(shapes, id_column, geojson(F.col("parts"), digits), [id_column])
    write_features(made.observe(geometry, F.count(F.lit(1)).alias("n")), f"{folder}/{name}.geojson")
    df.drop("parts").observe(stats, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{name}_stats")
    return Row(scale=name, n_rows=stats.get["n"], n_features=geometry.get["n"], n_columns=len(df.columns) - 2)
