"""Processing of whole spatial scales: grids, administrative areas, postcodes, boundaries, centroids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions.geometry import area, centroid, from_wkt, rd_to_wgs84, reproject, to_wkt
from ..operators import clean, spatial
from ..sources import layers
from ..sources.scratch import staged


def process_grid(cells: DataFrame, boundary: DataFrame, id_column: str, populated: str | None = None, buffer: float = 2000.0, tile: float = 12000.0) -> DataFrame:
    """Cells (x, y, attributes) whose centre lies in the boundary: coarse box, exact test, cleaning, WGS84 points.

    The boundary is staged: its box is read first, its sides after. No cell inside gives an empty result with all
    columns that are not numbers.
    """
    boundary = staged(boundary.select("parts"))
    near = spatial.in_bbox(cells, spatial.bbox(boundary), buffer)
    inside = spatial.points_in_areas(near, boundary.select(F.xxhash64("parts").alias("_area"), "parts"), "_area", tile)
    inside = staged(inside.drop("_area").dropDuplicates([id_column]))  # read twice: for its columns and its rows
    rows = clean.null_suppressed(clean.drop_suppressed_columns(inside))
    rows = clean.populated(rows, populated) if populated else rows
    lng, lat = rd_to_wgs84(F.col("x"), F.col("y"))
    return rows.withColumn("lng", F.bround(lng, 5)).withColumn("lat", F.bround(lat, 5)).drop("x", "y")


def process_admin_scale(stats: DataFrame, layer: DataFrame, stats_id: str, layer_id: str, clip: DataFrame | None = None, tolerance: float = 0.0005, tile: float = 12000.0) -> DataFrame:
    """A layer with its statistics: cleaned, clipped, without water, joined, in WGS84 and simplified.

    Codes are nulled on both sides, so none survives into the result.
    """
    stats = clean.drop_columns_like(clean.null_suppressed(stats))
    shapes = clean.only_listed(layer, layer_id, stats, stats_id)
    shapes = spatial.touching(shapes, clip, layer_id, tile) if clip is not None else shapes
    shapes = clean.not_water(clean.null_suppressed(shapes))
    stats = clean.only_listed(stats, stats_id, shapes, layer_id)
    joined = clean.join_stats(shapes, stats, layer_id, stats_id)
    return spatial.simplify(joined.withColumn("parts", reproject(F.col("parts"))), tolerance)


def export_grid(rows: DataFrame, cells: DataFrame, id_column: str, name: str, folder: str) -> Row:
    """A processed grid as point features (top-level id) at folder/name.geojson and attributes at folder/name_stats;
    the rows and the columns kept and dropped on the way from cells."""
    at = F.concat(F.lit('{"type":"Point","coordinates":'), F.to_json(F.array("lng", "lat")), F.lit("}"))
    layers.write_features(layers.features(rows, id_column, at, [id_column]), f"{folder}/{name}.geojson")
    stats, seen = rows.drop("lng", "lat"), Observation()
    stats.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{folder}/{name}_stats")
    gone = clean.schema_difference(cells.drop("x", "y"), stats)[0]
    return Row(scale=name, n_rows=seen.get["n"], n_columns=len(stats.columns) - 1, n_dropped=len(gone))


def process_postcodes(layer: DataFrame, clip: DataFrame, code: str, tolerance: float = 0.0005, tile: float = 12000.0) -> DataFrame:
    rows = clean.null_suppressed(spatial.touching(layer, clip, code, tile))
    return spatial.simplify(rows.withColumn("parts", reproject(F.col("parts"))), tolerance)


def postcodes_of(layer: DataFrame, lookup: DataFrame, code: str, lookup_code: str, province: str, wanted: str) -> DataFrame:
    """Postcodes of a province by a finer lookup; all of them if the lookup lacks its columns."""
    if not {lookup_code, province} <= set(lookup.columns):
        return layer
    pairs = lookup.select(lookup_code, province).distinct().where(F.col(province) == wanted)
    return clean.only_listed(layer, code, pairs, lookup_code)


def old_extract(layer: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float, wkt: str = "geometry_wkt") -> DataFrame:
    """Rows whose first vertex, read from the text of a MULTIPOLYGON, lies in the box; texts of other shapes go. Their
    shapes come in WGS84, as parts and as text."""
    number = lambda i: F.regexp_extract(wkt, r"\(\(\(\s*(-?[0-9.]+)\s+(-?[0-9.]+)", i).try_cast("double")
    rows = layer.withColumn("x", number(1)).withColumn("y", number(2)).where(F.col("x").between(xmin, xmax) & F.col("y").between(ymin, ymax))
    return rows.withColumn("parts", reproject(from_wkt(F.col(wkt)))).withColumn(wkt, to_wkt(F.col("parts")))


def build_boundary(layer: DataFrame, code: str, codes: list[str]) -> DataFrame:
    """(parts): the union of the listed areas; a listed code that the layer lacks is an error."""
    wanted = layer.sparkSession.createDataFrame([(c,) for c in codes], "code string")
    clean.require_codes(layer.select(F.col(code).alias("code")), "code", wanted, strict=True)
    return spatial.dissolve(layer.where(F.col(code).isin(*codes)).select(F.lit(1).alias("_all"), "parts"), "_all").select("parts")


def boundary_levels(layer: DataFrame, levels: DataFrame, code: str, sea: tuple[float, float, float, float] | None = None, tolerance: float = 0.0) -> DataFrame:
    """(level, parts) for all levels in one grouped dissolve; levels: (level, code), codes may be in several."""
    rows = layer.join(levels.select("level", F.col("code").alias("_code")), F.col(code) == F.col("_code")).select("level", "parts")
    made = spatial.dissolve(rows, "level")
    made = spatial.clip_to_box(made, *sea) if sea else made
    return spatial.simplify(made, tolerance) if tolerance else made


def centroid_table(layer: DataFrame, code: str, overrides: dict[str, tuple[float, float]] | None = None, digits: int = 6) -> DataFrame:
    """(id, lng, lat) of each area's centroid; overrides put one id's rows elsewhere."""
    c = centroid(F.col("parts"))
    lng, lat = rd_to_wgs84(c["x"], c["y"])
    rows = layer.select(F.col(code).alias("id"), F.bround(lng, digits).alias("lng"), F.bround(lat, digits).alias("lat"))
    for i, (x, y) in (overrides or {}).items():
        rows = rows.select("id", F.when(F.col("id") == i, F.lit(x)).otherwise(F.col("lng")).alias("lng"), F.when(F.col("id") == i, F.lit(y)).otherwise(F.col("lat")).alias("lat"))
    return rows


def shape_report(layer: DataFrame, code: str) -> DataFrame:
    """What is sound of each shape: closed rings, four points at least, an area."""
    closed = F.forall(F.flatten("parts"), lambda r: (F.size(r) >= 4) & (r[0] == F.element_at(r, -1)))
    return layer.select(code, closed.alias("closed"), (area(F.col("parts")) > 0).alias("has_area"))
