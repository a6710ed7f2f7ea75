"""The registered queries on the driver's tables, each beside its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.values import format_code, label, label_joined, labels_of, normalise, unsuppressed
from ..operators import breaks, clean, cube, flows, outlines, spatial
from ..sources import layers
from ..sources.scratch import shared_folder, staged
from . import maps, scales
from .registry import AGE
from .stand_ins import KINDS, areas, over, shape_wkt_sql, shapes, stand_in

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CODE = "'GM' || lpad(cast({} as string), 4, '0')"
SENTINELS = "(-99995, -99997, -99994, -99993, -99999)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/arealoom/{uuid.uuid4().hex}"


# Scans, projections and filters


@query("select n_nationkey, n_name, n_regionkey from nation")
def scan_parquet(spark, d):
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey")


@query(over("select code, 5 as n_points from fx_areas", "fx_areas"))
def scan_layer(spark, d):
    base = scratch(spark)
    layers.write_layers(areas(spark, d).select(F.lit("gemeenten").alias("layer"), "code", "parts"), base)
    return layers.scan_layer(spark, base, "gemeenten").select("code", F.size(F.col("parts")[0][0]).alias("n_points"))


@query(over(f"select {CODE.format('source')} as origin_id, {CODE.format('sink')} as destination_id, sum(cast(count as double)) as flow_value from fx_flows group by 1, 2", "fx_flows"))
def scan_csv_roundtrip(spark, d):
    path = scratch(spark)
    stand_in(spark, d, "fx_flows").select("source", "sink", "count").write.option("header", True).csv(path)
    rows = flows.flows_from_raw(layers.scan_flows_csv(spark, path))
    return rows.groupBy("origin_id", "destination_id").agg(F.sum("flow_value").alias("flow_value"))


@query(over("select * from fx_stats", "fx_stats"))
def parquet_roundtrip(spark, d):
    path = scratch(spark)
    stand_in(spark, d, "fx_stats").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@query(over(f"select id, {', '.join(f'case when {c} in {SENTINELS} then null else {c} end as {c}' for c in ('inhabitants', 'income'))} from fx_stats", "fx_stats"))
def parquet_replace(spark, d):
    path, rows = scratch(spark), stand_in(spark, d, "fx_stats").select("id", "inhabitants", "income")
    layers.replace_parquet(rows, path)
    layers.replace_parquet(clean.null_suppressed(layers.read_current(spark, path)), path)
    return layers.read_current(spark, path)


@query(over("select periode, count(*) as n, (select count(*) from fx_flows) as held from fx_flows group by 1", "fx_flows"))
def named_table(spark, d):
    name = f"flows_{uuid.uuid4().hex}"
    held = layers.save_table(stand_in(spark, d, "fx_flows"), name, scratch(spark))
    return spark.table(name).groupBy("periode").agg(F.count("*").alias("n"), F.lit(held).alias("held"))


@query(over("select code as id, name, x0 as x, y0 as y, 5 as n_points, 'Polygon' as kind from fx_areas", "fx_areas"))
def geojson_roundtrip(spark, d):
    path = scratch(spark)
    layers.write_collection(layers.features(areas(spark, d), "code", layers.geojson(F.col("parts")), ["name"]), path)
    rows, ring = layers.read_collection(spark, path, "name:string"), F.col("parts")[0][0]
    return rows.select("id", "name", ring[0]["x"].alias("x"), ring[0]["y"].alias("y"), F.size(ring).alias("n_points"), F.col("geometry_type").alias("kind"))


@query(over("select cast(shape_key as varchar) as id, case kind when 2 then 'MultiPolygon' else 'Polygon' end as geometry, case kind when 2 then 2 else 1 end as n_parts, case when kind > 1 then 2 else 1 end as n_rings, case kind when 0 then 2800.0::double when 1 then 2400.0::double when 2 then 1800.0::double else 4800.0::double end as area from fx_shapes", "fx_shapes"))
def geojson_shapes(spark, d):
    path = scratch(spark)
    layers.write_features(layers.features(shapes(spark, d), "shape_key", layers.geojson(F.col("parts")), ["kind"]), path)
    p = F.col("parts")
    return layers.read_features(spark, path, "kind:int").select("id", F.col("geometry_type").alias("geometry"), F.size(p).alias("n_parts"), F.size(F.flatten(p)).alias("n_rings"), geo.area(p).alias("area"))


@query(over("select code as id, 'Polygon' as kind, name from fx_areas", "fx_areas"))
def geojson_features(spark, d):
    made = layers.features(areas(spark, d), "code", layers.geojson(F.col("parts"), 5), ["name"])
    return made.select("id", F.get_json_object("feature", "$.geometry.type").alias("kind"), F.get_json_object("feature", "$.properties.name").alias("name"))


@query(over(f"select shape_key, {shape_wkt_sql()} as geometry_wkt from fx_shapes", "fx_shapes"))
def layer_csv(spark, d):
    path = scratch(spark)
    layers.write_layer_csv(shapes(spark, d).select("shape_key", "parts"), path)
    return spark.read.option("header", True).schema("shape_key long, geometry_wkt string").csv(path)


@query(over("select id, inhabitants, dwellings, income, land_ha, all_suppressed, suppressed_or_null from fx_stats", "fx_stats"))
def drop_cols_regex(spark, d):
    return clean.drop_columns_like(stand_in(spark, d, "fx_stats"))


@query(over("select id, inhabitants, dwellings, income, land_ha, suppressed_or_null, raw_12 from fx_stats", "fx_stats"))
def drop_suppressed_columns(spark, d):
    return clean.drop_suppressed_columns(stand_in(spark, d, "fx_stats"))


@query(over("select id, inhabitants, dwellings, income, land_ha, raw_12 from fx_stats", "fx_stats"))
def drop_suppressed_columns_ignoring_nulls(spark, d):
    return clean.drop_suppressed_columns(stand_in(spark, d, "fx_stats"), nulls="ignore")


@query(over("select id, " + ", ".join(f"case when {c} in {SENTINELS} then null else {c} end as {c}" for c in ("inhabitants", "dwellings", "income", "land_ha", "all_suppressed", "suppressed_or_null", "raw_12")) + " from fx_stats", "fx_stats"))
def null_suppressed(spark, d):
    return clean.null_suppressed(stand_in(spark, d, "fx_stats"))


@query(over("select code, name from fx_areas where code in ('GM0001', 'GM0003', 'GM0025')", "fx_areas"))
def filter_in_codes(spark, d):
    return stand_in(spark, d, "fx_areas").where(F.col("code").isin("GM0001", "GM0003", "GM0025")).select("code", "name")


@query(over("select substr(trim(area_code), 1, 2) as level, count(*) as n, min(trim(area_code)) as first from fx_codes group by 1", "fx_codes"))
def split_by_prefix(spark, d):
    parts = clean.split_levels(stand_in(spark, d, "fx_codes"), "area_code")
    made = [df.groupBy(F.lit(p).alias("level")).agg(F.count("*").alias("n"), F.min("area_code").alias("first")) for p, df in parts.items()]
    return made[0].union(made[1]).union(made[2])


@query(over("select trim(area_code) as area_code from fx_codes where substr(area_code, 3, 4) in ('0002', '0005')", "fx_codes"))
def filter_parent_code(spark, d):
    return stand_in(spark, d, "fx_codes").where(clean.in_parents(F.col("area_code"), ["GM0002", "GM0005"])).select(F.trim("area_code").alias("area_code"))


@query(over("select code, water from fx_areas where water is null or water <> 'WATER'", "fx_areas"))
def filter_null_tolerant_ne(spark, d):
    return clean.not_water(stand_in(spark, d, "fx_areas")).select("code", "water")


@query(over("select id, inhabitants from fx_stats where inhabitants > 0", "fx_stats"))
def filter_populated(spark, d):
    return clean.populated(stand_in(spark, d, "fx_stats"), "inhabitants").select("id", "inhabitants")


@query(over("select cell_key from fx_cells where x between 58000 and 98000 and y between 418000 and 446000", "fx_cells"))
def bbox_prefilter(spark, d):
    boundary = areas(spark, d).where("x0 <= 84000 and y0 <= 432000")
    return spatial.in_bbox(stand_in(spark, d, "fx_cells"), spatial.bbox(boundary), 2000.0).select("cell_key")


@query(over("select trim(area_code) as area_code from fx_codes where regexp_matches(area_code, '^BU00(0[6-9]|1[0-2])')", "fx_codes"))
def filter_regex(spark, d):
    return stand_in(spark, d, "fx_codes").where(F.col("area_code").rlike("^BU00(0[6-9]|1[0-2])")).select(F.trim("area_code").alias("area_code"))


@query("select c_custkey, case when c_custkey % 10 < 4 then " + CODE.format("c_nationkey") + " end as code from customer")
def format_code_forms(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    n = F.col("c_nationkey").cast("string")
    forms = F.array(n, F.concat(F.lit("GM"), n), F.concat(F.lit("gm0"), n), F.concat(n, F.lit(".7")), F.concat(F.lit("-"), n), F.concat(n, F.lit("e3")), F.lit("NaN"), F.lit("1e300"), F.lit("99999999999999999999"), F.lit("inf"))
    return rows.select("c_custkey", format_code(forms[F.pmod("c_custkey", F.lit(10)).cast("int")]).alias("code"))


AGE_SQL = "case {} " + " ".join(f"when {k} then '{v}'" for k, v in AGE.items())


@query(f"select distinct l_linenumber, {AGE_SQL.format('l_linenumber')} end as age_label from lineitem")
def label_lookup(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", label(F.col("l_linenumber"), AGE).alias("age_label")).distinct()


@query("select c_custkey from (select c_custkey, row_number() over (order by (c_custkey * 7919 + 42) % 100003, c_custkey) as r from customer) where r <= 100")
def sample_rows(spark, d):
    return clean.sample_rows(spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), "c_custkey", 100)


@query(over(f"select count(*) as n, min(income) as low, max(income) as high from fx_stats where income > 0 and income not in {SENTINELS}", "fx_stats"))
def column_profile(spark, d):
    return clean.column_profile(stand_in(spark, d, "fx_stats"), "income")


@query("select c_custkey, n_name as label from customer left join nation on c_nationkey = n_nationkey and n_nationkey % 4 <> 0")
def label_table(spark, d):
    names = labels_of(spark.read.parquet(f"{d}/nation.parquet").where("n_nationkey % 4 <> 0"), "n_nationkey", "n_name")
    return spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", label(F.col("c_nationkey"), names).alias("label"))


@query("select c_custkey, o_orderstatus as label from customer left join orders on o_orderkey = c_custkey")
def label_joined_table(spark, d):
    """A code list as long as a table."""
    rows, codes = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey"), spark.read.parquet(f"{d}/orders.parquet")
    return label_joined(rows, "c_custkey", codes, "o_orderkey", "o_orderstatus", "label")


# Cubes


@query(over("select gem, jaar, age, sum(value) as value from fx_cube where age is not null and opl is null and soortbaan is null and jaar in (1996, 1998) group by 1, 2, 3", "fx_cube"))
def cube_slice(spark, d):
    return cube.cube_slice(stand_in(spark, d, "fx_cube"), "gem", "jaar", "age", ["opl", "soortbaan"], [1996, 1998])


@query(over("select gem, jaar, age, sum(value) as value from fx_cube where age is not null and opl is null and soortbaan is null group by 1, 2, 3", "fx_cube"))
def cube_stored_set(spark, d):
    path, dims = scratch(spark), ["age", "opl", "soortbaan"]
    cube.write_cube(stand_in(spark, d, "fx_cube"), dims, path)
    return cube.stored_set(spark, path, dims, ["age"]).groupBy("gem", "jaar", "age").agg(F.sum("value").alias("value"))


@query(over("select gem, jaar, sum(value) as total from fx_cube where age is not null and opl is null and soortbaan is null group by 1, 2", "fx_cube"))
def cube_total(spark, d):
    return cube.cube_total(stand_in(spark, d, "fx_cube"), "gem", "jaar", "age", ["opl", "soortbaan"])


@query("select l_returnflag, l_linestatus, sum(cast(l_quantity as bigint)) as value from lineitem group by cube (l_returnflag, l_linestatus)")
def cube_build(spark, d):
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("value"))
    return cube.cube_build(rows, ["l_returnflag", "l_linestatus"])


_MARGINAL = "select " + CODE.format("gem") + " as code, jaar as year, '{0}' as dim, {1} as label, sum(value) as n from fx_cube where {0} is not null and {2} is null and {3} is null group by 1, 2, 4"


@query(over(" union all ".join(_MARGINAL.format(*a) for a in (("age", AGE_SQL.format("age") + " else cast(age as string) end", "opl", "soortbaan"), ("opl", "opl", "age", "soortbaan"), ("soortbaan", "soortbaan", "age", "opl"))), "fx_cube"))
def node_marginals(spark, d):
    return cube.node_marginals(stand_in(spark, d, "fx_cube"), "gem", "jaar", ["age", "opl", "soortbaan"], {"age": AGE | {7: "7"}})


def totals(spark, d):
    """Three node totals: by age, by flag, by status, the last two thinned out so that joins miss rows."""
    c = stand_in(spark, d, "fx_cube")
    work = cube.cube_total(c, "gem", "jaar", "age", ["opl", "soortbaan"]).withColumnRenamed("total", "work")
    home = cube.cube_total(c.where("opl <> 'R'"), "gem", "jaar", "opl", ["age", "soortbaan"]).withColumnRenamed("total", "home").where("gem % 5 <> 0")
    people = cube.cube_total(c.where("soortbaan = 'O'"), "gem", "jaar", "soortbaan", ["age", "opl"]).withColumnRenamed("total", "people").where("gem % 7 <> 0")
    return work, home, people


_TOTALS = {
    "work": "select gem, jaar, sum(value) as work from fx_cube where age is not null and opl is null and soortbaan is null group by 1, 2",
    "home": "select gem, jaar, sum(value) as home from fx_cube where opl is not null and opl <> 'R' and age is null and soortbaan is null and gem % 5 <> 0 group by 1, 2",
    "people": "select gem, jaar, sum(value) as people from fx_cube where soortbaan = 'O' and age is null and opl is null and gem % 7 <> 0 group by 1, 2",
}


@query(over("select gem, jaar, work, home, people, round_even(work / case when people is null then null else greatest(people, 1) end, 4) as work_per_person, round_even(home / case when people is null then null else greatest(people, 1) end, 4) as home_per_person from work left join home using (gem, jaar) left join people using (gem, jaar)", "fx_cube", steps=_TOTALS))
def nodes_summary(spark, d):
    return cube.nodes_summary(*totals(spark, d), ["gem", "jaar"])


@query(over("select gem, max(case when jaar = 1996 then work end) as before, max(case when jaar = 1998 then work end) as after, max(case when jaar = 1998 then work end) - max(case when jaar = 1996 then work end) as change, round_even((max(case when jaar = 1998 then work end) - max(case when jaar = 1996 then work end)) / nullif(max(case when jaar = 1996 then work end), 0), 6) as relative from work where jaar in (1996, 1998) group by gem", "fx_cube", steps={"work": _TOTALS["work"]}))
def node_change(spark, d):
    return cube.year_change(totals(spark, d)[0], "gem", "jaar", 1996, 1998, "work")


# Flows


_FLOWS = {"f": f"select {CODE.format('source')} as origin_id, {CODE.format('sink')} as destination_id, cast(count as double) as flow_value, periode from fx_flows"}
_EDGES = {"e": f"select {CODE.format('source')} as origin_id, {CODE.format('sink')} as destination_id, cast(sum(count) as double) as flow_value, periode from fx_flows group by 1, 2, 4"}


def raw_flows(spark, d):
    raw = stand_in(spark, d, "fx_flows")
    return flows.flows_from_raw(raw).select("origin_id", "destination_id", "flow_value")


def raw_edges(spark, d, divide=1):
    return flows.edges(flows.od_sum(stand_in(spark, d, "fx_flows"), "source", "sink", "periode", "count"), "source", "sink", "periode", divide)


@query(over("select origin_id, destination_id, flow_value, 'commuting' as variable_name, 2022 as year from f", "fx_flows", steps=_FLOWS))
def flows_from_raw(spark, d):
    return flows.flows_from_raw(stand_in(spark, d, "fx_flows"), variable_name="commuting", year=2022)


@query(over("select source, sink, periode, sum(count) as value from fx_flows group by 1, 2, 3", "fx_flows"))
def od_sum(spark, d):
    return flows.od_sum(stand_in(spark, d, "fx_flows"), "source", "sink", "periode", "count")


@query(over("select origin_id, destination_id, round_even(flow_value / 6, 0) as flow_value, periode from e where round_even(flow_value / 6, 0) > 0", "fx_flows", steps=_EDGES))
def edges_period_avg(spark, d):
    return raw_edges(spark, d, 6)


@query(over("select * from e where flow_value > 0", "fx_flows", steps=_EDGES))
def edges_raw_sum(spark, d):
    return raw_edges(spark, d)


@query(over("select origin_id, sum(flow_value) as total_outflow, count(distinct destination_id) as n_destinations from f group by 1", "fx_flows", steps=_FLOWS))
def flow_summary(spark, d):
    return flows.flow_summary(raw_flows(spark, d))


@query(over("select origin_id, periode, sum(flow_value) as total_outflow, count(distinct destination_id) as n_destinations from e group by 1, 2", "fx_flows", steps=_EDGES))
def edges_summary(spark, d):
    return flows.flow_summary(raw_edges(spark, d), "periode")


@query(over("select count(*) as n_rows, count(distinct origin_id) as n_origins, count(distinct destination_id) as n_destinations, sum(flow_value) as total, max(flow_value) as largest from f", "fx_flows", steps=_FLOWS))
def flow_profile(spark, d):
    return flows.flow_profile(raw_flows(spark, d))


@query(over("select periode, count(*) as n from e group by 1", "fx_flows", steps=_EDGES))
def count_by_period(spark, d):
    return raw_edges(spark, d).groupBy("periode").agg(F.count("*").alias("n"))


@query(over("select distinct source, sink from fx_flows", "fx_flows"))
def distinct_pairs(spark, d):
    return stand_in(spark, d, "fx_flows").select("source", "sink").distinct()


@query(over("select count(*) as n_rows, sum(case when flow_value is null then 1 else 0 end) as n_null, sum(case when origin_id in (select code from fx_areas where water = 'LAND') then 0 else 1 end) as unmatched_origins, sum(case when destination_id in (select code from fx_areas where water = 'LAND') then 0 else 1 end) as unmatched_destinations from f", "fx_flows", "fx_areas", steps=_FLOWS))
def validate_flows(spark, d):
    return flows.validate_flows(raw_flows(spark, d), stand_in(spark, d, "fx_areas").where("water = 'LAND'"), "code")[1]


@query(over("select * from e where periode = '19951998' order by flow_value desc, origin_id, destination_id limit 500", "fx_flows", steps=_EDGES))
def flow_topk(spark, d):
    return flows.top_flows(raw_edges(spark, d), "19951998", 500)


@query(over("select * from e where periode = '19992001' order by flow_value desc, origin_id, destination_id limit 5", "fx_flows", steps=_EDGES))
def flow_top5(spark, d):
    return flows.top_flows(raw_edges(spark, d), "19992001", 5)


_LAST = {"c": "select id, max(lng) as lng, max(lat) as lat from (select *, max(pos) over (partition by id) as m from fx_centroids) where pos = m group by id"}


@query(over("select * from c", "fx_centroids", steps=_LAST))
def centroid_lookup(spark, d):
    path = scratch(spark)
    stand_in(spark, d, "fx_centroids").write.json(path)
    return flows.last_centroids(spark.read.schema("id string, pos int, lng double, lat double").json(path))


@query(over("select * from c", "fx_centroids", steps=_LAST))
def centroid_array(spark, d):
    """The same from one document that holds an array, whose order is the load order."""
    path = scratch(spark)
    whole = stand_in(spark, d, "fx_centroids").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "lng", "lat"))).alias("a"))
    whole.select(F.to_json(F.transform("a", lambda p: F.struct(p["id"].alias("id"), p["lng"].alias("lng"), p["lat"].alias("lat")))).alias("value")).write.text(path)
    return flows.last_centroids(flows.scan_centroids(spark, path))


@query(over("select t.origin_id, t.destination_id, t.flow_value, 'LineString' as kind, a.lng as lng1, a.lat as lat1, b.lng as lng2, b.lat as lat2 from t join c a on t.origin_id = a.id join c b on t.destination_id = b.id", "fx_flows", "fx_centroids", steps=_EDGES | _LAST | {"t": "select * from e where periode = '19951998' order by flow_value desc, origin_id, destination_id limit 500"}))
def flow_lines(spark, d):
    made = flows.flow_lines(flows.top_flows(raw_edges(spark, d), "19951998"), stand_in(spark, d, "fx_centroids"))
    at = F.col("geometry.coordinates")
    return made.select("origin_id", "destination_id", "flow_value", F.col("geometry.type").alias("kind"), at[0][0].alias("lng1"), at[0][1].alias("lat1"), at[1][0].alias("lng2"), at[1][1].alias("lat2"))


@query(over("select a.code as origin_id, b.code as destination_id, coalesce(s.flow_value, 0) as flow_value from fx_areas a join fx_areas b on a.code <> b.code left join (select origin_id, destination_id, sum(flow_value) as flow_value from e where flow_value > 20 group by 1, 2) s on s.origin_id = a.code and s.destination_id = b.code", "fx_flows", "fx_areas", steps=_EDGES))
def od_pairs(spark, d):
    return flows.od_matrix(raw_edges(spark, d).where("flow_value > 20"), stand_in(spark, d, "fx_areas"), "code")


@query(over("select origin_id, round_even(sum(share * share), 6) as herfindahl from (select origin_id, v / sum(v) over (partition by origin_id) as share from (select origin_id, destination_id, sum(flow_value) as v from f group by 1, 2)) group by 1", "fx_flows", steps=_FLOWS))
def herfindahl(spark, d):
    return flows.herfindahl(raw_flows(spark, d))


@query(over("select s.origin_id, s.destination_id, flow_value, outflow, inflow, round_even(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)), 6) as distance, round_even(outflow * inflow / ((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0)), 6) as expected from s join (select origin_id, sum(flow_value) as outflow from s group by 1) o on s.origin_id = o.origin_id join (select destination_id, sum(flow_value) as inflow from s group by 1) i on s.destination_id = i.destination_id join fx_areas a on a.code = s.origin_id join fx_areas b on b.code = s.destination_id where s.origin_id <> s.destination_id", "fx_flows", "fx_areas", steps=_FLOWS | {"s": "select origin_id, destination_id, sum(flow_value) as flow_value from f group by 1, 2"}))
def gravity_flows(spark, d):
    points = stand_in(spark, d, "fx_areas").select(F.col("code").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    made = flows.gravity(raw_flows(spark, d), points)
    return made.withColumn("distance", F.bround("distance", 6)).withColumn("expected", F.bround("expected", 6))


@query(over("select 'origin' as side, origin_id as id, round_even(sum(flow_value), 0) as total from f where origin_id <> destination_id group by 2 union all select 'destination', destination_id, round_even(sum(flow_value), 0) from f where origin_id <> destination_id group by 2", "fx_flows", steps=_FLOWS))
def flows_balanced(spark, d):
    """The gravity model's flows, balanced to meet each area's own totals: what the balanced flows sum to."""
    # one pass over the tables, and codes by pair: the model and both lists of totals only need the sums
    sums = stand_in(spark, d, "fx_flows").groupBy("source", "sink").agg(F.sum("count").alias("count"))
    own = staged(flows.flows_from_raw(sums).where("origin_id <> destination_id"))
    points = stand_in(spark, d, "fx_areas").select(F.col("code").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    seed = flows.gravity(own, points).select("origin_id", "destination_id", F.col("expected").alias("flow_value"))
    totals_of = lambda df, k: df.groupBy(k).agg(F.sum("flow_value").alias("total"))
    made = flows.balanced(seed, totals_of(own, "origin_id"), totals_of(own, "destination_id"), 1e-7)
    ends = [totals_of(made, f"{s}_id").select(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id"), F.bround("total", 0).alias("total")) for s in ("origin", "destination")]
    return ends[0].union(ends[1])


@query(over("select round_even(-regr_slope(ly, lx), 6) as beta, round_even(exp(regr_intercept(ly, lx)), 9) as scale, count(*) as n from (select ln(flow_value / (outflow * inflow)) as ly, ln(sqrt((a.x0 - b.x0) * (a.x0 - b.x0) + (a.y0 - b.y0) * (a.y0 - b.y0))) as lx from s join (select origin_id, sum(flow_value) as outflow from s group by 1) o on s.origin_id = o.origin_id join (select destination_id, sum(flow_value) as inflow from s group by 1) i on s.destination_id = i.destination_id join fx_areas a on a.code = s.origin_id join fx_areas b on b.code = s.destination_id where s.origin_id <> s.destination_id and flow_value > 0)", "fx_flows", "fx_areas", steps=_FLOWS | {"s": "select origin_id, destination_id, sum(flow_value) as flow_value from f group by 1, 2"}))
def gravity_fit(spark, d):
    points = stand_in(spark, d, "fx_areas").select(F.col("code").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    made = flows.gravity_fit(raw_flows(spark, d), points)
    return made.select(F.bround("beta", 6).alias("beta"), F.bround("scale", 9).alias("scale"), "n")


# Joins by code


@query(over("select a.code, a.name, s.n, s.code_y from fx_areas a left join (select " + CODE.format("c_nationkey + 1") + " as k, cast(c_nationkey as string) as code_y, count(*) as n from customer where c_nationkey % 3 <> 0 group by 1, 2) s on a.code = s.k", "fx_areas"))
def join_stats_geometry(spark, d):
    stats = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey % 3 <> 0").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    stats = stats.select(format_code(F.col("c_nationkey") + 1).alias("k"), F.col("c_nationkey").cast("string").alias("code"), "n")
    return clean.join_stats(stand_in(spark, d, "fx_areas"), stats, "code", "k").select(F.col("code_x").alias("code"), "name", "n", "code_y")


@query(over("select code from fx_areas where code in (select " + CODE.format("s_nationkey + 1") + " from supplier where s_acctbal > 0)", "fx_areas"))
def semi_join_codes(spark, d):
    stats = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(format_code(F.col("s_nationkey") + 1).alias("k"))
    return clean.only_listed(stand_in(spark, d, "fx_areas"), "code", stats, "k").select("code")


@query(over("select code, name from fx_areas where code in (select " + CODE.format("c_nationkey + 1") + " from customer where c_mktsegment = 'BUILDING' and c_nationkey < 12)", "fx_areas"))
def pc_lookup_semi(spark, d):
    lookup = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey < 12").select(format_code(F.col("c_nationkey") + 1).alias("pc"), F.col("c_mktsegment").alias("province"))
    return scales.postcodes_of(stand_in(spark, d, "fx_areas"), lookup, "code", "pc", "province", "BUILDING").select("code", "name")


@query(over("select code from (select distinct " + CODE.format("s_nationkey + 1") + " as code from supplier) where code not in (select code from fx_areas where water = 'LAND')", "fx_areas"))
def missing_codes(spark, d):
    wanted = spark.read.parquet(f"{d}/supplier.parquet").select(format_code(F.col("s_nationkey") + 1))
    return clean.require_codes(stand_in(spark, d, "fx_areas").where("water = 'LAND'"), "code", wanted)


# Breaks and maps


def break_steps(values: str) -> dict[str, str]:
    """values: a statement with id and value."""
    return {
        "vals": values,
        "ranked": "select value, row_number() over (order by value) - 1 as rn, count(*) over () as n from vals where value is not null and isfinite(value) and value > -99990",
        "brk": "select value as b, rn from ranked, (select unnest([0, 1, 2]) as i) where n >= 4 and rn = least(cast(floor((i + 1) / 4.0::double * n) as bigint), n - 1)",
    }


CLASSED = "select id, value, case when value is null or not isfinite(value) or value <= -99990 then -1 else (select count(*) from brk where b < value) end as cls from vals"
PER_1000 = "case when inh > 0 then cast(dw as double) / inh * 1000 end"
CLEANED = f"(select id, case when inhabitants in {SENTINELS} then null else inhabitants end as inh, case when dwellings in {SENTINELS} then null else dwellings end as dw, land_ha, income from fx_stats)"


def per_1000(spark, d):
    return lambda c: normalise(c, "per_1000", inhabitants=unsuppressed(F.col("inhabitants")))


@query(over("select cast(rn as bigint) as place, b as value from brk", "fx_stats", steps=break_steps("select id, cast(income as double) as value from fx_stats")))
def quantile_breaks(spark, d):
    rows = stand_in(spark, d, "fx_stats").withColumn("g", F.lit(1))
    return breaks.order_statistics(rows, ["g"], "income", breaks.break_places(), 4)[1].select("place", F.col("v").alias("value"))


@query("select c_mktsegment, value, i from (select c_mktsegment, c_acctbal as value, row_number() over (partition by c_mktsegment order by c_acctbal) - 1 as rn, count(*) over (partition by c_mktsegment) as n from customer), (select unnest([0, 1, 2]) as i) where n >= 4 and rn = least(cast(floor((i + 1) / 4.0::double * n) as bigint), n - 1)")
def quantile_breaks_by_group(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet")
    return breaks.group_breaks(rows, ["c_mktsegment"], "c_acctbal").select("c_mktsegment", F.posexplode("breaks").alias("i", "value"))


@query("select seg, value, i from (select case when c_mktsegment <> 'BUILDING' then c_mktsegment end as seg, c_acctbal as value, row_number() over (partition by case when c_mktsegment <> 'BUILDING' then c_mktsegment end order by c_acctbal) - 1 as rn, count(*) over (partition by case when c_mktsegment <> 'BUILDING' then c_mktsegment end) as n from customer), (select unnest([0, 1, 2]) as i) where n >= 4 and rn = least(cast(floor((i + 1) / 4.0::double * n) as bigint), n - 1)")
def quantile_breaks_of_null_group(spark, d):
    rows = spark.read.parquet(f"{d}/customer.parquet").select(F.expr("case when c_mktsegment <> 'BUILDING' then c_mktsegment end").alias("seg"), "c_acctbal")
    return breaks.group_breaks(rows, ["seg"], "c_acctbal").select("seg", F.posexplode("breaks").alias("i", "value"))


@query(over(f"select unnest([0, 1, 2, 3, 4]) as i, unnest([round_even(x, 6) for x in quantile_cont(income, [0, 0.25, 0.5, 0.75, 1])]) as value from fx_stats where income > 0 and income not in {SENTINELS}", "fx_stats"))
def quantile_breaks_doc(spark, d):
    rows = stand_in(spark, d, "fx_stats").where("income > 0").where(unsuppressed(F.col("income")).isNotNull())
    made = breaks.group_quantiles(rows.withColumn("g", F.lit(1)), ["g"], "income", [0.0, 0.25, 0.5, 0.75, 1.0])
    return made.select("i", F.bround("value", 6).alias("value"))


@query(over(CLASSED, "fx_stats", steps=break_steps(f"select id, {PER_1000} as value from {CLEANED}")))
def choropleth_raw(spark, d):
    return maps.stats_choropleth(stand_in(spark, d, "fx_stats"), "id", "dwellings", per_1000(spark, d))


@query(over(CLASSED, "fx_stats", steps=break_steps(f"select id, coalesce({PER_1000}, 0) as value from {CLEANED}")))
def choropleth_null_as_zero(spark, d):
    return maps.stats_choropleth(stand_in(spark, d, "fx_stats"), "id", "dwellings", per_1000(spark, d), null_as_zero=True)


_NODE = f"select {CODE.format('gem')} as id, cast(work as double) as value from work where jaar = 1997"


@query(over("select 'buurt' as scale, 'dwellings' as variable, * from (" + CLASSED + ") union all select 'gemeente', 'jobs', * from (" + re.sub(r"\b(vals|brk)\b", r"o\1", CLASSED) + ")", "fx_stats", "fx_cube", steps={"work": _TOTALS["work"]} | break_steps(f"select id, {PER_1000} as value from {CLEANED}") | {re.sub(r"\b(vals|ranked|brk)\b", r"o\1", k): re.sub(r"\b(vals|ranked|brk)\b", r"o\1", q) for k, q in break_steps(_NODE).items()}))
def registry_layers(spark, d):
    """Layers as a registry table says: where a variable comes from, whether it is normalised, and where it exists. The
    third is not available at its scale and has no rows."""
    rows = [("dwellings", "stats", "dwellings", True, ["buurt", "wijk"]), ("jobs", "node", "work", False, ["gemeente"])]
    registry = spark.createDataFrame(rows, "key string, kind string, source string, can_normalise boolean, available_at array<string>")
    nodes = totals(spark, d)[0].where("jaar = 1997").select(format_code(F.col("gem")).alias("id"), "work")
    tables = {("buurt", "stats"): (stand_in(spark, d, "fx_stats"), "id"), ("gemeente", "node"): (nodes, "id"), ("gemeente", "stats"): (stand_in(spark, d, "fx_stats"), "id")}
    value = lambda c, row: per_1000(spark, d)(c) if row.can_normalise else c
    made = [maps.registered_layer(registry, tables, s, v, value) for s, v in (("buurt", "dwellings"), ("gemeente", "jobs"), ("gemeente", "dwellings"))]
    return made[0].union(made[1]).union(made[2])


@query(over("select a.code as id, coalesce(k.cls, -1) as cls from fx_areas a left join (" + CLASSED + ") k on a.code = k.id", "fx_areas", "fx_flows", steps=_EDGES | break_steps("select origin_id as id, sum(flow_value) as value from e where periode = '19951998' group by 1")))
def choropleth_features(spark, d):
    return maps.feature_states(stand_in(spark, d, "fx_areas"), "code", choropleth_flow(spark, d))


@query(over(CLASSED, "fx_flows", steps=_EDGES | break_steps("select origin_id as id, sum(flow_value) as value from e where periode = '19951998' group by 1")))
def choropleth_flow(spark, d):
    return maps.choropleth(flows.flow_summary(raw_edges(spark, d).where("periode = '19951998'")), "origin_id", F.col("total_outflow"))


@query(over(CLASSED, "fx_cube", steps={"work": _TOTALS["work"]} | break_steps(f"select {CODE.format('gem')} as id, cast(work as double) as value from work where jaar = 1997")))
def choropleth_node(spark, d):
    rows = totals(spark, d)[0].where("jaar = 1997").select(format_code(F.col("gem")).alias("id"), "work")
    return maps.choropleth(rows, "id", F.col("work"))


@query(over("select 'buurt' as scale, variable, id, value, case when value is null then -1 else (select count(*) from mb where mb.variable = long.variable and mb.b < long.value) end as cls from long", "fx_stats", steps={
    "long": " union all ".join(f"select '{v}' as variable, id, cast(case when {v} in {SENTINELS} then null else {v} end as double) as value from fx_stats" for v in ("inhabitants", "dwellings", "income")),
    "mr": "select variable, value, row_number() over (partition by variable order by value) - 1 as rn, count(*) over (partition by variable) as n from long where value is not null",
    "mb": "select variable, value as b from mr, (select unnest([0, 1, 2]) as i) where n >= 4 and rn = least(cast(floor((i + 1) / 4.0::double * n) as bigint), n - 1)",
}))
def choropleth_many(spark, d):
    return maps.choropleth_many(stand_in(spark, d, "fx_stats"), "id", ["inhabitants", "dwellings", "income"], "buurt")


def _outer(steps: dict[str, str]) -> dict[str, str]:
    """break_steps under other names."""
    other = lambda q: re.sub(r"\b(vals|ranked|brk)\b", r"o\1", q)
    return {other(k): other(q) for k, q in steps.items()}


_BY_GM = "select gm as id, cast(n as double) as value from (select substr(id, 1, 6) as gm, count(*) as n from fx_stats group by 1)"


@query(over("select 'inner' as layer, 'dwellings' as variable, * from (" + CLASSED + ") union all select 'outer', 'n', * from (" + re.sub(r"\b(vals|brk)\b", r"o\1", CLASSED) + ")", "fx_stats", steps=break_steps(f"select id, cast(dw as double) as value from {CLEANED}") | _outer(break_steps(_BY_GM))))
def two_layers(spark, d):
    stats = stand_in(spark, d, "fx_stats")
    return maps.two_layers((stats, "id", "dwellings"), (stats.groupBy(F.substring("id", 1, 6).alias("gm")).agg(F.count("*").alias("n")), "gm", "n"))


@query(over("select id, case when land_ha > 0 then dw / (land_ha / 100.0::double) end as value from " + CLEANED, "fx_stats"))
def normalise_per_km2(spark, d):
    return stand_in(spark, d, "fx_stats").select("id", normalise(unsuppressed(F.col("dwellings")), "per_km2", land_ha=F.col("land_ha")).alias("value"))


@query(over(f"select id, {PER_1000} as value from " + CLEANED, "fx_stats"))
def normalise_per_1000(spark, d):
    return stand_in(spark, d, "fx_stats").select("id", per_1000(spark, d)(unsuppressed(F.col("dwellings"))).alias("value"))


@query(over("select id, 100.0::double * (cast(dw as double) + land_ha) / nullif(cast(inh as double), 0) - land_ha / nullif(cast(dw as double) - land_ha, 0) as ratio from " + CLEANED, "fx_stats"))
def computed_variable(spark, d):
    formula = "100 * (dwellings + land_ha) / inhabitants - land_ha / (dwellings - land_ha)"
    return maps.computed(clean.null_suppressed(stand_in(spark, d, "fx_stats")), "ratio", formula, ["dwellings", "inhabitants", "land_ha"]).select("id", "ratio")


@query(over("select a.name, count(s.id) as n, sum(case when inh > 0 then inh else 0 end) as inhabitants from fx_areas a left join " + CLEANED + " s on substr(s.id, 3, 4) = substr(a.code, 3, 4) group by 1", "fx_stats", "fx_areas"))
def adhoc_sql(spark, d):
    layers.register_views({"buurt": clean.null_suppressed(stand_in(spark, d, "fx_stats")), "gemeente": stand_in(spark, d, "fx_areas")})
    return spark.sql("select g.name, count(b.id) as n, sum(case when inhabitants > 0 then inhabitants else 0 end) as inhabitants from gemeente g left join buurt b on substr(b.id, 3, 4) = substr(g.code, 3, 4) group by 1")


# Geometry


@query(over("select shape_key, case when kind > 1 then 2 else 1 end as n_rings from fx_shapes where x0 <= 80000 and x0 + 80 >= 70000 and y0 <= 455000 and y0 + case kind when 1 then 60 else 80 end >= 430000", "fx_shapes"))
def layer_in_box(spark, d):
    """A layer in order of a curve through the plane, read back by the bounds of its shapes."""
    base = scratch(spark)
    layers.write_layers(shapes(spark, d).select(F.lit("shapes").alias("layer"), "shape_key", "parts"), base, tasks=8)
    rows = layers.scan_layer(spark, base, "shapes", (70000.0, 430000.0, 80000.0, 455000.0))
    return rows.select("shape_key", F.size(F.flatten("parts")).alias("n_rings"))


@query(over("select code, 'POLYGON ((' || x0::bigint || ' ' || y0::bigint || ', ' || (x0 + 12000)::bigint || ' ' || y0::bigint || ', ' || (x0 + 12000)::bigint || ' ' || (y0 + 12000)::bigint || ', ' || x0::bigint || ' ' || (y0 + 12000)::bigint || ', ' || x0::bigint || ' ' || y0::bigint || '))' as geometry_wkt from fx_areas", "fx_areas"))
def wkt_encode(spark, d):
    return areas(spark, d).select("code", geo.to_wkt(F.col("parts")).alias("geometry_wkt"))


@query(over("select code, 1 as n_rings, 5 as n_points, x0 + 12000 as x, y0 + 12000 as y from fx_areas", "fx_areas"))
def wkt_decode(spark, d):
    rows = areas(spark, d).select("code", geo.from_wkt(geo.to_wkt(F.col("parts"))).alias("parts"))
    r = F.col("parts")[0]
    return rows.select("code", F.size(r).alias("n_rings"), F.size(r[0]).alias("n_points"), r[0][2]["x"].alias("x"), r[0][2]["y"].alias("y"))


@query(over(f"select shape_key, {shape_wkt_sql()} as geometry_wkt, case kind when 2 then 2 else 1 end as n_parts, case when kind > 1 then 2 else 1 end as n_rings from fx_shapes", "fx_shapes"))
def wkt_shapes(spark, d):
    p = F.col("parts")
    rows = shapes(spark, d).withColumn("parts", geo.from_wkt(geo.to_wkt(p)))
    return rows.select("shape_key", geo.to_wkt(p).alias("geometry_wkt"), F.size(p).alias("n_parts"), F.size(F.flatten(p)).alias("n_rings"))


@query(over("select shape_key, x0 + case kind when 0 then round_even(27 + 1 / 7.0::double, 6) when 1 then round_even(80 / 3.0::double, 6) else 40 end as x, y0 + case kind when 0 then round_even(27 + 1 / 7.0::double, 6) when 1 then 20 else 40 end as y, case kind when 0 then 2800.0::double when 1 then 2400.0::double when 2 then 1800.0::double else 4800.0::double end as area from fx_shapes", "fx_shapes"))
def shape_measures(spark, d):
    c = geo.centroid(F.col("parts"))
    rows = shapes(spark, d).withColumn("c", c)
    near = lambda n, o: (F.col(o) + F.bround(F.col(f"c.{n}") - F.col(o), 6)).alias(n)
    return rows.select("shape_key", near("x", "x0"), near("y", "y0"), geo.area(F.col("parts")).alias("area"))


@query(over("select min(x0) as xmin, min(y0) as ymin, max(x0) + 12000 as xmax, max(y0) + 12000 as ymax from fx_areas", "fx_areas"))
def bbox_agg(spark, d):
    b = geo.bounds(F.col("parts"))
    return areas(spark, d).agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax"))


@query(over("select code, x0 + 6000 as x, y0 + 6000 as y, 144000000.0::double as area from fx_areas", "fx_areas"))
def polygon_centroid(spark, d):
    rows = areas(spark, d).withColumn("c", geo.centroid(F.col("parts")))
    return rows.select("code", F.bround("c.x", 3).alias("x"), F.bround("c.y", 3).alias("y"), geo.area(F.col("parts")).alias("area"))


def _poly_sql(terms, p, q) -> str:
    power = lambda c, n: "" if n == 0 else " * " + " * ".join([c] * n)
    return "(" + " + ".join(f"({k!r}::double{power(p, i)}{power(q, j)})" for i, j, k in terms) + ")"


_A, _B = "((x - 155000) * 1e-5::double)", "((y - 463000) * 1e-5::double)"
LNG_SQL = f"{geo.BASE_LON!r}::double + {_poly_sql(geo.LON, _A, _B)} / 3600"
LAT_SQL = f"{geo.BASE_LAT!r}::double + {_poly_sql(geo.LAT, _A, _B)} / 3600"


@query(over(f"select cell_key, round_even({LNG_SQL}, 6) as lng, round_even({LAT_SQL}, 6) as lat, true as back from fx_cells", "fx_cells"))
def reproject_rd_wgs84(spark, d):
    lng, lat = geo.rd_to_wgs84(F.col("x"), F.col("y"))
    x, y = geo.wgs84_to_rd(lng, lat)
    near = (F.abs(x - F.col("x")) < 0.01) & (F.abs(y - F.col("y")) < 0.01)
    return stand_in(spark, d, "fx_cells").select("cell_key", F.bround(lng, 6).alias("lng"), F.bround(lat, 6).alias("lat"), near.alias("back"))


@query(over(f"select code as id, case when code = 'GM0003' then 4.479448 else round_even({LNG_SQL}, 6) end as lng, case when code = 'GM0003' then 51.928931 else round_even({LAT_SQL}, 6) end as lat from (select code, x0 + 6000 as x, y0 + 6000 as y from fx_areas)", "fx_areas"))
def centroids_export(spark, d):
    path = scratch(spark)
    scales.centroid_table(areas(spark, d), "code", {"GM0003": (4.479448, 51.928931)}).write.json(path)
    return spark.read.schema("id string, lng double, lat double").json(path)


@query(over(f"select code, x0 as x, y0 as y, round_even({LNG_SQL}, 5) as lng, round_even({LAT_SQL}, 5) as lat from (select code, x0, y0, x0 as x, y0 as y from fx_areas) where x0 between 60000 and 90000 and y0 between 420000 and 450000", "fx_areas"))
def bbox_from_wkt(spark, d):
    more = geo.rectangle(F.col("x0") + 1e6, F.col("y0"), F.col("x0") + 1e6 + 1, F.col("y0") + 1)
    rows = areas(spark, d).select("code", geo.to_wkt(F.concat("parts", more)).alias("geometry_wkt"))
    rows = scales.old_extract(rows, 60000, 90000, 420000, 450000)
    first = F.col("parts")[0][0][0]
    return rows.select("code", "x", "y", F.bround(first["x"], 5).alias("lng"), F.bround(first["y"], 5).alias("lat"))


def box(spark, *corners: float) -> DataFrame:
    return spark.range(1).select(geo.rectangle(*map(F.lit, corners)).alias("parts"))


@query(over("select cell_key from fx_cells, (select x0, y0 from fx_areas where code = 'GM0008') where x > x0 and x < x0 + 12000 and y > y0 and y < y0 + 12000", "fx_areas", "fx_cells"))
def spatial_within(spark, d):
    one = areas(spark, d).where("code = 'GM0008'").select("code", "parts")
    return spatial.points_in_areas(stand_in(spark, d, "fx_cells"), one, "code", 2000.0).select("cell_key")


@query(over("select code from fx_areas where x0 <= 90000 and x0 + 12000 >= 66000 and y0 <= 450000 and y0 + 12000 >= 426000", "fx_areas"))
def spatial_intersects(spark, d):
    return spatial.touching(areas(spark, d), box(spark, 66000.0, 426000.0, 90000.0, 450000.0), "code", 12000.0).select("code")


def _overlap(x0, y0, x1, y1) -> str:
    """Whether a box of fx_boxes meets the closed rectangle between two corners of a shape."""
    return f"(bx <= x0 + {x1} and bx + side >= x0 + {x0} and b_y <= y0 + {y1} and b_y + side >= y0 + {y0})"


@query(over(f"""select distinct shape_key from fx_shapes join fx_boxes on bx <= x0 + 80 and bx + side >= x0 and b_y <= y0 + 80 and b_y + side >= y0 where case kind
 when 0 then {_overlap(0, 0, 80, 20)} or {_overlap(0, 0, 20, 80)}
 when 1 then greatest(bx - x0, 0) / 80 + greatest(b_y - y0, 0) / 60 <= 1
 when 2 then {_overlap(0, 0, 30, 30)} or {_overlap(50, 50, 80, 80)}
 else not (bx > x0 + 20 and bx + side < x0 + 60 and b_y > y0 + 20 and b_y + side < y0 + 60) end""", "fx_shapes", "fx_boxes"))
def shapes_touching(spark, d):
    b = [F.col("bx"), F.col("b_y"), F.col("bx") + F.col("side"), F.col("b_y") + F.col("side")]
    boxes = stand_in(spark, d, "fx_boxes").select(geo.rectangle(*b).alias("parts"))
    return spatial.touching(shapes(spark, d), boxes, "shape_key", 500.0).select("shape_key")


@query(over("""select spot_key, shape_key from fx_spots join fx_shapes on x > x0 and x < x0 + 80 and y > y0 and y < y0 + 80 where case kind
 when 0 then x < x0 + 20 or y < y0 + 20 when 1 then (x - x0) * 60 + (y - y0) * 80 < 4800
 when 2 then (x < x0 + 30 and y < y0 + 30) or (x > x0 + 50 and y > y0 + 50)
 else x < x0 + 20 or x > x0 + 60 or y < y0 + 20 or y > y0 + 60 end""", "fx_spots", "fx_shapes"))
def points_in_shapes(spark, d):
    return spatial.points_in_areas(stand_in(spark, d, "fx_spots"), shapes(spark, d), "shape_key", 25.0).select("spot_key", "shape_key")


@query(over("select cell_key, code from fx_cells join fx_areas on x > x0 and x < x0 + 12000 and y > y0 and y < y0 + 12000", "fx_areas", "fx_cells"))
def spatial_join_tiled(spark, d):
    return spatial.points_in_areas(stand_in(spark, d, "fx_cells"), areas(spark, d), "code", 1500.0).select("cell_key", "code")


def outline(df: DataFrame, by: str) -> DataFrame:
    p = F.col("parts")
    return df.select(by, F.size(F.flatten(p)).alias("n_rings"), (F.size(p[0][0]) - 1).alias("n_vertices"), geo.area(p).alias("area"))


@query("select s_suppkey, 2 as n_parts, 2 as n_rings, 7 as n_vertices, 30000.0::double as area from supplier")
def dissolve_junctions(spark, d):
    """A square given twice, beside it two halves that meet it at a vertex it lacks, and a square apart."""
    x, y = F.col("s_suppkey") % 1000 * 1000.0, F.col("s_suppkey") % 7 * 1000.0
    boxes = [(0, 0, 100, 100), (0, 0, 100, 100), (100, 0, 200, 50), (100, 50, 200, 100), (500, 0, 600, 100)]
    pieces = F.array(*[geo.rectangle(x + a, y + b, x + c, y + e) for a, b, c, e in boxes])
    made = spatial.dissolve(spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.explode(pieces).alias("parts")), "s_suppkey")
    p = F.col("parts")
    return made.select("s_suppkey", F.size(p).alias("n_parts"), F.size(F.flatten(p)).alias("n_rings"), (F.size(p[0][0]) - 1).alias("n_vertices"), geo.area(p).alias("area"))


@query(over("select province, 1 as n_rings, 12 as n_vertices, count(*) * 144000000.0::double as area from fx_areas group by 1", "fx_areas"))
def dissolve_edges(spark, d):
    return outline(spatial.dissolve(areas(spark, d), "province"), "province")


@query(over("select province, 1 as n_rings, 4 as n_vertices, count(*) * 144000000.0::double as area from fx_areas group by 1", "fx_areas"))
def simplify_rings(spark, d):
    return outline(spatial.simplify(spatial.dissolve(areas(spark, d), "province"), 1.0), "province")


@query(over("select code, (least(x0 + 12000, 100000) - greatest(x0, 65000)) * (least(y0 + 12000, 455000) - greatest(y0, 421000)) as area from fx_areas where least(x0 + 12000, 100000) > greatest(x0, 65000) and least(y0 + 12000, 455000) > greatest(y0, 421000)", "fx_areas"))
def clip_to_bbox(spark, d):
    return spatial.clip_to_box(areas(spark, d), 65000.0, 421000.0, 100000.0, 455000.0).select("code", geo.area(F.col("parts")).alias("area"))


@query(over("select level, count(*) * 144000000.0::double as area from (select unnest(range(1, 6)) as level) join fx_areas on province < level group by 1", "fx_areas"))
def boundary_levels(spark, d):
    rows = areas(spark, d)
    levels = rows.select("code", F.explode(F.sequence(F.col("province").cast("int") + 1, F.lit(5))).alias("level"))
    made = scales.boundary_levels(rows, levels, "code", (0.0, 0.0, 1e6, 1e6), 0.5)
    return made.select(F.col("level").cast("long").alias("level"), geo.area(F.col("parts")).alias("area"))


_TRIO = [("s_suppkey * 7 % 40", "s_suppkey * 11 % 40", "5 + s_suppkey % 13", "5 + s_suppkey % 7"), ("s_suppkey * 13 % 40 + 0.5", "s_suppkey * 3 % 40 + 0.5", "4 + s_suppkey % 17", "6 + s_suppkey % 11"), ("s_suppkey * 5 % 40 + 0.25", "s_suppkey * 17 % 40 + 0.25", "8 + s_suppkey % 5", "3 + s_suppkey % 19")]


def _trio_sql() -> dict[str, str]:
    """Three rectangles per supplier, and the area and parts of their union by inclusion and exclusion."""
    ends = [f"cast({x} as double) as x{i}, cast({x} + {w} as double) as p{i}, cast({y} as double) as y{i}, cast({y} + {h} as double) as q{i}" for i, (x, y, w, h) in enumerate(_TRIO)]
    meet = lambda *k: "greatest(0, least({}) - greatest({})) * greatest(0, least({}) - greatest({}))".format(*(", ".join(f"{c}{i}" for i in k) for c in "pxqy"))
    pairs = [(0, 1), (0, 2), (1, 2)]
    return {
        "trio": f"select s_suppkey, {', '.join(ends)} from supplier",
        "covered": f"select s_suppkey, {' + '.join(meet(i) for i in range(3))} - ({' + '.join(meet(*k) for k in pairs)}) + {meet(0, 1, 2)} as area, 3 - least(2, {' + '.join(f'case when {meet(*k)} > 0 then 1 else 0 end' for k in pairs)}) as n_parts from trio",
    }


@query(over("select s_suppkey, n_parts, n_parts as n_rings, area from covered", steps=_trio_sql()))
def dissolve_overlaps(spark, d):
    """Rectangles that overlap, hold each other or lie apart."""
    boxes = [[F.expr(f"cast({c} as double)") for c in (x, y, f"{x} + {w}", f"{y} + {h}")] for x, y, w, h in _TRIO]
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.explode(F.array(*[geo.rectangle(*b) for b in boxes])).alias("parts"))
    p = F.col("parts")
    return spatial.dissolve(rows, "s_suppkey").select("s_suppkey", F.size(p).alias("n_parts"), F.size(F.flatten(p)).alias("n_rings"), geo.area(p).alias("area"))


@query(over("select c_custkey, kind, " + ", ".join(f"cast(case kind when 0 then {a} when 1 then {b} when 2 then {c} when 3 then {e} else {f} end as {t}) as {n}" for n, t, a, b, c, e, f in [
    ("n_parts", "int", "1", "1", "case when h < 30 then 2 else 1 end", "1", "case when h < 30 then 1 else 2 end"),
    ("n_rings", "int", "1", "1", "case when h < 30 then 2 else 1 end", "case when h < 20 then 2 else 1 end", "case when h < 30 then 1 else 2 end"),
    ("area", "double", "20 * (80 - h) + 60 * greatest(0, 20 - h)", "round_even((60 - h) * (60 - h) * 2 / 3.0::double, 6)", "30 * greatest(0, 30 - h) + 30 * (80 - greatest(h, 50))", "80 * (80 - h) - 40 * (60 - greatest(h, 20))", "80 * greatest(0, 30 - h) + 60 * (80 - greatest(h, 30))"),
]) + " from (select c_custkey, c_custkey % 5 as kind, greatest(0, 40 - c_custkey % 7 * 10) as h from customer)"))
def clip_shapes(spark, d):
    """An L, a triangle, two squares, a square with a hole and a U, cut at heights from 0 to 40."""
    at = lambda kind: F.array(*[F.array(*[F.array(*[geo.point(F.col("x") + i, F.col("y") + j) for i, j in ring]) for ring in part]) for part in kind])
    made = F.when(F.col("kind") == 0, at(KINDS[0]))
    for i, kind in enumerate([*KINDS[1:], [[[(0, 0), (80, 0), (80, 80), (50, 80), (50, 30), (30, 30), (30, 80), (0, 80), (0, 0)]]]], 1):
        made = made.when(F.col("kind") == i, at(kind))
    rows = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", (F.col("c_custkey") % 5).cast("int").alias("kind"), (F.col("c_custkey") % 1000 * 100).alias("x"), (F.col("c_custkey") % 7 * 10).alias("y"))
    p = F.col("parts")
    clipped = spatial.clip_to_box(rows.withColumn("parts", made), -1.0, 40.0, 1e6, 1e6)
    return clipped.select("c_custkey", "kind", F.size(p).alias("n_parts"), F.size(F.flatten(p)).alias("n_rings"), F.bround(geo.area(p), 6).alias("area"))


@query(over("select s_suppkey, side, case when bulge < 3 then 5 else 14 end as n_points, 5000.0::double + case when bulge < 3 then 0 else 10.0 * bulge * case side when 'left' then 1 else -1 end end as area, case when bulge < 3 then 0 else 9 end as met from (select s_suppkey, case s_suppkey % 5 when 0 then 1 when 1 then 2 else 4 + s_suppkey % 5 end as bulge, unnest(['left', 'right']) as side from supplier)"))
def simplify_shared(spark, d):
    """Two neighbours with a zigzag border: small teeth go, large ones stay, on both sides alike. met: inner vertices of
    the border that both have."""
    bulge = F.expr("case s_suppkey % 5 when 0 then 1 when 1 then 2 else 4 + s_suppkey % 5 end")
    rows = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", bulge.alias("bulge"), (F.col("s_suppkey") % 1000 * 1000.0).alias("x"), (F.col("s_suppkey") % 7 * 1000.0).alias("y"))
    at = lambda i, j: geo.point(F.col("x") + i, F.col("y") + j)
    teeth = [at(50 + (F.col("bulge") if k % 2 else -F.col("bulge")), 10 * k) for k in range(1, 10)]
    left = F.array(at(0, 0), at(50, 0), *teeth, at(50, 100), at(0, 100), at(0, 0))
    right = F.array(at(50, 100), *teeth[::-1], at(50, 0), at(100, 0), at(100, 100), at(50, 100))
    pair = F.array(F.struct(F.lit("left").alias("side"), geo.polygon(left).alias("parts")), F.struct(F.lit("right").alias("side"), geo.polygon(right).alias("parts")))
    made = outlines.simplify_shared(rows.select("s_suppkey", F.explode(pair).alias("s")).select("s_suppkey", "s.*"), 2.5)
    ring = F.col("parts")[0][0]
    own = made.select("s_suppkey", "side", F.size(ring).alias("n_points"), geo.area(F.col("parts")).alias("area"), ring.alias("ring"))
    other = own.select("s_suppkey", F.when(F.col("side") == "left", "right").otherwise("left").alias("side"), F.col("ring").alias("beside"))
    met = F.size(F.array_intersect("ring", "beside")) - 2  # without the border's two ends
    return own.join(other, ["s_suppkey", "side"]).select("s_suppkey", "side", "n_points", "area", met.alias("met"))


# Whole scales


_CELLS = {"cells": "select cell_key, x, y, case when cell_key % 9 = 0 then -99997 when cell_key % 8 = 0 then 0 else cell_key % 50 end as people from fx_cells"}


@query(over(f"select cell_key, people, round_even({LNG_SQL}, 5) as lng, round_even({LAT_SQL}, 5) as lat from cells where x > 60000 and x < 96000 and y > 420000 and y < 444000 and people > 0", "fx_cells", steps=_CELLS))
def process_grid(spark, d):
    people = F.expr("case when cell_key % 9 = 0 then -99997 when cell_key % 8 = 0 then 0 else cell_key % 50 end")
    cells = stand_in(spark, d, "fx_cells").withColumn("people", people).withColumn("nothing", F.lit(-99995))
    boundary = spatial.dissolve(areas(spark, d).where("x0 <= 84000 and y0 <= 432000").withColumn("all", F.lit(1)), "all")
    return scales.process_grid(cells, boundary, "cell_key", "people", tile=60000.0)


@query(over("select 'grid' as scale, count(*) as n_rows, 1 as n_columns, 1 as n_dropped from cells where x > 60000 and x < 96000 and y > 420000 and y < 444000 and people > 0", "fx_cells", steps=_CELLS))
def export_grid(spark, d):
    people = F.expr("case when cell_key % 9 = 0 then -99997 when cell_key % 8 = 0 then 0 else cell_key % 50 end")
    cells = stand_in(spark, d, "fx_cells").withColumn("people", people).withColumn("nothing", F.lit(-99995))
    boundary = scales.build_boundary(areas(spark, d), "code", ["GM0001", "GM0002", "GM0003", "GM0006", "GM0007", "GM0008"])
    rows = scales.process_grid(cells, boundary, "cell_key", "people", tile=6000.0)
    return spark.createDataFrame([scales.export_grid(rows, cells, "cell_key", "grid", scratch(spark))], "scale string, n_rows long, n_columns int, n_dropped int")


_SHAPED = f"5 as n_points, round_even({LNG_SQL}, 5) as lng, round_even({LAT_SQL}, 5) as lat"


def shaped(df: DataFrame, *columns: str) -> DataFrame:
    ring = F.col("parts")[0][0]
    return df.select(*columns, F.size(ring).alias("n_points"), F.bround(ring[0]["x"], 5).alias("lng"), F.bround(ring[0]["y"], 5).alias("lat"))


@query(over(f"select a.code, a.name, s.n, {_SHAPED} from (select *, x0 as x, y0 as y from fx_areas) a join (select " + CODE.format("c_nationkey + 1") + " as k, case when count(*) % 5 = 0 then null else count(*) end as n from customer where c_nationkey <> 7 group by 1) s on a.code = s.k where a.x0 <= 90000 and a.y0 <= 440000 and (a.water is null or a.water <> 'WATER')", "fx_areas"))
def process_admin_scale(spark, d):
    stats = spark.read.parquet(f"{d}/customer.parquet").where("c_nationkey <> 7").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    stats = stats.select(format_code(F.col("c_nationkey") + 1).alias("k"), F.when(F.col("n") % 5 == 0, -99997).otherwise(F.col("n")).alias("n"), F.lit(1).alias("raw_7"))
    return shaped(scales.process_admin_scale(stats, areas(spark, d), "k", "code", box(spark, 61000.0, 421000.0, 90000.0, 440000.0)), "code", "name", "n")


@query(over(f"select code, name, {_SHAPED} from (select *, x0 as x, y0 as y from fx_areas) where x0 <= 80000 and y0 <= 470000", "fx_areas"))
def process_postcodes(spark, d):
    return shaped(scales.process_postcodes(areas(spark, d), box(spark, 61000.0, 421000.0, 80000.0, 470000.0), "code"), "code", "name")


@query(over("select code, name, province, 5 as n_points, (select count(*) from fx_areas) as n_rows, 2 as n_columns from fx_areas", "fx_areas"))
def export_split_stats(spark, d):
    folder = scratch(spark)
    report = layers.export_scale(areas(spark, d).select("code", "name", "province", "parts"), "code", "gemeente", folder, tolerance=1.0)
    made = layers.read_features(spark, f"{folder}/gemeente.geojson", "code:string").select("code", F.size(F.col("parts")[0][0]).alias("n_points"))
    return spark.read.parquet(f"{folder}/gemeente_stats").join(made, "code").withColumns({k: F.lit(report[k]) for k in ("n_rows", "n_columns")})
