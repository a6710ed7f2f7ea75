"""Stand-ins for areas, cells, statistics, cubes and flows, derived from the driver's tables.

Each statement runs unchanged on Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import point, rectangle
from ..sources.scratch import spread

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

SQL = {
    "fx_areas": """select 'GM' || lpad(cast(n_nationkey + 1 as string), 4, '0') as code, n_name as name, n_regionkey as province,
 cast(60000 + (n_nationkey % 5) * 12000 as double) as x0, cast(420000 + floor(n_nationkey / 5.0) * 12000 as double) as y0,
 case when n_nationkey % 6 = 0 then 'WATER' when n_nationkey % 6 = 1 then null else 'LAND' end as water from nation""",
    "fx_codes": """select 'BU' || lpad(cast(c_nationkey + 1 as string), 4, '0') || lpad(cast(c_custkey as string), 6, '0') || '  ' as area_code from customer
 union all select 'WK' || lpad(cast(s_nationkey + 1 as string), 4, '0') || lpad(cast(s_suppkey as string), 4, '0') || '  ' from supplier
 union all select 'GM' || lpad(cast(n_nationkey + 1 as string), 4, '0') || '  ' from nation""",
    "fx_stats": """select 'BU' || lpad(cast(c_nationkey + 1 as string), 4, '0') || lpad(cast(c_custkey as string), 6, '0') as id,
 case when c_custkey % 23 = 0 then -99997 when c_custkey % 29 = 0 then null when c_custkey % 31 = 0 then 0 else 50 + (c_custkey * 37) % 4000 end as inhabitants,
 case when c_custkey % 19 = 0 then -99995 else (c_custkey * 13) % 1700 end as dwellings,
 case when c_custkey % 17 = 0 then cast(-99994 as double) else c_acctbal end as income,
 (c_custkey % 7) * 40 as land_ha, -99995 as all_suppressed,
 case when c_custkey % 2 = 0 then -99997 else null end as suppressed_or_null, cast(c_custkey as int) as raw_12 from customer""",
    "fx_cells": """select c_custkey as cell_key, cast(60000 + ((c_custkey * 37) % 600) * 100 + 50 as double) as x, cast(420000 + ((c_custkey * 91) % 600) * 100 + 50 as double) as y from customer""",
    "fx_flows": """select c.c_nationkey + 1 as source, s.s_nationkey + 1 as sink,
 case when year(o.o_orderdate) <= 1998 then '19951998' else '19992001' end as periode, cast(l.l_quantity as bigint) as count
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join supplier s on l.l_suppkey = s.s_suppkey""",
    "fx_cube": """select s_nationkey + 1 as gem, year(l_shipdate) as jaar, l_linenumber as age, l_returnflag as opl, l_linestatus as soortbaan, sum(cast(l_quantity as bigint)) as value
 from lineitem join supplier on l_suppkey = s_suppkey
 group by grouping sets ((s_nationkey, year(l_shipdate), l_linenumber, l_returnflag, l_linestatus), (s_nationkey, year(l_shipdate), l_linenumber), (s_nationkey, year(l_shipdate), l_returnflag), (s_nationkey, year(l_shipdate), l_linestatus), (s_nationkey, year(l_shipdate)))""",
    "fx_shapes": """select c_custkey as shape_key, c_custkey % 4 as kind, cast(60000 + ((c_custkey * 37) % 600) * 100 as double) as x0, cast(420000 + ((c_custkey * 91) % 600) * 100 as double) as y0 from customer""",
    "fx_boxes": """select s_suppkey as box_key, cast(60000 + ((s_suppkey * 53) % 600) * 100 + (s_suppkey * 17) % 90 as double) as bx, cast(420000 + ((s_suppkey * 29) % 600) * 100 + (s_suppkey * 31) % 90 as double) as b_y, cast(10 + (s_suppkey % 3) * 60 as double) as side from supplier""",
    "fx_spots": """select p_partkey as spot_key, cast(60000 + ((p_partkey * 37) % 600) * 100 + (p_partkey * 13) % 90 as double) as x, cast(420000 + ((p_partkey * 91) % 600) * 100 + (p_partkey * 7) % 90 as double) as y from part""",
    "fx_centroids": """select 'GM' || lpad(cast(n_nationkey + 1 as string), 4, '0') as id, p.pos, cast(3.5 + (n_nationkey % 5) * 0.2 + p.pos * 0.01 as double) as lng, cast(51.0 + floor(n_nationkey / 5.0) * 0.2 as double) as lat
 from nation cross join (select 0 as pos union all select 1 as pos) p where n_nationkey <> 24 and (p.pos = 0 or n_nationkey % 4 = 0)""",
}


def stand_in(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for t in TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(SQL[name])


def areas(spark: SparkSession, sf_dir: str, size: float = 12000.0) -> DataFrame:
    """The area squares with their shapes."""
    x, y = F.col("x0"), F.col("y0")
    return stand_in(spark, sf_dir, "fx_areas").withColumn("parts", rectangle(x, y, x + size, y + size))


#: Shapes of the layer fx_shapes by their kind, from (x0, y0): an L, a triangle, two squares, a square with a hole.
KINDS = [
    [[[(0, 0), (80, 0), (80, 20), (20, 20), (20, 80), (0, 80), (0, 0)]]],
    [[[(0, 0), (80, 0), (0, 60), (0, 0)]]],
    [[[(0, 0), (30, 0), (30, 30), (0, 30), (0, 0)]], [[(50, 50), (80, 50), (80, 80), (50, 80), (50, 50)]]],
    [[[(0, 0), (80, 0), (80, 80), (0, 80), (0, 0)], [(20, 20), (20, 60), (60, 60), (60, 20), (20, 20)]]],
]


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_shapes with parts: one shape per customer, so the layer grows with the tables."""
    x, y = F.col("x0"), F.col("y0")
    at = lambda kind: F.array(*[F.array(*[F.array(*[point(x + i, y + j) for i, j in ring]) for ring in part]) for part in kind])
    made = F.when(F.col("kind") == 0, at(KINDS[0]))
    for i, kind in enumerate(KINDS[1:], 1):
        made = made.when(F.col("kind") == i, at(kind))
    return spread(stand_in(spark, sf_dir, "fx_shapes")).withColumn("parts", made)


def shape_wkt_sql() -> str:
    """The WKT of fx_shapes in DuckDB SQL."""
    vertex = lambda p: f"(x0 + {p[0]})::bigint || ' ' || (y0 + {p[1]})::bigint"
    ring = lambda r: "'(' || " + " || ', ' || ".join(map(vertex, r)) + " || ')'"
    part = lambda p: "'(' || " + " || ', ' || ".join(map(ring, p)) + " || ')'"
    body = lambda k: "'POLYGON ' || " + part(k[0]) if len(k) == 1 else "'MULTIPOLYGON (' || " + " || ', ' || ".join(map(part, k)) + " || ')'"
    return "case kind " + " ".join(f"when {i} then {body(k)}" for i, k in enumerate(KINDS)) + " end"


def over(select: str, *names: str, steps: dict[str, str] | None = None) -> str:
    """A DuckDB statement over stand-ins and further named steps, if any."""
    parts = {n: SQL[n] for n in names} | (steps or {})
    return f"with {', '.join(f'{n} as ({q})' for n, q in parts.items())} {select}" if parts else select
