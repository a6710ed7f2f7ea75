"""Area operators: every query against DuckDB on the smallest tables, and the traps on small frames."""

import json
import math
import os
import random
import threading
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from arealoom.functions import geometry as geo
from arealoom.functions import values
from arealoom.operators import breaks, clean, cube, flows, outlines, spatial
from arealoom.plans import maps, queries, scales, stand_ins
from arealoom.sources import layers


@pytest.fixture(scope="module")
def con(small_dir):
    made = duckdb.connect()
    for f in os.listdir(small_dir):
        if f.endswith(".parquet"):
            made.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{small_dir}/{f}')")
    return made


def plain(rows):
    near = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(repr([near(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small_dir, con, name):
    made = queries.QUERIES[name](spark, small_dir)
    columns = sorted(made.columns)
    rows = [[r[c] for c in columns] for r in made.collect()]
    result = con.execute(queries.ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    want = [[r[names.index(c)] for c in columns] for r in result.fetchall()]
    assert plain(rows) == plain(want)


def test_codes(spark):
    df = spark.createDataFrame([("363",), ("GM363",), ("gm0363",), ("12345",), ("x",), (None,), ("363.7",), ("NaN",), ("1e3",), ("-5",), ("inf",), ("1e300",), ("9" * 30,), ("",)], "c string")
    got = [r[0] for r in df.select(values.format_code(F.col("c"))).collect()]
    assert got == ["GM0363", "GM0363", "GM0363", "GM12345", None, None, "GM0363"] + [None] * 7
    assert spark.range(363, 364).select(values.format_code(F.col("id"))).first()[0] == "GM0363"


def test_suppressed_columns(spark):
    df = spark.createDataFrame([("a", -99995, -99997, None, 1), ("b", -99997, None, None, -99995)], "id string, dropped int, mixed int, nothing int, kept int")
    assert clean.drop_suppressed_columns(df).columns == ["id", "mixed", "nothing", "kept"]
    assert clean.drop_suppressed_columns(df, nulls="ignore").columns == ["id", "kept"]
    assert clean.drop_suppressed_columns(df.where("false")).columns == ["id"]
    assert clean.null_suppressed(df).first().dropped is None


def test_breaks_and_classes(spark):
    of = lambda vs: spark.createDataFrame([(float(v) if v is not None else None,) for v in vs], "v double")
    assert breaks.breaks_of(of(range(1, 9)), "v") == [3.0, 5.0, 7.0]
    assert breaks.breaks_of(of([1, 2, 3]), "v") == []
    assert breaks.breaks_of(of([]), "v") == []
    assert breaks.breaks_of(of([5] * 10), "v") == [5.0] * 3
    odd = of([*range(1, 9), None, -99997, math.nan, math.inf])
    classed = {str(r.value): r.cls for r in maps.choropleth(odd.withColumn("id", F.col("v").cast("string")), "id", F.col("v")).collect()}
    assert [classed[f"{v:.1f}"] for v in range(1, 9)] == [0, 0, 0, 1, 1, 2, 2, 3]
    assert [classed[k] for k in ("None", "-99997.0", "nan", "inf")] == [-1] * 4
    few = maps.choropleth(of([1, 2]).withColumn("id", F.col("v")), "id", F.col("v")).collect()
    assert {r.cls for r in few} == {0}
    grouped = spark.range(4000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1013).cast("double").alias("v"))
    for r in breaks.group_breaks(grouped, ["g"], "v").collect():
        own = sorted(x.v for x in grouped.where(f"g = {r.g}").collect())
        assert r.breaks == [own[min((i + 1) * len(own) // 4, len(own) - 1)] for i in range(3)]


def test_break_edges_are_evaluated_once(spark):
    rows = spark.range(4000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = breaks.group_breaks(rows, ["g"], "v")._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "parquet" in plan.lower() and "Range (" not in plan


@pytest.mark.parametrize("sorted_, buckets", [(40, 8), (1, 2)])
def test_selection_in_rounds(spark, monkeypatch, sorted_, buckets):
    """Values of all magnitudes, a task sorts a few of them only."""
    monkeypatch.setattr(breaks, "SORTED", sorted_)
    monkeypatch.setattr(breaks, "BUCKETS", buckets)
    rng = random.Random(5)
    values_ = {"wide": [rng.choice([-90000, -1, 1]) * 10 ** rng.uniform(-300, 0) for _ in range(700)] + [0.0] * 9, "even": [float(i * 7919 % 2003) for i in range(2003)], "same": [5.5] * 300}
    values_["close"] = [1.0 + i * 2**-52 for i in range(500)]
    rows = spark.createDataFrame([(k, v) for k, vs in values_.items() for v in vs], "g string, v double")
    got = {r.g: r.breaks for r in breaks.group_breaks(rows, ["g"], "v", 7).collect()}
    for k, vs in values_.items():
        own = sorted(v for v in vs if v > -99990)
        assert got[k] == [own[min(math.floor((i + 1) / 7 * len(own)), len(own) - 1)] for i in range(6)]


def test_quantiles_hold_no_whole_column(spark, small_dir):
    assert "percentile(" not in queries.QUERIES["quantile_breaks_doc"](spark, small_dir)._jdf.queryExecution().toString()
    rows = spark.range(3001).select((F.col("id") % 3 % 2).alias("g"), (F.col("id") * 7919 % 1013 / 7).alias("v"))
    spots = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, spots))).alias("q")).collect()}
    got = {(r.g, r.i): r.value for r in breaks.group_quantiles(rows, ["g"], "v", spots).collect()}
    assert got == pytest.approx({(g, i): v for g, q in want.items() for i, v in enumerate(q)})


def test_ratios_and_rounding(spark):
    on = [("a",), ("b",), ("c",)]
    work = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "k string, work int")
    people = spark.createDataFrame([("a", 0), ("b", None)], "k string, people int")
    home = spark.createDataFrame(on, "k string").withColumn("home", F.lit(1))
    got = {r.k: r.work_per_person for r in cube.nodes_summary(work, home, people, ["k"]).collect()}
    assert got == {"a": 5.0, "b": None, "c": None}
    sums = spark.createDataFrame([(1, 2, "p", 3), (1, 3, "p", 9), (1, 4, "p", 15), (1, 5, "p", 0)], "o int, d int, p string, value int")
    assert sorted(r.flow_value for r in flows.edges(sums, "o", "d", "p", 6).collect()) == [2.0, 2.0]


def test_flow_summaries(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("a", None, 3.0), ("b", "x", None), ("b", "x", None)], "origin_id string, destination_id string, flow_value double")
    got = {r.origin_id: (r.total_outflow, r.n_destinations) for r in flows.flow_summary(df).collect()}
    assert got == {"a": (6.0, 3), "b": (0.0, 1)}
    same, report = flows.validate_flows(df, spark.createDataFrame([("a",), ("x",)], "id string"), "id")
    assert same is df and tuple(report.first()) == (5, 2, 2, 2)
    with pytest.raises(ValueError, match="flow_value"):
        flows.validate_flows(df.drop("flow_value"), df, "origin_id")


def test_missing_codes_and_formulas(spark):
    layer = spark.createDataFrame([("A",), ("B",)], "code string")
    wanted = spark.createDataFrame([("A",), ("Z",)], "w string")
    assert [r.code for r in clean.require_codes(layer, "code", wanted).collect()] == ["Z"]
    with pytest.raises(ValueError, match="Z"):
        clean.require_codes(layer, "code", wanted, strict=True)
    with pytest.raises(ValueError, match="not allowed"):
        maps.computed(layer, "x", "code / other", ["code"])
    assert maps.stats_choropleth(layer, "code", "absent").collect() == []
    assert scales.postcodes_of(layer, wanted, "code", "pc", "province", "x").count() == 2


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def shape(spark, *parts, **columns):
    return spark.createDataFrame([([[ring(r) for r in p] for p in parts],)], f"parts {geo.PARTS}").withColumns({k: F.lit(v) for k, v in columns.items()})


SQUARE = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
HOLE = [(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)]
L_SHAPE = [(0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0)]


def move(points, x, y):
    return [(a + x, b + y) for a, b in points]


def test_measures_and_predicates(spark):
    for hole in (HOLE, HOLE[::-1]):  # rings may turn either way
        holed = shape(spark, [SQUARE, hole])
        assert holed.select(geo.area(F.col("parts"))).first()[0] == 12.0
        assert tuple(holed.select(geo.centroid(F.col("parts"))).first()[0]) == (2.0, 2.0)
    two = shape(spark, [SQUARE], [move(SQUARE, 10, 0)[::-1]])
    assert two.select(geo.area(F.col("parts"))).first()[0] == 32.0 and tuple(two.select(geo.centroid(F.col("parts"))).first()[0]) == (7.0, 2.0)
    point = lambda df, x, y: df.select(geo.within(F.col("parts"), F.lit(float(x)), F.lit(float(y)))).first()[0]
    assert [point(holed, *p) for p in ((0.5, 2), (2, 2), (0, 2), (1, 2), (5, 2), (4, 4))] == [True, False, False, False, False, False]
    assert [point(two, *p) for p in ((2, 2), (12, 2), (7, 2))] == [True, True, False]
    l_shape = shape(spark, [L_SHAPE])
    assert [point(l_shape, *p) for p in ((0.5, 3), (3, 3), (3, 0.5))] == [True, False, True]


def test_intersects(spark):
    small = [(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 1.5)]
    pairs = [([[SQUARE]], [[move(SQUARE, *p)]], met) for p, met in (((4, 0), True), ((4, 4), True), ((5, 0), False), ((1, 1), True))]
    pairs += [([[SQUARE]], [[small]], True), ([[SQUARE]], [[move(L_SHAPE, 4.5, 0)]], False), ([[SQUARE, HOLE]], [[small]], False)]
    # only the second part lies wholly inside the other shape
    pairs += [([[move(SQUARE, 50, 50)], [small]], [[SQUARE]], True), ([[move(SQUARE, 50, 50)], [small]], [[SQUARE, HOLE]], False)]
    apart = lambda n, s: [[ring(move(r, 300 * n, 0)) for r in p] for p in s]
    rows = spark.createDataFrame([(n, apart(n, one), apart(n, two)) for n, (one, two, _) in enumerate(pairs)], f"k int, parts {geo.PARTS}, o {geo.PARTS}").cache()
    ways = rows.select("k", geo.intersects(F.col("parts"), F.col("o")).alias("w"), geo.intersects(F.col("o"), F.col("parts")).alias("v")).collect()
    want = {n for n, p in enumerate(pairs) if p[2]}
    assert {r.k for r in ways if r.w} == {r.k for r in ways if r.v} == want
    one, two = rows.select("k", "parts"), rows.select("k", F.col("o").alias("parts"))
    for a, b, tile in ((one, two, 1.5), (two, one, 100.0)):
        assert {r.k for r in spatial.touching(a, b, "k", tile).collect()} == want


def test_texts_keep_parts(spark):
    two = shape(spark, [SQUARE, HOLE], [move(SQUARE, 10, 0)])
    text = two.select(geo.to_wkt(F.col("parts")).alias("t"))
    assert text.first()[0] == "MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 1 3, 3 3, 3 1, 1 1)), ((10 0, 14 0, 14 4, 10 4, 10 0)))"
    assert text.select(geo.from_wkt(F.col("t")).alias("parts")).first() == two.first()
    of = lambda t: spark.createDataFrame([(t,)], "t string").select(geo.from_wkt(F.col("t")).alias("parts")).first().parts
    assert of(" polygon((0 0,4 0 , 4 4,0 0),( 1 1, 2 1, 2 2, 1 1 ) ) ") == [[[tuple(map(float, p)) for p in r] for r in ([(0, 0), (4, 0), (4, 4), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)])]]
    assert of("POINT (1 2)") is None and of(None) is None and of("POLYGON EMPTY") is None
    made = json.loads(layers.features(two.withColumn("id", F.lit('a"}')), "id", layers.geojson(F.col("parts")), ["id"]).first().feature)
    assert made["id"] == made["properties"]["id"] == 'a"}' and made["geometry"]["type"] == "MultiPolygon"
    assert [len(p) for p in made["geometry"]["coordinates"]] == [2, 1]


def test_shapes(spark):
    clipped = spatial.clip_to_box(shape(spark, [L_SHAPE]), 0.5, 0.5, 10, 10).select(geo.area(F.col("parts"))).first()[0]
    assert clipped == pytest.approx(7 - 0.5 * 4 - 0.5 * 3.5)
    assert spatial.clip_to_box(shape(spark, [SQUARE]), 10, 10, 20, 20).collect() == []
    triangle = [(0, 0), (8, 0), (0, 8), (0, 0)]
    parts = spatial.clip_to_box(shape(spark, [SQUARE, HOLE], [move(SQUARE, 10, 0)], [move(triangle, 0, 20)]), 0, 0, 2, 100)
    assert parts.select(F.size("parts"), geo.area(F.col("parts"))).first() == (2, 2 * 4 - 2 + 14.0)
    dense = [(math.cos(t / 50) * 10, math.sin(t / 50) * 10) for t in range(314)]
    ring_ = spatial.simplify(shape(spark, [[*dense, dense[0]]]), 0.1).first().parts[0][0]
    assert 4 <= len(ring_) < 60 and ring_[0] == ring_[-1]
    assert len(spatial.simplify(shape(spark, [SQUARE]), 100.0).first().parts[0][0]) >= 4
    rows = spark.createDataFrame([(1, [[ring(SQUARE)]]), (2, None), (3, []), (4, [[ring(SQUARE), ring(HOLE)], [ring(L_SHAPE)]])], f"k int, parts {geo.PARTS}")
    assert [r.parts and [len(p) for p in r.parts] for r in spatial.simplify(rows, 0.1).orderBy("k").collect()] == [[1], None, [], [2, 1]]
    report = scales.shape_report(shape(spark, [SQUARE], code="a"), "code").first()
    assert report.closed and report.has_area


def dissolved(spark, groups):
    rows = [(g, [[ring(r) for r in p] for p in s]) for g, shapes in groups.items() for s in shapes]
    made = spatial.dissolve(spark.createDataFrame(rows, f"g string, parts {geo.PARTS}"), "g")
    return {r.g: (r.n, r.rings, r.area) for r in made.select("g", F.size("parts").alias("n"), F.size(F.flatten("parts")).alias("rings"), geo.area(F.col("parts")).alias("area")).collect()}


def test_dissolve_of_shapes_that_overlap(spark):
    """Boxes on a grid against counted cells, triangles against a sample of points."""
    box = lambda x, y, w, h: [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    groups = {
        "overlap": [[[box(0, 0, 10, 10)]], [[box(5, 5, 10, 10)]]], "inside": [[[box(0, 0, 10, 10)]], [[box(2, 2, 2, 2)]]], "cross": [[[box(0, 4, 10, 2)]], [[box(4, 0, 2, 10)]]],
        "near": [[[box(0, 0, 10, 10)]], [[[(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 0)]]], [[box(10, 0, 10, 10)]]],
        "hole": [[[box(0, 0, 10, 10), box(3, 3, 4, 4)]], [[box(4, 4, 2, 2)]]], "frame": [[[box(*b)]] for b in ((0, 0, 10, 2), (0, 8, 10, 2), (0, 0, 2, 10), (8, 0, 2, 10))],
    }
    rng = random.Random(1)
    grids, triangles = {}, {}
    for k in range(8):
        boxes = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 15), rng.randrange(1, 15)) for _ in range(12)]
        groups[f"grid{k}"], grids[f"grid{k}"] = [[[box(*b)]] for b in boxes], float(len({(x + i, y + j) for x, y, w, h in boxes for i in range(w) for j in range(h)}))
        own = [[(rng.random() * 40, rng.random() * 40) for _ in range(3)] for _ in range(8)]
        groups[f"tri{k}"], triangles[f"tri{k}"] = [[[[*t, t[0]]]] for t in own], own
    got = dissolved(spark, groups)
    assert {k: got[k] for k in list(groups)[:6]} == {"overlap": (1, 1, 175.0), "inside": (1, 1, 100.0), "cross": (1, 1, 36.0), "near": (1, 1, 200.0), "hole": (2, 3, 88.0), "frame": (1, 2, 64.0)}
    assert {k: got[k][2] for k in grids} == grids
    spots = [(rng.random() * 40, rng.random() * 40) for _ in range(20_000)]
    left = lambda p, q, s: (q[0] - p[0]) * (s[1] - p[1]) - (q[1] - p[1]) * (s[0] - p[0]) > 0
    for k, own in triangles.items():
        held = sum(any(left(t[0], t[1], s) == left(t[1], t[2], s) == left(t[2], t[0], s) for t in own) for s in spots)
        assert got[k][2] == pytest.approx(held / len(spots) * 1600, abs=30)


def test_clip_of_concave_shapes(spark):
    u = [(0, 0), (30, 0), (30, 30), (20, 30), (20, 10), (10, 10), (10, 30), (0, 30), (0, 0)]
    of = lambda parts, *box: [[len(p), r.a] for r in spatial.clip_to_box(shape(spark, *parts), *map(float, box)).select("parts", geo.area(F.col("parts")).alias("a")).collect() for p in [r.parts]]
    assert of([[u]], 0, 20, 30, 30) == of([[u[::-1]]], 0, 20, 30, 30) == [[2, 200.0]]
    assert of([[u]], -5, -5, 35, 35) == [[1, 700.0]] and of([[u]], -1, 5, 31, 15) == [[1, 250.0]]
    assert of([[SQUARE, HOLE]], 2, 2, 9, 9) == [[1, 3.0]] and of([[SQUARE, HOLE]], 0.5, 0.5, 3.5, 3.5) == [[1, 5.0]] and of([[SQUARE, HOLE]], 1.5, 1.5, 2.5, 2.5) == []
    assert of([[SQUARE]], 0, 0, 4, 4) == [[1, 16.0]] and of([[SQUARE]], 4, 0, 8, 4) == [] and of([[SQUARE]], 1, 1, 2, 2) == [[1, 1.0]]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [[ring(SQUARE)]])], f"k int, parts {geo.PARTS}")
    assert [r.k for r in spatial.clip_to_box(rows, 0.0, 0.0, 9.0, 9.0).collect()] == [3]


def test_simplified_neighbours_keep_their_borders(spark):
    """A grid of cells with crooked borders and an island: the sum of areas and the shared vertices stay."""
    rng = random.Random(2)
    corner = {(i, j): (10.0 * i, 10.0 * j) for i in range(5) for j in range(5)}
    line = {}
    for (i, j), (di, dj) in ((c, d) for c in corner for d in ((1, 0), (0, 1))):
        if (i + di, j + dj) in corner:
            line[(i, j), (i + di, j + dj)] = [corner[i, j], *((10 * i + di * k + dj * rng.uniform(-0.4, 0.4), 10 * j + dj * k + di * rng.uniform(-0.4, 0.4)) for k in range(1, 10)), corner[i + di, j + dj]]
    way = lambda p, q: line[p, q] if (p, q) in line else line[q, p][::-1]
    cells = [(i, j, [x for p, q in (((i, j), (i + 1, j)), ((i + 1, j), (i + 1, j + 1)), ((i + 1, j + 1), (i, j + 1)), ((i, j + 1), (i, j))) for x in way(p, q)[:-1]]) for i in range(4) for j in range(4)]
    island = [(4.0, 4.0), (6.0, 4.0), (6.0, 6.0), (4.0, 6.0), (4.0, 4.0)]
    rows = [(10 * i + j, [[ring([*r, r[0]]), *([ring(island)] if (i, j) == (0, 0) else [])]]) for i, j, r in cells] + [(99, [[ring(island)]]), (100, None), (101, [])]
    made = {r.k: r for r in outlines.simplify_shared(spark.createDataFrame(rows, f"k int, parts {geo.PARTS}"), 1.0).withColumn("a", geo.area(F.col("parts"))).collect()}
    assert made[100].parts is None and made[101].parts == [] and len(made[99].parts[0][0]) == 5 and len(made[0].parts[0]) == 2
    assert all(len(made[10 * i + j].parts[0][0]) == 5 for i, j, _ in cells)  # small teeth go, the corners stay
    assert sum(r.a for r in made.values() if r.parts) == pytest.approx(1600.0)
    kept = {r.k: r for r in outlines.simplify_shared(spark.createDataFrame(rows, f"k int, parts {geo.PARTS}"), 0.05).collect()}
    points = lambda k: {tuple(p) for p in kept[k].parts[0][0]}
    for i, j, r in cells:
        for other in ((i + 1, j), (i, j + 1)):
            if max(other) < 4:
                border = set(way(*(((i + 1, j), (i + 1, j + 1)) if other[0] > i else ((i, j + 1), (i + 1, j + 1)))))
                assert points(10 * i + j) & border == points(10 * other[0] + other[1]) & border


def test_arcs_that_would_cross_are_simplified_less(spark):
    """A spike of a neighbour reaches into a bay that the plain simplification closes."""
    bay = [(0, 0), (10, 0), (10, 4), (6, 4), (5, 1), (4, 4), (0, 4), (0, 0)]
    spike = [(5, 3), (5.2, 8), (4.8, 8), (5, 3)]
    rows = spark.createDataFrame([(1, [[ring(bay)]]), (2, [[ring(spike)]])], f"k int, parts {geo.PARTS}")
    made = outlines.simplify_shared(rows, 3.5)
    assert made.count() == 2
    one, two = (made.where(f"k = {k}").select(F.col("parts").alias(f"p{k}")) for k in (1, 2))
    assert not one.crossJoin(two).select(geo.intersects(F.col("p1"), F.col("p2"))).first()[0]


def test_a_flat_ring_is_held_once(spark):
    n = 5000
    flat = [(i * 0.04, 0.2 + 0.1 * (i % 2)) for i in range(n)] + [(n * 0.04, 0.9), (0, 0.9), (0, 0.2)]
    held = spatial.area_tiles(shape(spark, [flat], code="a"), "code", 1.0).select(F.sum(F.coalesce(F.size("_sides"), F.lit(0)))).first()[0]
    assert held < 2 * n


def test_dissolve(spark):
    cells = [(x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    unit, half = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], [(0, 0), (4, 0), (4, 2), (0, 2), (0, 0)]
    slope = [(0, 0), (6, 0), (6, 3), (0, 0)]
    groups = {
        "ring": [[[move(unit, x, y)]] for x, y in cells], "turned": [[[move(unit, x, y)[:: -1 if (x + y) % 2 else 1]]] for x, y in cells],
        "apart": [[[SQUARE]], [[move(SQUARE, 20, 0)]]], "parts": [[[SQUARE], [move(SQUARE, 20, 0)]], [[move(SQUARE, 4, 0)]]],
        "junction": [[[SQUARE]], [[move(half, 4, 0)]], [[move(half, 4, 2)]]],
        "island": [[[move(SQUARE, 0, 0), HOLE]], [[[(1.5, 1.5), (2.5, 1.5), (2.5, 2.5), (1.5, 2.5), (1.5, 1.5)]]]],
        "slopes": [[[slope]], [[[(0, 0), (2, 1), (0, 4), (0, 0)]]], [[[(2, 1), (6, 3), (0, 4), (2, 1)]]]],
    }
    assert dissolved(spark, groups) == {
        "ring": (1, 2, 8.0), "turned": (1, 2, 8.0), "apart": (2, 2, 32.0), "parts": (2, 2, 48.0), "junction": (1, 1, 32.0), "island": (2, 3, 13.0), "slopes": (1, 1, 9.0 + 4.0 + 8.0),
    }


def test_dissolve_counts_a_repeated_polygon_once(spark):
    turned = [*SQUARE[2:], *SQUARE[1:3]]
    inner = [(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)]
    groups = {
        "twice": [[[SQUARE]]] * 2, "three": [[[SQUARE]]] * 3, "turned": [[[SQUARE]], [[turned]]], "reversed": [[[SQUARE]], [[SQUARE[::-1]]]],
        "beside": [[[SQUARE]], [[move(SQUARE, 4, 0)]], [[SQUARE]]], "filled": [[[SQUARE, HOLE]], [[inner]], [[SQUARE, HOLE]]],
    }
    assert dissolved(spark, groups) == {g: (1, 1, 32.0 if g == "beside" else 16.0) for g in groups}
    codes = scales.boundary_levels(spark.createDataFrame([("a", [[ring(SQUARE)]])], f"code string, parts {geo.PARTS}"), spark.createDataFrame([(1, "a"), (1, "a")], "level int, code string"), "code")
    assert codes.count() == 1


def test_many_points_in_an_area_of_many_vertices(spark):
    n = 20_000
    star = [((r := 40_000 + 9_000 * math.cos(t * 40 * math.tau / n)) * math.cos(t * math.tau / n), r * math.sin(t * math.tau / n)) for t in range(n)]
    area = shape(spark, [[*star, star[0]]], code="a")
    points = spark.range(100_000).select("id", (F.pmod(F.col("id") * 7919, F.lit(100_003)) - 50_000.5).alias("x"), (F.pmod(F.col("id") * 104_729, F.lit(100_019)) - 50_000.5).alias("y"))
    began = time.time()
    got = {r.id for r in spatial.points_in_areas(points, area, "code", 1000.0).collect()}
    took = time.time() - began
    far = lambda x, y: math.hypot(x, y) - (40_000 + 9_000 * math.cos(40 * math.atan2(y, x)))
    away = {r.id: far(r.x, r.y) for r in points.collect()}
    assert {i for i, d in away.items() if d < -1} <= got and not got & {i for i, d in away.items() if d > 1}
    assert 30_000 < len(got) < 70_000 and took < 60


def test_exports(spark, tmp_path):
    path = str(tmp_path / "t")
    layers.replace_parquet(spark.range(5), path)
    layers.replace_parquet(layers.read_current(spark, path).where("id > 2"), path)
    assert sorted(r.id for r in layers.read_current(spark, path).collect()) == [3, 4]
    with pytest.raises(Exception, match="boom"):
        layers.replace_parquet(spark.range(3).select(F.raise_error(F.lit("boom")).cast("long").alias("id")), path)
    assert layers.read_current(spark, path).count() == 2
    assert layers.save_table(spark.range(7), "seven", f"file:{tmp_path}/seven") == 7 and layers.save_table(spark.range(3), "seven", f"file:{tmp_path}/three") == 3
    spark.sql("drop table seven")
    assert clean.schema_difference(spark.range(1).selectExpr("id", "1 as a", "2 as b"), spark.range(1).selectExpr("id", "3 as c", "2 as b")) == (["a"], ["c"])
    layer = spark.createDataFrame([("a", 1, 2.5, [[ring(SQUARE)]]), ("b", 2, None, [[ring(SQUARE), ring(HOLE)], [ring(move(SQUARE, 9, 9))]])], f"code string, n int, v double, parts {geo.PARTS}")
    report = layers.export_scale(layer, "code", "s", str(tmp_path), digits=5)
    assert report.asDict() == {"scale": "s", "n_rows": 2, "n_features": 2, "n_columns": 2}
    back = layers.read_features(spark, f"{tmp_path}/s.geojson", "code string")
    assert sorted((r.id, r.code, r.geometry_type, len(r.parts)) for r in back.collect()) == [("a", "a", "Polygon", 1), ("b", "b", "MultiPolygon", 2)]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/s_stats").collect())) == [("a", 1, 2.5), ("b", 2, None)]
    whole = str(tmp_path / "c")
    layers.write_collection(layers.features(layer, "code", layers.geojson(F.col("parts")), ["n"]), whole)
    rows = layers.read_collection(spark, whole, "n int").orderBy("id").collect()
    assert [(r.id, r.n, [[len(x) for x in p] for p in r.parts]) for r in rows] == [("a", 1, [[5]]), ("b", 2, [[5, 5], [5]])]
    several = str(tmp_path / "d")
    layers.write_collection(layers.features(spark.range(40).withColumn("x", F.lit(1)), "id", F.lit(None).cast("string"), ["x"]), several, most=7)
    assert sorted(int(r.id) for r in layers.read_collection(spark, several, "x int").collect()) == list(range(40))
    assert len([f for f in os.listdir(several) if f.startswith("document=")]) > 3


def test_readers_during_replacements(spark, tmp_path):
    path, seen, stop = str(tmp_path / "t"), [], threading.Event()
    layers.replace_parquet(spark.range(1), path)

    def read():
        while not stop.is_set():
            seen.append(layers.read_current(spark, path).count())

    reader = threading.Thread(target=read)
    reader.start()
    for n in range(2, 22):
        layers.replace_parquet(spark.range(n), path, keep=50)
    stop.set()
    reader.join()
    assert seen == sorted(seen) and 1 <= seen[0] and len(seen) > 3 and layers.read_current(spark, path).count() == 21
    layers.replace_parquet(spark.range(3), path, keep=1)
    assert len([f for f in os.listdir(path) if f.startswith("v-")]) == 1


def test_layers_and_cubes_read_what_they_need(spark, tmp_path):
    shapes = spark.range(4000).select(F.lit("l").alias("layer"), "id", geo.rectangle(*[F.pmod(F.col("id") * m, F.lit(997)) + w for w in (0, 1) for m in (31, 57)]).alias("parts"))
    layers.write_layers(shapes, str(tmp_path / "l"), tasks=16)
    box = (0.0, 0.0, 100.0, 100.0)
    rows = layers.scan_layer(spark, str(tmp_path / "l"), "l", box)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(xmin,100.0)" in plan and "PartitionFilters: [isnotnull(layer" in plan
    b = geo.bounds(F.col("parts"))
    want = {r.id for r in shapes.where((b["xmin"] <= 100) & (b["ymin"] <= 100)).collect()}
    assert {r.id for r in rows.collect()} == want
    files = {r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) < 8  # of 16: neighbours share a file
    cells = spark.createDataFrame([(1, None, 5), (None, "x", 6), (2, "y", 7), (None, None, 8)], "a int, b string, value int")
    cube.write_cube(cells, ["a", "b"], str(tmp_path / "c"))
    for kept, want in ((["a"], [5]), (["b"], [6]), (["b", "a"], [7]), ([], [8])):
        one = cube.stored_set(spark, str(tmp_path / "c"), ["a", "b"], kept)
        assert [r.value for r in one.collect()] == want and "PartitionFilters: [isnotnull(kept" in one._jdf.queryExecution().executedPlan().toString()


def test_balanced_flows(spark):
    seed = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 2.0), ("b", "x", 3.0), ("b", "y", 1.0), ("b", "z", 5.0), ("c", "q", 1.0)], "origin_id string, destination_id string, flow_value double")
    out = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "origin_id string, total double")
    into = spark.createDataFrame([("x", 12.0), ("y", 11.0), ("z", 7.0)], "destination_id string, total double")
    made = flows.balanced(seed, out, into).collect()
    sums = lambda k: {i: sum(r.flow_value for r in made if r[k] == i) for i in {r[k] for r in made}}
    assert sums("origin_id") == pytest.approx({"a": 10.0, "b": 20.0}) and sums("destination_id") == pytest.approx({"x": 12.0, "y": 11.0, "z": 7.0})
    with pytest.raises(ValueError, match="origins sum"):
        flows.balanced(seed, out, into.where("total > 7"))
    with pytest.raises(ValueError, match="not met"):
        flows.balanced(seed.where("destination_id <> 'y' or origin_id <> 'b'").where("origin_id <> 'a' or destination_id <> 'x'"), out, into, most_rounds=3)


def test_jdbc(spark, tmp_path):
    """The database that comes with Spark's own libraries: its side filters and sums."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, 2012, 5), (1, 2012, 7), (2, 2012, 1), (2, 2017, 9)], "gem int, jaar int, n int")
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="cube", **driver).save()
    got = layers.scan_jdbc(spark, url, 'select "gem", sum("n") as total from cube where "jaar" = 2012 group by "gem"', **driver)
    assert sorted(map(tuple, got.collect())) == [(1, 12), (2, 1)]
    parts = layers.scan_jdbc(spark, url, 'select "gem", sum("n") as total from cube group by "gem"', by=('"gem"', 1, 3, 2), **driver)
    assert parts.rdd.getNumPartitions() == 2 and sorted(map(tuple, parts.collect())) == [(1, 12), (2, 10)]


def test_feature_collection(spark, tmp_path):
    corners = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 0.0]]
    made = [{"type": "Feature", "id": c, "properties": {"name": n}, "geometry": {"type": "Polygon", "coordinates": [corners]}} for c, n in (("a", "A"), ("b", None))]
    made.append({"type": "Feature", "id": "p", "properties": {}, "geometry": {"type": "Point", "coordinates": [1, 2]}})
    (tmp_path / "c.json").write_text(json.dumps({"type": "FeatureCollection", "features": made}, indent=1))
    rows = layers.read_collection(spark, str(tmp_path / "c.json"), "name string")
    of = lambda parts: parts and [[[list(p) for p in r] for r in x] for x in parts]
    assert sorted((r.id, r.name, r.geometry_type, of(r.parts)) for r in rows.collect()) == [("a", "A", "Polygon", [[corners]]), ("b", None, "Polygon", [[corners]]), ("p", None, "Point", None)]


def test_formulas_and_registry(spark):
    rows = spark.createDataFrame([(6, 3, 0), (1, 0, 2)], "a int, b int, c int")
    of = lambda f: [r.x for r in maps.computed(rows, "x", f, ["a", "b", "c"]).collect()]
    assert of("a / b + c") == [2.0, None] and of("2 * (a - b) / (b - c)") == [2.0, -1.0] and of("a / (b / (c + 1))") == [2.0, None] and of("a / 4") == [1.5, 0.25]
    registry = spark.createDataFrame([("x", ["buurt", "wijk"]), ("y", ["pc4"])], "key string, available_at array<string>")
    assert [r.key for r in maps.available(registry, "wijk").collect()] == ["x"]
    layer = spark.createDataFrame([("A", [[ring(SQUARE)]])], f"code string, parts {geo.PARTS}")
    with pytest.raises(ValueError, match="2 codes not found, the first 1 of them: X"):
        clean.require_codes(layer, "code", spark.createDataFrame([("A",), ("Y",), ("X",)], "w string"), strict=True, shown=1)
    with pytest.raises(ValueError, match="1 codes not found: Z"):
        scales.build_boundary(layer, "code", ["A", "Z"])
    assert scales.build_boundary(layer, "code", ["A"]).select(geo.area(F.col("parts"))).first()[0] == 16.0
    shared = maps.two_layers((rows, "a", "b"), (rows, "a", "c"), shared=True)
    assert {(r.layer, r.variable) for r in shared.collect()} == {("inner", "b"), ("outer", "b")}


def test_breaks_of_a_null_group(spark):
    rows = spark.range(60).select(F.expr("case when id % 3 > 0 then id % 3 end").alias("g"), F.col("id").cast("double").alias("v"))
    got = {r.g: r.breaks for r in breaks.group_breaks(rows, ["g"], "v").collect()}
    assert got[None] == [15.0, 30.0, 45.0] and set(map(len, got.values())) == {3}
    assert {r.g for r in breaks.group_quantiles(rows, ["g"], "v", [0.5]).collect()} == {None, 1, 2}


def test_equal_areas_are_located_once(spark, monkeypatch):
    """2,500 areas of one shape and one of another, keys given twice and a null key: all pairs, but two shapes in tiles."""
    of = lambda n, parts: spark.range(n).select(F.when(F.col("id") != 7, F.col("id")).alias("k")).crossJoin(shape(spark, *parts))
    area = of(2500, [[SQUARE]]).union(of(10, [[SQUARE]])).union(of(1, [[move(SQUARE, 1, 1)]]))
    points = spark.createDataFrame([("in", 0.5, 0.5), ("also", 0.5, 0.5), ("both", 1.5, 1.5), ("on", 0.0, 0.5), ("out", 9.0, 9.0), ("null", None, 0.5)], "id string, x double, y double")
    held, tiles = [], spatial.area_tiles
    monkeypatch.setattr(spatial, "area_tiles", lambda areas, *more: held.append(areas.count()) or tiles(areas, *more))
    got = spatial.points_in_areas(points, area, "k", 0.75).select("id", "k").collect()
    assert held == [2]
    keys = [None if n == 7 else n for n in range(2500)]
    assert sorted(map(repr, got)) == sorted(repr(type(got[0])(id=i, k=k)) for i, ks in (("in", keys), ("also", keys), ("both", keys + [0])) for k in ks)


def test_equal_shapes_are_compared_once(spark, monkeypatch):
    """300 shapes of three kinds and 200 boxes of two: what is compared is five shapes; all rows of a key that touches stay."""
    kinds = [[[SQUARE]], [[move(SQUARE, 20, 0)]], [[move(SQUARE, 5, 5)]]]
    layer = shape(spark, *kinds[0], n=0).union(shape(spark, *kinds[1], n=1)).union(shape(spark, *kinds[2], n=2)).crossJoin(spark.range(100).toDF("m")).withColumn("k", F.col("m") * 3 + F.col("n"))
    layer = layer.union(shape(spark, *kinds[1], n=0, m=0, k=0).select(layer.columns))
    clip = shape(spark, [move(SQUARE, 9, 9)]).union(shape(spark, [move(HOLE, 0, 0)])).crossJoin(spark.range(100)).select("parts")
    held, stage = [], spatial.staged
    monkeypatch.setattr(spatial, "staged", lambda df: (made := stage(df), held.append(made.count()))[0])
    got = spatial.touching(layer, clip, "k", 3.0)
    assert sorted((r.k, r.n) for r in got.select("k", "n").collect()) == sorted([(0, 0), (0, 0)] + [(3 * m, 0) for m in range(1, 100)] + [(3 * m + 2, 2) for m in range(100)])
    assert held == [3, 2]


def test_keys_come_in_blocks(spark):
    held = shape(spark, [SQUARE]).select(spatial.shape_id(F.col("parts")).alias("_class")).crossJoin(spark.range(5000).toDF("_key"))
    blocks, sizes = spatial.key_blocks(held, 100)
    assert sizes.first()._blocks == 50
    got = blocks.groupBy("_salt").agg(F.count("*").alias("n"), F.sum(F.size("_keys")).alias("keys"), F.max(F.size("_keys")).alias("most")).collect()
    assert len(got) == spatial.SALTS and all((r.n, r.keys) == (50, 5000) and r.most < 200 for r in got)


def rows_by_task(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]


def test_shapes_of_one_task_are_cut_by_all(spark):
    rows = shape(spark, [SQUARE]).crossJoin(spark.range(4000)).coalesce(1)
    for made in (spatial.clip_to_box(rows, 1.0, 1.0, 9.0, 9.0), spatial.simplify(rows, 0.5)):
        n = rows_by_task(made.select("id"))
        assert len(n) == 4 and max(n) <= 1200 and sum(n) == 4000


def test_clip_leaves_lines_that_no_side_reaches(spark):
    """Against the inclusion of points: boxes that leave one to four of their lines outside, and that only touch."""
    shapes = [[[L_SHAPE]], [[SQUARE, HOLE]], [[[(0, 0), (4, 0), (4, 4), (3, 4), (3, 2), (1, 2), (1, 4), (0, 4), (0, 0)]]]]
    boxes = [(a, b, c, e) for a in (-9, 0, 0.5, 3.5) for b in (-9, 0, 2.5) for c in (2, 4, 9) for e in (3, 4, 9) if a < c] + [(4, 0, 9, 9), (-9, -9, 0, 9), (0, 4, 4, 9), (-9, -9, 9, 0)]
    for parts in shapes:
        rings_ = [np.array(r, float) for r in parts[0]]
        spots = np.array([(x / 8 + 1 / 16, y / 8 + 1 / 16) for x in range(32) for y in range(32)])
        held = spatial._inside(np.concatenate([r[:-1] for r in rings_]), np.concatenate([r[1:] for r in rings_]), spots)
        for box in boxes:
            made = spatial._clipped(rings_, *map(float, box))
            area = sum(abs(spatial._signed(r)) * (1 if n == 0 else -1) for p in made for n, r in enumerate(p))
            low, high = np.array(box[:2]), np.array(box[2:])
            assert area == pytest.approx((held & (spots > low).all(1) & (spots < high).all(1)).sum() / 64), (parts, box)


def test_shapes_of_the_stand_in_are_dealt_out(spark, small_dir):
    n = rows_by_task(stand_ins.shapes(spark, small_dir).select("shape_key"))
    assert len(n) == 4 and max(n) <= sum(n) / 3


def test_numbers_of_wkt(spark):
    values = [0.0, -0.0, 1.0, -5.0, 120000.0, 1e14, 1e15, 2.0**63, 1e300, 0.5, -0.25, 1e-7, 100.1234564, 0.1234565, 60000.00000049, float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    plain_ = F.regexp_replace(F.format_string("%.6f", "v"), r"\.?0+$", "")
    assert [r for r in df.select(geo.number_text(F.col("v")), plain_).collect() if r[0] != r[1]] == []
    of = lambda t: spark.createDataFrame([(t,)], "t string").select(geo.from_wkt(F.col("t")).alias("parts")).first().parts
    assert of("POLYGON Z (( 1\t 2  7 , 3  4 7,x 6 7, 1 2 7 ) )") == [[[(1.0, 2.0), (3.0, 4.0), (None, 6.0), (1.0, 2.0)]]]


def test_balanced_flows_read_their_tables_once(spark, small_dir, monkeypatch):
    n, table = spark.sparkContext.accumulator(0), queries.stand_in

    def seen(batches):
        for b in batches:
            n.add(b.num_rows)
            yield b

    counted = lambda spark, d, name: (df := table(spark, d, name)).mapInArrow(seen, df.schema) if name == "fx_flows" else table(spark, d, name)
    monkeypatch.setattr(queries, "stand_in", counted)
    queries.flows_balanced(spark, small_dir).collect()
    assert n.value == table(spark, small_dir, "fx_flows").count()
