"""Simplification that keeps neighbours together: borders are cut into arcs where three or more sides meet, both
neighbours use the same arc, and an arc is simplified once."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import POINT, edges, is_on, meet
from ..sources.scratch import staged
from .overlay import cut_places, mean_tile, side_tiles
from .spatial import _thinned

#: Rounds in which arcs that run into another one are simplified by half as much as before; after that they stay as they were.
ROUNDS = 6
RING = ["_row", "part", "ring"]
ARC = f"_row long, part int, ring int, place int, arc binary, turned boolean, points array<{POINT}>"


def simplify_shared(layer: DataFrame, tolerance: float, snap: int = 6) -> DataFrame:
    """layer with its `parts` simplified by Douglas-Peucker along arcs, so that shapes that share a border still do.

    A vertex of one shape on a side of another becomes a vertex of both first (within 10^-snap). Arcs of which a side
    would meet another one elsewhere than at a common end are simplified by half the tolerance, and so on, until none
    does. An arc can still pass over a shape that is smaller than the tolerance. Null shapes and shapes without parts
    stay as they are; a ring is an array in one row, as in the input.
    """
    rows = staged(layer.withColumn("_row", F.monotonically_increasing_id()))
    ring = rows.select("_row", F.posexplode("parts").alias("part", "_p")).select("_row", "part", F.posexplode("_p").alias("ring", "points"))
    ring = with_shared_vertices(staged(ring.where(F.size("points") >= 4)), snap)
    uses = staged(arcs(ring))
    once = uses.groupBy("arc").agg(F.first("points").alias("points")).withColumn("level", F.lit(0))
    for _ in range(ROUNDS + 2):
        made = staged(thinned(once, tolerance))
        bad = staged(conflicts(made))
        if bad.isEmpty():
            break
        again = bad.withColumn("_bad", F.lit(1))
        once = once.join(again, "arc", "left").select("arc", "points", (F.col("level") + F.coalesce("_bad", F.lit(0))).alias("level"))
    back = uses.drop("points").join(made.select("arc", "thin"), "arc")
    way = F.when(F.col("turned"), F.reverse("thin")).otherwise(F.col("thin"))
    held = back.groupBy(*RING).agg(F.array_sort(F.collect_list(F.struct("place", way.alias("points")))).alias("own"))
    points = F.aggregate("own", F.lit(None).cast(f"array<{POINT}>"), lambda got, a: F.when(got.isNull(), a["points"]).otherwise(F.concat(got, F.slice(a["points"], F.lit(2), F.size(a["points"])))))
    gathered = lambda df, keys, at, what: df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, what))), lambda x: x[what]).alias(what))
    whole = gathered(held.select(*RING, points.alias("points")), RING[:2], "ring", "points").withColumnRenamed("points", "_rings")
    whole = gathered(whole, RING[:1], "part", "_rings").withColumnRenamed("_rings", "_made")
    return rows.join(whole, "_row", "left").select(*[F.coalesce("_made", "parts").alias(c) if c == "parts" else F.col(f"`{c}`") for c in layer.columns])


def with_shared_vertices(ring: DataFrame, snap: int) -> DataFrame:
    """Rings with the vertices of other rings that lie on their sides."""
    sides = ring.select(*RING, F.posexplode(edges(F.col("points"))).alias("place", "e")).where("e.a <> e.b")
    undirected = sides.select(F.lit(0).alias("_group"), F.least("e.a", "e.b").alias("low"), F.greatest("e.a", "e.b").alias("high")).distinct()
    undirected = staged(undirected.withColumn("way", F.lit(1)))
    if (tile := mean_tile(undirected)) is None:
        return ring
    cuts = staged(cut_places(undirected, tile, snap))
    if cuts.isEmpty():
        return ring
    known = cuts.select(F.col("_e.a").alias("_low"), F.col("_e.b").alias("_high"), "cuts")
    joined = sides.join(known, (F.least("e.a", "e.b") == F.col("_low")) & (F.greatest("e.a", "e.b") == F.col("_high")), "left")
    away = lambda p: (p["x"] - F.col("e.a.x")) * (p["x"] - F.col("e.a.x")) + (p["y"] - F.col("e.a.y")) * (p["y"] - F.col("e.a.y"))
    inner = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(away(p).alias("at"), p.alias("p")))), lambda c: c["p"])
    stops = F.concat(F.array("e.a"), F.coalesce(inner, F.array().cast(f"array<{POINT}>")))
    whole = joined.groupBy(*RING).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", stops.alias("own")))), lambda s: s["own"])).alias("points"))
    return staged(whole.withColumn("points", F.concat("points", F.slice("points", 1, 1))))


def arcs(ring: DataFrame) -> DataFrame:
    """(_row, part, ring, place, arc, turned, points): the arcs of each ring in order; points are as from the end that
    comes first by coordinates, turned where the ring runs the other way."""
    sides = ring.select(*RING, F.posexplode(edges(F.col("points"))).alias("place", "e")).where("e.a <> e.b")
    ends = sides.select(F.col("e.a").alias("p"), F.col("e.b").alias("q"))
    degree = ends.union(ends.select(F.col("q").alias("p"), F.col("p").alias("q"))).distinct().groupBy("p").agg(F.count("*").alias("n")).where("n <> 2")
    joints = sides.select(*RING, "place", F.col("e.a").alias("p")).join(degree.select("p"), "p", "left_semi").groupBy(*RING).agg(F.sort_array(F.collect_list("place")).alias("joints"))

    def of(batches):
        for b in batches:
            made = [row for r in b.to_pylist() for row in split(r)]
            yield pa.RecordBatch.from_pylist(made, shape)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    shape = to_arrow_schema(_parse_datatype_string(ARC))
    return ring.join(joints, RING, "left").mapInArrow(of, ARC)


def split(row: dict):
    """One ring's arcs: from joint to joint, or the whole ring from its smallest vertex."""
    points = [(p["x"], p["y"]) for p in row["points"][:-1]]
    starts = row["joints"] or [min(range(len(points)), key=points.__getitem__)]
    for place, (at, to) in enumerate(zip(starts, [*starts[1:], starts[0] + len(points)], strict=True)):
        own = [points[i % len(points)] for i in range(at, to + 1)]
        back = own[::-1]
        turned = back < own
        own = back if turned else own
        key = md5(np.array(own).tobytes()).digest()
        yield {"_row": row["_row"], "part": row["part"], "ring": row["ring"], "place": place, "arc": key, "turned": turned, "points": [{"x": x, "y": y} for x, y in own]}


def thinned(once: DataFrame, tolerance: float) -> DataFrame:
    """arc and `thin`: its points simplified by the tolerance of its level."""

    def of(batches):
        for b in batches:
            made = []
            for points, level in zip(b.column("points").to_pylist(), b.column("level").to_pylist(), strict=True):
                xy = np.array([(p["x"], p["y"]) for p in points])
                kept = xy if level > ROUNDS else _thinned(xy, tolerance / 2**level)
                made.append([{"x": x, "y": y} for x, y in kept.tolist()])
            yield pa.RecordBatch.from_arrays([b.column("arc"), pa.array(made, b.schema.field("points").type)], ["arc", "thin"])

    return once.select("arc", "points", "level").mapInArrow(of, f"arc binary, thin array<{POINT}>")


def conflicts(made: DataFrame) -> DataFrame:
    """(arc) of arcs with a side that meets another side elsewhere than at an end of both."""
    sides = made.select("arc", F.posexplode(edges(F.col("thin"))).alias("place", "e")).where("e.a <> e.b")
    tile = mean_tile(sides.select(F.col("e.a").alias("low"), F.col("e.b").alias("high")))
    if tile is None:
        return made.select("arc").where("false")
    dealt = sides.select("arc", "place", "e", F.explode(side_tiles(F.col("e"), tile, tile * 1e-9)).alias("t"))
    others = dealt.select(F.col("arc").alias("_arc"), F.col("place").alias("_place"), F.col("e").alias("f"), F.col("t").alias("_t"))
    e, f = F.col("e"), F.col("f")
    met = dealt.join(others, (F.col("t") == F.col("_t")) & ((F.col("arc") != F.col("_arc")) | (F.col("place") != F.col("_place"))))
    return met.where(clash(e, f)).select("arc").distinct()


def clash(e: Column, f: Column) -> Column:
    """Whether two sides share more than a common end."""
    one = lambda p, s: (p == s["a"]) | (p == s["b"])
    joined = one(e["a"], f) | one(e["b"], f)
    lies = lambda p, s: ~one(p, s) & is_on(s, p["x"], p["y"])
    beyond = lies(e["a"], f) | lies(e["b"], f) | lies(f["a"], e) | lies(f["b"], e) | (one(e["a"], f) & one(e["b"], f))
    return F.when(joined, beyond).otherwise(meet(e, f))
