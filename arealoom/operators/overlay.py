"""Overlay of sides on tiles: which side of what a point lies, cuts where sides meet, and unions of shapes that overlap.

A side is a struct (a, b) of points. Sides are dealt to the tiles that they meet. The winding number of the left end of
a tile's middle line is the sum of the crossings to its left; from there a point of the tile is reached by two legs,
along the middle line and then upright, that only meet sides of this tile. So no task holds more than one tile's sides.

The legs run at (x + e, middle + e') with e' much smaller than e, both smaller than any distance: vertices and sides that
lie on them fall to one side by the same rule (`left_of`) for both legs, and no case needs heights without vertices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged


def side_tiles(e: Column, tile: Column | float, slack: Column | float = 0.0) -> Column:
    """The tiles (i, j) that a side (a, b) meets, column by column: about as many as it is tiles long."""
    a, b = e["a"], e["b"]
    low, high = F.least(a["x"], b["x"]) - slack, F.greatest(a["x"], b["x"]) + slack
    steep = F.try_divide(b["y"] - a["y"], b["x"] - a["x"])

    def column(i):
        left, right = F.greatest(i * tile, low), F.least((i + 1) * tile, high)
        at = lambda x: F.greatest(F.least(a["y"] + (x - a["x"]) * steep, F.greatest(a["y"], b["y"])), F.least(a["y"], b["y"]))
        one, two = F.when(steep.isNull(), a["y"]).otherwise(at(left)), F.when(steep.isNull(), b["y"]).otherwise(at(right))
        span = F.sequence(F.floor((F.least(one, two) - slack - tile * 1e-9) / tile), F.floor((F.greatest(one, two) + slack + tile * 1e-9) / tile))
        return F.transform(span, lambda j: F.struct(i.alias("i"), j.alias("j")))

    return F.flatten(F.transform(F.sequence(F.floor(low / tile), F.floor(high / tile)), column))


def turn(e: Column, x: Column, y: Column) -> Column:
    """Positive where the point lies to the left of the side."""
    return (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (x - e["a"]["x"])


def left_of(e: Column, x: Column, y: Column) -> Column:
    """Whether the point, moved a little to the right and far less up, lies to the left of the side's line."""
    t, up, along = turn(e, x, y), e["b"]["y"] - e["a"]["y"], e["b"]["x"] - e["a"]["x"]
    return (t > 0) | ((t == 0) & ((up < 0) | ((up == 0) & (along > 0))))


def middle(j: Column, tile: Column | float) -> Column:
    return (j + 0.5) * tile


def rises(e: Column, y: Column) -> Column:
    """1 where a side crosses the line at y upward, -1 downward, else 0."""
    return F.when(e["b"]["y"] > y, 1).otherwise(0) - F.when(e["a"]["y"] > y, 1).otherwise(0)


def crossing_column(e: Column, y: Column, tile: Column | float) -> Column:
    """The column of tiles where a side crosses the line at y (null where it is level)."""
    return F.floor((e["a"]["x"] + F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"])) / tile)


def passed(e: Column, i: Column, j: Column, tile: Column | float) -> Column:
    """What the winding number gains from the left end of a tile's middle line to its right end by this side."""
    up = rises(e, middle(j, tile))
    return F.when((up != 0) & (crossing_column(e, middle(j, tile), tile) == i), -up).otherwise(0)


def gained(e: Column, x: Column, y: Column, i: Column, j: Column, tile: Column | float, upright: Column | bool = True, apart: bool = False) -> Column:
    """What the winding number gains from the left end of the tile's middle line to the point by this side; without
    `upright` only by the leg along the middle line. apart: the number of crossings instead, whatever their way."""
    line = middle(j, tile)
    up, near = rises(e, line), left_of(e, x, line).cast("int")
    along = F.when((up != 0) & (crossing_column(e, line, tile) == i), near - F.when(up > 0, 1).otherwise(0)).otherwise(0)
    spans = (e["a"]["x"] > x) != (e["b"]["x"] > x)
    upward = F.when(spans & F.lit(upright), (turn(e, x, y) > 0).cast("int") - near).otherwise(0)
    return F.abs(along) + F.abs(upward) if apart else along + upward


def border_sides(sides: DataFrame) -> DataFrame:
    """(_group, low, high, way): how much oftener a side occurs from low to high than back; equal numbers cancel."""
    a, b = F.col("e.a"), F.col("e.b")
    keyed = sides.select("_group", F.least(a, b).alias("low"), F.greatest(a, b).alias("high"), (F.when(a < b, 1).otherwise(-1) * F.col("way")).alias("way"))
    return keyed.groupBy("_group", "low", "high").agg(F.sum("way").alias("way")).where("way <> 0")


def directed(sides: DataFrame) -> DataFrame:
    return sides.select("_group", F.struct(F.col("low").alias("a"), F.col("high").alias("b")).alias("e"), "way")


def cuts_between(e: Column, f: Column, snap: int) -> Column:
    """The points inside e where f meets it: f's ends that lie on e, and the crossing, all on the grid of 10^-snap."""
    slack = 10.0**-snap
    dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
    fx, fy = f["b"]["x"] - f["a"]["x"], f["b"]["y"] - f["a"]["y"]
    long = dx * dx + dy * dy

    def on(p):
        px, py = p["x"] - e["a"]["x"], p["y"] - e["a"]["y"]
        along = px * dx + py * dy
        return F.when((F.abs(px * dy - py * dx) <= slack * F.sqrt(long)) & (along > 0) & (along < long), p)

    wide = dx * fy - dy * fx
    ox, oy = f["a"]["x"] - e["a"]["x"], f["a"]["y"] - e["a"]["y"]
    t, u = F.try_divide(ox * fy - oy * fx, wide), F.try_divide(ox * dy - oy * dx, wide)
    at = F.struct(F.bround(e["a"]["x"] + t * dx, snap).alias("x"), F.bround(e["a"]["y"] + t * dy, snap).alias("y"))
    found = F.array(on(f["a"]), on(f["b"]), F.when((t > 0) & (t < 1) & (u > 0) & (u < 1), at))
    return F.filter(found, lambda p: p.isNotNull() & (p != e["a"]) & (p != e["b"]))


def mean_tile(sides: DataFrame) -> float | None:
    """Twice the mean extent of the sides (low, high); None without any."""
    mean = sides.agg(F.avg(F.greatest(F.abs(F.col("high.x") - F.col("low.x")), F.abs(F.col("high.y") - F.col("low.y"))))).first()[0]
    return 2.0 * mean if mean else None


def cut_places(sides: DataFrame, tile: float, snap: int) -> DataFrame:
    """(_of, _e, cuts): the sides (_group, low, high, way) that others of their group meet inside, and where."""
    rows, slack = directed(sides), 10.0**-snap
    dealt = rows.select("_group", "e", F.explode(side_tiles(F.col("e"), tile, slack)).alias("t")).select("_group", "e", "t.i", "t.j")
    e, f = F.col("e"), F.col("f")
    low, high = (lambda s, c: F.least(s["a"][c], s["b"][c])), (lambda s, c: F.greatest(s["a"][c], s["b"][c]))
    close = (e != f) & (low(e, "x") <= high(f, "x") + slack) & (low(f, "x") <= high(e, "x") + slack) & (low(e, "y") <= high(f, "y") + slack) & (low(f, "y") <= high(e, "y") + slack)
    others = dealt.select(F.col("_group").alias("_of"), F.col("e").alias("f"), F.col("i").alias("_i"), F.col("j").alias("_j"))
    met = dealt.join(others, F.col("_group").eqNullSafe(F.col("_of")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & close)
    found = met.select("_group", "e", F.explode(cuts_between(e, f, snap)).alias("p")).groupBy("_group", "e").agg(F.collect_set("p").alias("cuts"))
    return found.select(F.col("_group").alias("_of"), F.col("e").alias("_e"), "cuts")


def noded(sides: DataFrame, tile: float, snap: int, most_rounds: int = 12) -> DataFrame:
    """Sides (_group, low, high, way) cut wherever another side of their group meets them. Cuts are rounded to the grid,
    which can bend a side across a third one, so rounds go on until none is cut."""
    e = F.col("e")
    for _ in range(most_rounds):
        rows, found = directed(sides), staged(cut_places(sides, tile, snap))
        if found.isEmpty():
            return sides
        joined = rows.join(found, F.col("_group").eqNullSafe(F.col("_of")) & (e == F.col("_e")), "left")
        along = lambda p: (p["x"] - e["a"]["x"]) * (e["b"]["x"] - e["a"]["x"]) + (p["y"] - e["a"]["y"]) * (e["b"]["y"] - e["a"]["y"])
        inner = F.transform(F.array_sort(F.transform("cuts", lambda p: F.struct(along(p).alias("at"), p.alias("p")))), lambda c: c["p"])
        stops = F.concat(F.array("e.a"), F.coalesce(inner, F.array().cast("array<struct<x:double,y:double>>")), F.array("e.b"))
        pieces = F.zip_with(F.slice(stops, 1, F.size(stops) - 1), F.slice(stops, 2, F.size(stops) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        sides = staged(border_sides(joined.select("_group", F.explode(pieces).alias("e"), "way")))
    raise ValueError(f"sides still cut each other after {most_rounds} rounds: choose a coarser grid")


def windings(sides: DataFrame, tile: float) -> DataFrame:
    """Noded sides with `left` and `right`: how many times the group's rings wind around either side of each."""
    rows = directed(sides)
    i, j, e = F.col("i"), F.col("j"), F.col("e")
    dealt = rows.select("_group", "e", "way", F.explode(side_tiles(e, tile, tile * 1e-9)).alias("t")).select("_group", "e", "way", "t.i", "t.j")
    ends = Window.partitionBy("_group", "j").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    tiles = dealt.groupBy("_group", "i", "j").agg(F.sum(passed(e, i, j, tile) * F.col("way")).alias("own"))
    tiles = tiles.select(F.col("_group").alias("_of"), F.col("i").alias("_i"), F.col("j").alias("_j"), F.coalesce(F.sum("own").over(ends), F.lit(0)).alias("start"))
    x, y = (e["a"]["x"] + e["b"]["x"]) / 2, (e["a"]["y"] + e["b"]["y"]) / 2
    spots = rows.select(F.col("_group").alias("_of"), e.alias("own"), F.col("way").alias("own_way"), x.alias("x"), y.alias("y"))
    spots = spots.withColumns({"_i": F.floor(F.col("x") / tile), "_j": F.floor(F.col("y") / tile)})
    met = dealt.join(spots, F.col("_group").eqNullSafe(F.col("_of")) & (i == F.col("_i")) & (j == F.col("_j")))
    gain = gained(e, F.col("x"), F.col("y"), i, j, tile, e != F.col("own")) * F.col("way")
    sums = met.groupBy("_group", "own", "own_way", "i", "j", "x").agg(F.sum(gain).alias("gain"))
    joined = sums.join(tiles, F.col("_group").eqNullSafe(F.col("_of")) & (i == F.col("_i")) & (j == F.col("_j")))
    # the upright leg ends on the side from where it comes
    near, there = left_of(F.col("own"), F.col("x"), middle(j, tile)), F.col("start") + F.col("gain")
    left = F.when(near, there).otherwise(there + F.col("own_way"))
    return joined.select("_group", F.col("own.a").alias("low"), F.col("own.b").alias("high"), left.alias("left"), (left - F.col("own_way")).alias("right"))


def union_border(sides: DataFrame, snap: int) -> DataFrame:
    """(_group, ax, ay, bx, by): the border of what each group's shapes cover, the covered side to the left. sides are
    (_group, e, way) of rings whose inner side is to the left."""
    cancelled = staged(border_sides(sides))
    tile = mean_tile(cancelled)
    if tile is None:
        return cancelled.select("_group", *[F.lit(0.0).alias(c) for c in ("ax", "ay", "bx", "by")]).where("false")
    around = windings(noded(cancelled, tile, snap), tile)
    border = around.where("(left > 0) <> (right > 0)")
    a, b = (F.when(F.col("left") > 0, F.col(p)).otherwise(F.col(q)) for p, q in (("low", "high"), ("high", "low")))
    ends = border.select("_group", a.alias("a"), b.alias("b"))
    return ends.select("_group", F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"))
