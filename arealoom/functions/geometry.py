"""Planar geometry on `parts` columns: array<array<array<struct<x, y>>>>, the polygons of a shape, each an outer ring
and its holes. Rings are closed (the first point comes again at the end) and may turn either way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<array<{POINT}>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def polygon(*rings: Column) -> Column:
    """A shape of one part."""
    return F.array(F.array(*rings))


def rectangle(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return polygon(F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1), point(x0, y0)))


def rings(parts: Column) -> Column:
    return F.flatten(parts)


def edges(ring: Column) -> Column:
    """(a, b) of each side."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def all_edges(parts: Column) -> Column:
    return F.flatten(F.transform(rings(parts), edges))


def _sum(values: Column, term) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + term(e["a"], e["b"]))


def signed_area(ring: Column) -> Column:
    """Positive where the ring turns left; from its first vertex, so that large offsets lose no digits."""
    o = ring[0]
    return _sum(edges(ring), lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])) / 2


def oriented(parts: Column) -> Column:
    """Outer rings turn left and holes right."""
    turned = lambda r, i: F.when((signed_area(r) >= 0) == (i == 0), r).otherwise(F.reverse(r))
    return F.transform(parts, lambda p: F.transform(p, turned))


def area(parts: Column) -> Column:
    """Outer rings less holes."""
    own = lambda p: F.aggregate(F.transform(p, lambda r, i: F.abs(signed_area(r)) * F.when(i == 0, 1.0).otherwise(-1.0)), F.lit(0.0), lambda a, v: a + v)
    return F.aggregate(F.transform(parts, own), F.lit(0.0), lambda a, v: a + v)


def centroid(parts: Column) -> Column:
    """Area-weighted over all parts; coordinates are taken from the first vertex, so that large offsets lose no digits."""
    o = parts[0][0][0]
    cross = lambda a, b: (a["x"] - o["x"]) * (b["y"] - o["y"]) - (b["x"] - o["x"]) * (a["y"] - o["y"])
    e = all_edges(oriented(parts))
    twice = _sum(e, cross)
    mean = lambda c: o[c] + F.try_divide(_sum(e, lambda a, b: (a[c] + b[c] - 2 * o[c]) * cross(a, b)), 3 * twice)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def points(parts: Column) -> Column:
    return F.flatten(rings(parts))


def bounds(parts: Column) -> Column:
    xs, ys = F.transform(points(parts), lambda p: p["x"]), F.transform(points(parts), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def is_on(e: Column, x: Column, y: Column) -> Column:
    """Whether a side holds the point."""
    a, b = e["a"], e["b"]
    straight = (b["x"] - a["x"]) * (y - a["y"]) == (b["y"] - a["y"]) * (x - a["x"])
    return straight & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


def is_right_of(e: Column, x: Column, y: Column) -> Column:
    """Whether the ray from the point to the right crosses a side."""
    a, b = e["a"], e["b"]
    at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
    return F.coalesce(((a["y"] > y) != (b["y"] > y)) & (x < at), F.lit(False))


def inside(sides: Column, x: Column, y: Column) -> Column:
    """Strictly inside, from sides (a, b) that include all at the height of the point: an odd number of them to the
    right, and none that holds the point."""
    odd = F.size(F.filter(sides, lambda e: is_right_of(e, x, y))) % 2 == 1
    return F.when(F.exists(sides, lambda e: is_on(e, x, y)), F.lit(False)).otherwise(odd)


def within(parts: Column, x: Column, y: Column) -> Column:
    return inside(all_edges(parts), x, y)


def meet(e: Column, f: Column) -> Column:
    """Whether two sides share a point."""
    turn = lambda p, q, r: (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])
    overlap = lambda c: (F.greatest(e["a"][c], e["b"][c]) >= F.least(f["a"][c], f["b"][c])) & (F.greatest(f["a"][c], f["b"][c]) >= F.least(e["a"][c], e["b"][c]))
    across = lambda g, h: F.signum(turn(g["a"], g["b"], h["a"])) * F.signum(turn(g["a"], g["b"], h["b"])) <= 0
    return overlap("x") & overlap("y") & across(e, f) & across(f, e)


def intersects(one: Column, two: Column) -> Column:
    """Shapes that share any point: bounds first, then a side that meets a side, or a ring of one inside the other."""
    a, b = bounds(one), bounds(two)
    apart = (a["xmax"] < b["xmin"]) | (b["xmax"] < a["xmin"]) | (a["ymax"] < b["ymin"]) | (b["ymax"] < a["ymin"])
    crossing = F.exists(all_edges(one), lambda e: F.exists(all_edges(two), lambda f: meet(e, f)))
    holds = lambda outer, inner: F.exists(rings(inner), lambda r: within(outer, r[0]["x"], r[0]["y"]))
    return F.when(apart, F.lit(False)).otherwise(crossing | holds(two, one) | holds(one, two))


def number_text(value: Column) -> Column:
    """Up to six decimals, without trailing zeros. Whole numbers are told apart: formatting costs some 20 times as much."""
    whole = value.try_cast("long")
    return F.when((whole.cast("double") == value) & (F.abs(value) < 1e15) & (value != 0), whole.cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", value), r"\.?0+$", ""))


def to_wkt(parts: Column) -> Column:
    """POLYGON for one part, MULTIPOLYGON for more."""
    ring = lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", number_text(p["x"]), number_text(p["y"]))), ", "), F.lit(")"))
    bodies = F.transform(parts, lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, ring), ", "), F.lit(")")))
    return F.when(F.size(parts) == 1, F.concat(F.lit("POLYGON "), bodies[0])).otherwise(F.concat(F.lit("MULTIPOLYGON ("), F.array_join(bodies, ", "), F.lit(")")))


def from_wkt(text: Column) -> Column:
    """Parts of a POLYGON or MULTIPOLYGON text; numbers that cannot be read are null, other texts too."""
    body = F.regexp_extract(text, r"(?i)^\s*(?:MULTI)?POLYGON\s*(?:Z\s*)?(\(.*\))\s*$", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(body, r"\s*([(),])\s*", "$1"), r"\s+", " "), r"^\(+|\)+$", "")
    # one space between numbers, so that a point is split once and by no pattern
    read = lambda xy: point(F.get(xy, F.lit(0)).try_cast("double"), F.get(xy, F.lit(1)).try_cast("double"))
    part = lambda p: F.transform(F.split(p, r"\),\("), lambda r: F.transform(F.transform(F.split(r, ","), lambda v: F.split(v, " ")), read))
    return F.when(bare != "", F.transform(F.split(bare, r"\)\),\(\("), part))


#: Coefficients (power of the first, of the second, factor) of the published approximation between the
#: Dutch national grid and WGS84 (Schreutelkamp and Strang van Hees, 2001).
BASE_X, BASE_Y, BASE_LAT, BASE_LON = 155000.0, 463000.0, 52.15517440, 5.38720621
LAT = [(0, 1, 3235.65389), (2, 0, -32.58297), (0, 2, -0.2475), (2, 1, -0.84978), (0, 3, -0.0655), (2, 2, -0.01709), (1, 0, -0.00738), (4, 0, 0.0053), (2, 3, -0.00039), (4, 1, 0.00033), (1, 1, -0.00012)]
LON = [(1, 0, 5260.52916), (1, 1, 105.94684), (1, 2, 2.45656), (3, 0, -0.81885), (1, 3, 0.05594), (3, 1, -0.05607), (0, 1, 0.01199), (3, 2, -0.00256), (1, 4, 0.00128), (0, 2, 0.00022), (2, 0, -0.00022), (5, 0, 0.00026)]
X = [(0, 1, 190094.945), (1, 1, -11832.228), (2, 1, -114.221), (0, 3, -32.391), (1, 0, -0.705), (3, 1, -2.340), (1, 3, -0.608), (0, 2, -0.008), (2, 3, 0.148)]
Y = [(1, 0, 309056.544), (0, 2, 3638.893), (2, 0, 73.077), (1, 2, -157.984), (3, 0, 59.788), (0, 1, 0.433), (2, 2, -6.439), (1, 1, -0.032), (0, 4, 0.092), (1, 4, -0.054)]


def _power(c: Column, n: int) -> Column | None:
    out = None
    for _ in range(n):
        out = c if out is None else out * c
    return out


def _poly(terms, p: Column, q: Column) -> Column:
    total = F.lit(0.0)
    for i, j, k in terms:
        term = F.lit(k)
        for f in (_power(p, i), _power(q, j)):
            term = term if f is None else term * f
        total = total + term
    return total


def rd_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """(lng, lat)."""
    a, b = (x - BASE_X) * 1e-5, (y - BASE_Y) * 1e-5
    return BASE_LON + _poly(LON, a, b) / 3600, BASE_LAT + _poly(LAT, a, b) / 3600


def wgs84_to_rd(lng: Column, lat: Column) -> tuple[Column, Column]:
    f, g = (lat - BASE_LAT) * 0.36, (lng - BASE_LON) * 0.36
    return BASE_X + _poly(X, f, g), BASE_Y + _poly(Y, f, g)


def reproject(parts: Column) -> Column:
    return F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda v: point(*rd_to_wgs84(v["x"], v["y"])))))
