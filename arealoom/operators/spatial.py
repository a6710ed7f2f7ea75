"""Spatial joins and shapes of whole layers. Layers hold their shapes in a column `parts` (see functions.geometry)."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.geometry import PARTS, all_edges, bounds, is_on, meet, oriented, rings
from ..sources.scratch import spread, staged
from .overlay import gained, passed, side_tiles, union_border


def bbox(df: DataFrame, parts: str = "parts") -> Row:
    """xmin, ymin, xmax, ymax of a layer: one row."""
    b = bounds(F.col(parts))
    return df.agg(F.min(b["xmin"]).alias("xmin"), F.min(b["ymin"]).alias("ymin"), F.max(b["xmax"]).alias("xmax"), F.max(b["ymax"]).alias("ymax")).first()


def in_bbox(df: DataFrame, box: Row, buffer: float = 0.0, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(box.xmin - buffer, box.xmax + buffer) & F.col(y).between(box.ymin - buffer, box.ymax + buffer))


def shape_id(parts: Column) -> Column:
    """128 bits of a shape's points: equal shapes have one id."""
    return F.struct(F.xxhash64(parts).alias("a"), F.xxhash64(F.lit(1), parts).alias("b"))


def area_tiles(areas: DataFrame, key: str, tile: float, parts: str = "parts") -> DataFrame:
    """(key, _i, _j, _odd, _sides): the tiles that an area touches or covers. _odd: whether the left end of the tile's
    middle line lies inside; _sides: the sides that meet the tile, null where none does and the tile is inside as a
    whole. A side is held once for each tile that it meets, so what is held grows with the sides' length.
    """
    shapes = areas.select(F.col(key), F.xxhash64(parts).alias("_shape"), F.col(parts).alias("_parts")).distinct()
    i, j, e = F.col("_i"), F.col("_j"), F.col("_e")
    dealt = shapes.select(key, "_shape", F.explode(all_edges(F.col("_parts"))).alias("_e")).withColumn("_t", F.explode(side_tiles(e, tile, tile * 1e-9)))
    tiles = dealt.select(key, "_shape", "_e", F.col("_t.i").alias("_i"), F.col("_t.j").alias("_j")).groupBy(key, "_shape", "_i", "_j")
    tiles = tiles.agg(F.collect_list("_e").alias("_sides"), F.sum(F.abs(passed(e, i, j, tile))).alias("_own"))
    row = Window.partitionBy(key, "_shape", "_j").orderBy("_i")
    tiles = tiles.withColumns({"_sum": F.sum("_own").over(row), "_next": F.coalesce(F.lead("_i").over(row), i + 1)})
    whole = F.when(F.col("_sum") % 2 == 1, F.filter(F.sequence(i + 1, F.greatest(F.col("_next") - 1, i + 1)), lambda n: n < F.col("_next")))
    sides = tiles.schema["_sides"].dataType
    own = F.struct(i.alias("_i"), ((F.col("_sum") - F.col("_own")) % 2 == 1).alias("_odd"), F.col("_sides"))
    between = F.transform(F.coalesce(whole, F.array().cast("array<long>")), lambda n: F.struct(n.alias("_i"), F.lit(True).alias("_odd"), F.lit(None).cast(sides).alias("_sides")))
    return tiles.select(key, "_j", F.explode(F.concat(F.array(own), between)).alias("_t")).select(key, "_t._i", "_j", "_t._odd", "_t._sides")


#: Tasks that share the points of one block of keys.
SALTS = 8


def key_blocks(held: DataFrame, most: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Keys (_class, _key) as (_class, _block, _salt, _keys), some `most` different keys in a block at most and each
    block once for each salt; and (_class, _blocks, _one): the number of blocks, and the key of a class of one key, which
    has no block."""
    held = held.distinct()
    sizes = held.groupBy("_class").agg(F.count("*").alias("n"), F.first(F.struct("_key")).alias("_one"))
    sizes = sizes.select("_class", F.ceil(F.col("n") / most).alias("_blocks"), F.when(F.col("n") == 1, F.col("_one")).alias("_one"))
    dealt = held.join(sizes.where("_one is null"), "_class").withColumn("_block", F.pmod(F.xxhash64("_key"), F.col("_blocks")))
    blocks = dealt.groupBy("_class", "_block").agg(F.collect_list(F.struct("_key")).alias("_keys"))
    return blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), sizes


def points_in_areas(points: DataFrame, areas: DataFrame, key: str, tile: float, x: str = "x", y: str = "y", parts: str = "parts") -> DataFrame:
    """Each point with the key of every area that it lies strictly within: an equi join on tiles, then the crossings of
    the tile's own sides on the way from the left end of its middle line to the point.

    Equal shapes are one until a point is found inside: only then come their keys, by blocks, so that a point meets a
    shape once however many areas have it. The pairs themselves are the result; they are made in as many tasks as
    `spread` deals out, for before that their rows are too few to tell how many they become.
    """
    shapes = areas.select(shape_id(F.col(parts)).alias("_class"), F.col(key).alias("_key"), F.col(parts).alias("_parts"))
    blocks, sizes = key_blocks(shapes.select("_class", "_key"))
    tiles = area_tiles(shapes.select("_class", "_parts").distinct(), "_class", tile, "_parts").join(sizes, "_class")
    rows = spread(points).withColumn("_i", F.floor(F.col(x) / tile)).withColumn("_j", F.floor(F.col(y) / tile))
    crossed = F.aggregate("_sides", F.lit(0), lambda n, e: n + F.abs(gained(e, F.col(x), F.col(y), F.col("_i"), F.col("_j"), tile, apart=True)))
    within = F.when(F.exists("_sides", lambda e: is_on(e, F.col(x), F.col(y))), False).otherwise((crossed + F.col("_odd").cast("int")) % 2 == 1)
    met = rows.join(tiles, ["_i", "_j"]).where(F.col("_sides").isNull() | within).drop("_i", "_j", "_odd", "_sides")
    met = met.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    # a class of one key has its key at hand and goes anywhere
    place = F.xxhash64(x, y)
    met = spread(met.withColumn("_salt", F.when(F.col("_one").isNull(), F.pmod(place, F.lit(SALTS))).otherwise(place)), "_class", "_block", "_salt")
    found = met.join(blocks, ["_class", "_block", "_salt"], "left").withColumn("_held", F.explode(F.coalesce("_keys", F.array("_one"))))
    return found.withColumn("_held", F.col("_held._key")).drop("_class", "_block", "_salt", "_one", "_keys").withColumnRenamed("_held", key)


def touching(layer: DataFrame, clip: DataFrame, key: str, tile: float) -> DataFrame:
    """Rows of layer whose key has a shape that shares a point with any shape of clip: sides that meet within a tile, or
    a ring of one that starts inside the other. Equal shapes of a layer are compared once."""
    of = lambda df, name: df.select(shape_id(F.col("parts")).alias(name), "parts")
    layer_, clip_ = staged(of(layer, "_own").distinct()), staged(of(clip, "_clip").distinct())
    dealt = lambda df, *names: df.select(*names, F.explode(all_edges(F.col("parts"))).alias("e")).select(*names, "e", F.explode(side_tiles(F.col("e"), tile)).alias("t")).select(*names, "e", "t.i", "t.j")
    sides = spread(dealt(layer_, "_own")).join(dealt(clip_).withColumnRenamed("e", "f"), ["i", "j"]).where(meet(F.col("e"), F.col("f"))).select("_own")
    starts = lambda df, name: df.select(name, F.explode(rings(F.col("parts"))).alias("r")).select(name, F.col("r")[0]["x"].alias("x"), F.col("r")[0]["y"].alias("y"))
    held = points_in_areas(starts(layer_, "_own"), clip_, "_clip", tile).select("_own")
    holding = points_in_areas(starts(clip_, "_clip"), layer_, "_own", tile).select("_own")
    keys = layer.select(F.col(key).alias("_key"), shape_id(F.col("parts")).alias("_own"))
    found = keys.join(sides.union(held).union(holding).distinct(), "_own", "left_semi").select("_key").distinct()
    return layer.join(found, F.col(key) == F.col("_key"), "left_semi")


def dissolve(layer: DataFrame, by: str, snap: int = 6) -> DataFrame:
    """(by, parts): the union of each group's polygons, which may share borders, overlap, repeat or hold each other.

    Sides that occur as often in each direction cancel; the others are cut wherever they meet, and of the pieces those
    stay that have the union on one side only (see overlay). What remains is chained into rings, one task per group, on
    the border alone. Points are snapped to 10^-snap. A null shape adds nothing; a group without a side has no row.
    """
    near = lambda p: F.struct(F.bround(p["x"], snap).alias("x"), F.bround(p["y"], snap).alias("y"))
    ends = lambda e: F.struct(near(e["a"]).alias("a"), near(e["b"]).alias("b"))
    own = F.filter(F.transform(all_edges(oriented(F.col("parts"))), ends), lambda e: e["a"] != e["b"])
    sides = layer.select(F.col(by).alias("_group"), F.explode(own).alias("e"), F.lit(1).alias("way"))
    kind = dict(layer.dtypes)[by]
    return union_border(sides, snap).groupBy("_group").applyInPandas(_chain, f"_group {kind}, parts {PARTS}").withColumnRenamed("_group", by)


def _chain(sides: pd.DataFrame) -> pd.DataFrame:
    made = chained(sides[["ax", "ay"]].to_numpy(), sides[["bx", "by"]].to_numpy())
    points = lambda r: [{"x": float(x), "y": float(y)} for x, y in r]
    return pd.DataFrame({"_group": [sides["_group"].iloc[0]], "parts": [[[points(r) for r in p] for p in made]]})


def chained(starts: np.ndarray, ends: np.ndarray) -> list[list[np.ndarray]]:
    """Parts from directed sides that meet at their ends only, the inner side to the left. At a vertex with several ways
    on, the sharpest left turn closes rings apart; a ring that turns right is a hole of the smallest ring around it."""
    following: dict[tuple, list[tuple]] = {}
    for a, b in zip(map(tuple, starts.tolist()), map(tuple, ends.tolist())):
        following.setdefault(a, []).append(b)
    found = []
    for start in sorted(following):
        while start in following:
            ring, here, before = [start], start, None
            while here in following:
                ways = sorted(following[here])
                if before is not None and len(ways) > 1:
                    back = np.arctan2(before[1] - here[1], before[0] - here[0])
                    ways.sort(key=lambda w: (back - np.arctan2(w[1] - here[1], w[0] - here[0])) % (2 * np.pi) or 2 * np.pi)
                following[here].remove(ways[0])
                if not following[here]:
                    del following[here]
                before, here = here, ways[0]
                ring.append(here)
                if here == start:
                    break
            found.append(np.array(ring))
    areas = [_signed(r) for r in found]
    outer = sorted((i for i, s in enumerate(areas) if s > 0), key=lambda i: areas[i])
    holes = {i: [] for i in outer}
    for i, s in enumerate(areas):
        if s <= 0:
            around = next((o for o in outer if areas[o] > -s and _holds(found[o], found[i])), None)
            holes[around].append(i) if around is not None else holes.setdefault(i, [])
    return [[found[i], *(found[h] for h in holes[i])] for i in sorted(holes)]


def _signed(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]
    return float((x[:-1] * y[1:] - x[1:] * y[:-1]).sum() / 2)


def _holds(ring: np.ndarray, other: np.ndarray) -> bool:
    """Whether other lies inside ring, where their sides only share ends: the middle of any side of other tells."""
    if (other.min(0) < ring.min(0)).any() or (other.max(0) > ring.max(0)).any():
        return False
    return bool(_inside(ring[:-1], ring[1:], (other[:1] + other[1:2]) / 2)[0])


def _inside(a: np.ndarray, b: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """Whether each point that is on no side (a, b) lies inside: an odd number of sides to its right."""
    odd = np.zeros(len(spots), bool)
    for at, (x, y) in enumerate(spots):
        crosses = (a[:, 1] > y) != (b[:, 1] > y)
        p, q = a[crosses], b[crosses]
        odd[at] = ((q[:, 0] - p[:, 0]) * (y - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0] > x).sum() % 2
    return odd


def simplify(layer: DataFrame, tolerance: float) -> DataFrame:
    """Douglas-Peucker on each ring by itself; rings keep four points at least and stay closed. Neighbours can come
    apart: see outlines.simplify_shared. A null shape stays null."""

    def of(part: list[np.ndarray]) -> list[list[np.ndarray]]:
        rings_ = [_thinned(r, tolerance) for r in part]
        return [[r for r in rings_ if len(r) >= 4]] if rings_ and len(rings_[0]) >= 4 else []

    return _shaped(layer, of)


def clip_to_box(layer: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Polygons cut to a rectangle. A concave shape falls into as many parts as it has inside; what lies outside, or
    has no shape, goes."""
    return _shaped(layer, lambda part: _clipped(part, xmin, ymin, xmax, ymax)).where(F.size("parts") > 0)


def _clipped(part: list[np.ndarray], xmin: float, ymin: float, xmax: float, ymax: float) -> list[list[np.ndarray]]:
    """The parts of one polygon inside a box. Its sides are cut at the box's lines; those inside stay, and so do the
    pieces of the box's border, between all points where a side reaches it, that have the polygon on their inner side."""
    rings_ = [r if (_signed(r) >= 0) == (n == 0) else r[::-1] for n, r in enumerate(part) if len(r) >= 4]
    if not rings_:
        return []
    a, b = np.concatenate([r[:-1] for r in rings_]), np.concatenate([r[1:] for r in rings_])
    low, high = np.array([xmin, ymin]), np.array([xmax, ymax])
    least, most = a.min(0), a.max(0)
    if (most <= low).any() or (least >= high).any():
        return []
    # a line with all of the polygon on its inner side cuts nothing, and no piece of the border on it is inside
    free_of = [bool(least[1] > ymin), bool(most[0] < xmax), bool(most[1] < ymax), bool(least[0] > xmin)]
    if all(free_of):
        return [rings_]
    from_, to = a, b
    for axis, at, free in ((0, xmin, free_of[3]), (0, xmax, free_of[1]), (1, ymin, free_of[0]), (1, ymax, free_of[2])):
        if free:
            continue
        crosses = (from_[:, axis] < at) != (to[:, axis] < at)
        crosses &= (from_[:, axis] != at) & (to[:, axis] != at)
        p, q = from_[crosses], to[crosses]
        middle_ = p + ((at - p[:, axis]) / (q[:, axis] - p[:, axis]))[:, None] * (q - p)
        middle_[:, axis] = at
        from_, to = np.concatenate([from_[~crosses], p, middle_]), np.concatenate([to[~crosses], middle_, q])
    moved = (from_ != to).any(1)
    from_, to = from_[moved], to[moved]
    within = ((from_ >= low) & (from_ <= high) & (to >= low) & (to <= high)).all(1)
    from_, to = from_[within], to[within]
    along = np.zeros(len(from_), bool)
    made = []
    corners = [(xmin, ymin), (xmax, ymin), (xmax, ymax), (xmin, ymax), (xmin, ymin)]
    for n, (p, q) in enumerate(zip(corners, corners[1:])):
        if free_of[n]:
            continue
        axis, at = 1 - n % 2, p[1 - n % 2]  # the border runs along the other axis
        on = (from_[:, axis] == at) & (to[:, axis] == at)
        along |= on
        reached = np.concatenate([from_[from_[:, axis] == at], to[to[:, axis] == at]])[:, 1 - axis]
        stops = np.unique(np.concatenate([reached, [p[1 - axis], q[1 - axis]]]))
        stops = stops if n < 2 else stops[::-1]
        spots = np.empty((len(stops) - 1, 2))
        spots[:, axis], spots[:, 1 - axis] = at, (stops[:-1] + stops[1:]) / 2
        way = np.zeros(len(spots), int)  # of the polygon's own sides on the border: 1 the border's way, -1 against it
        for s, t in zip(from_[on, 1 - axis], to[on, 1 - axis]):
            way += np.where((spots[:, 1 - axis] > min(s, t)) & (spots[:, 1 - axis] < max(s, t)), 1 if (t > s) == (n < 2) else -1, 0)
        kept = way > 0
        free = np.flatnonzero(way == 0)
        # on no side of the polygon: one ray away from the border decides
        kept[free] = _inside(a, b, spots[free]) if axis == 0 else _inside(a[:, ::-1], b[:, ::-1], spots[free, ::-1])
        for s, t in zip(stops[:-1][kept], stops[1:][kept]):
            ends = np.full((2, 2), at)
            ends[:, 1 - axis] = s, t
            made.append(ends)
    made = np.array(made).reshape(-1, 2, 2)
    from_, to = np.concatenate([from_[~along], made[:, 0]]), np.concatenate([to[~along], made[:, 1]])
    return [[_unbent(r) for r in p] for p in chained(from_, to)]


def _unbent(ring: np.ndarray) -> np.ndarray:
    """A ring without the points that the border's pieces left on straight level or upright lines."""
    p = ring[:-1]
    before, after = np.roll(p, 1, 0), np.roll(p, -1, 0)
    straight = ((before == p) & (p == after)).any(1)
    p = p[~straight] if (~straight).sum() >= 3 else p
    return np.concatenate([p, p[:1]])


def _shaped(layer: DataFrame, shape) -> DataFrame:
    """layer with each part (a list of rings) of its shapes replaced by the parts that `shape` makes of it."""
    names = layer.columns

    def of(batches):
        for b in batches:
            column = b.column("parts")
            flat = column.flatten()
            own, per_part, per_ring = (x.value_lengths().fill_null(0).to_numpy() for x in (column, flat, flat.flatten()))
            x, y = (c.to_numpy(zero_copy_only=False) for c in flat.flatten().flatten().flatten())
            xy, ends, made, at, ring = np.stack([x, y], 1), np.cumsum(per_ring), [], 0, 0
            shapes = []  # of all parts
            for n in per_part:
                shapes.append(shape([xy[ends[r] - per_ring[r] : ends[r]] for r in range(ring, ring + n)]))
                ring += n
            for n, there in zip(own, column.is_valid().to_pylist()):
                made.append([p for parts in shapes[at : at + n] for p in parts] if there else None)
                at += n
            yield pa.RecordBatch.from_arrays([_arrow_parts(made) if c == "parts" else b.column(c) for c in names], names)

    return spread(layer).mapInArrow(of, layer.schema)


def _arrow_parts(made: list) -> pa.Array:
    ends = lambda lengths: pa.array(np.cumsum([0, *lengths]), pa.int32())
    parts = [p for row in made for p in row or []]
    rings_ = [r for p in parts for r in p]
    xy = np.concatenate([np.zeros((0, 2)), *rings_])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["x", "y"])
    deep = pa.ListArray.from_arrays(ends(map(len, rings_)), points)
    own = pa.ListArray.from_arrays(ends(map(len, parts)), deep)
    none = pa.array([row is None for row in made], pa.bool_())
    return pa.ListArray.from_arrays(ends(len(row or []) for row in made), own, mask=none)


def _thinned(line: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker of an open line, or of a ring from its first point and the one farthest from it; a ring keeps
    four points."""
    closed = (line[0] == line[-1]).all()
    if len(line) <= (4 if closed else 2):
        return line
    far = int(np.argmax(((line - line[0]) ** 2).sum(1))) if closed else len(line) - 1
    keep = np.zeros(len(line), bool)
    keep[[0, far, len(line) - 1]] = True
    todo = [(0, far), (far, len(line) - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        away = _distance(line[a + 1 : b], line[a], line[b])
        at = int(np.argmax(away))
        if away[at] > tolerance:
            keep[a + 1 + at] = True
            todo += [(a, a + 1 + at), (a + 1 + at, b)]
    if closed and keep.sum() < 4:
        out = np.flatnonzero(~keep)
        keep[out[int(np.argmax(_distance(line[out], line[0], line[far])))]] = True
    return line[keep]


def _distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    along = np.clip(((p - a) @ d) / max(float(d @ d), 1e-300), 0, 1)
    return np.sqrt(((p - a - along[:, None] * d) ** 2).sum(1))
