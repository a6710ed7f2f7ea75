"""Origin-destination flows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import staged

from ..functions.values import format_code

REQUIRED = ("origin_id", "destination_id", "flow_value")


def flows_from_raw(raw: DataFrame, source: str = "source", sink: str = "sink", count: str = "count", **constants) -> DataFrame:
    rows = raw.select(format_code(F.col(source)).alias("origin_id"), format_code(F.col(sink)).alias("destination_id"), F.col(count).try_cast("double").alias("flow_value"))
    return rows.withColumns({k: F.lit(v) for k, v in constants.items()}) if constants else rows


def od_sum(raw: DataFrame, origin: str, destination: str, period: str, value: str) -> DataFrame:
    return raw.groupBy(origin, destination, period).agg(F.sum(value).alias("value"))


def edges(sums: DataFrame, origin: str, destination: str, period: str, divide: int = 1) -> DataFrame:
    """Sums as an edge table: formatted codes, values over `divide` rounded half to even, positive ones only."""
    value = F.bround(F.col("value") / divide) if divide != 1 else F.col("value").cast("double")
    rows = sums.select(format_code(F.col(origin)).alias("origin_id"), format_code(F.col(destination)).alias("destination_id"), value.alias("flow_value"), F.col(period).alias("periode"))
    return rows.where("flow_value > 0")


def flow_summary(flows: DataFrame, *by: str) -> DataFrame:
    """Per origin: total_outflow (0 if all values are null) and n_destinations (null counts as one)."""
    n = F.countDistinct("destination_id") + F.max(F.col("destination_id").isNull().cast("int"))
    return flows.groupBy("origin_id", *by).agg(F.coalesce(F.sum("flow_value"), F.lit(0)).cast("double").alias("total_outflow"), n.alias("n_destinations"))


def flow_profile(flows: DataFrame) -> DataFrame:
    return flows.agg(
        F.count("*").alias("n_rows"), F.countDistinct("origin_id").alias("n_origins"), F.countDistinct("destination_id").alias("n_destinations"),
        F.sum("flow_value").alias("total"), F.max("flow_value").alias("largest"),
    )


def validate_flows(flows: DataFrame, nodes: DataFrame, node_id: str) -> tuple[DataFrame, DataFrame]:
    """The flows as they are, and one row of counts: null values, and rows whose ends are no nodes."""
    if missing := [c for c in REQUIRED if c not in flows.columns]:
        raise ValueError(f"flows lack columns: {', '.join(missing)}")
    # rows are counted by pair first, so the joins with the nodes take one row a pair of ends
    pairs = flows.groupBy("origin_id", "destination_id").agg(F.count("*").alias("n"), F.count_if(F.col("flow_value").isNull()).alias("n_null"))
    ends = pairs.unpivot(["n", "n_null"], ["origin_id", "destination_id"], "end", "_id")
    ends = ends.groupBy("end", "_id").agg(F.sum("n").alias("n"), F.sum("n_null").alias("n_null"))
    known = nodes.select(F.col(node_id).cast("string").alias("_node")).where("_node is not null").distinct()
    rows = ends.join(known, F.col("_id") == F.col("_node"), "left")
    of = lambda end, what: F.coalesce(F.sum(F.when((F.col("end") == end) & (F.col("_node").isNull() if what == "unmatched" else F.lit(True)), F.col("n_null" if what == "n_null" else "n"))), F.lit(0)).cast("long")
    report = rows.agg(
        of("origin_id", "n").alias("n_rows"), of("origin_id", "n_null").alias("n_null"),
        of("origin_id", "unmatched").alias("unmatched_origins"), of("destination_id", "unmatched").alias("unmatched_destinations"),
    )
    return flows, report


def top_flows(flows: DataFrame, period: str | None = None, n: int = 500) -> DataFrame:
    rows = flows.where(F.col("periode") == period) if period is not None else flows
    return rows.orderBy(F.desc("flow_value"), "origin_id", "destination_id").limit(n)


def last_centroids(points: DataFrame) -> DataFrame:
    """One point per id: the last in load order."""
    return points.groupBy("id").agg(F.max_by(F.struct("lng", "lat"), "pos").alias("p")).select("id", "p.lng", "p.lat")


def flow_lines(top: DataFrame, points: DataFrame) -> DataFrame:
    """Flows with both ends on the map, as lines."""
    one = last_centroids(points)
    ends = [one.select(F.col("id").alias(f"{s}_id"), F.array("lng", "lat").alias(f"_{s}")) for s in ("origin", "destination")]
    rows = top.join(ends[0], "origin_id").join(ends[1], "destination_id")
    return rows.select("origin_id", "destination_id", "flow_value", F.struct(F.lit("LineString").alias("type"), F.array("_origin", "_destination").alias("coordinates")).alias("geometry"))


def od_matrix(flows: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Every pair of different nodes, 0 where no flow is known. The result is the product of the node list with
    itself by definition, so it is for lists of areas, not for raw rows."""
    ids = nodes.select(F.col(node_id).alias("origin_id")).distinct()
    pairs = ids.crossJoin(ids.select(F.col("origin_id").alias("destination_id"))).where("origin_id <> destination_id")
    sums = flows.groupBy("origin_id", "destination_id").agg(F.sum("flow_value").alias("flow_value"))
    return pairs.join(sums, ["origin_id", "destination_id"], "left").withColumn("flow_value", F.coalesce("flow_value", F.lit(0.0)))


def herfindahl(flows: DataFrame) -> DataFrame:
    """Concentration of each origin's flows: the sum of squared shares."""
    sums = flows.groupBy("origin_id", "destination_id").agg(F.sum("flow_value").alias("v"))
    share = F.try_divide(F.col("v"), F.sum("v").over(Window.partitionBy("origin_id")))
    return sums.withColumn("share", share).groupBy("origin_id").agg(F.bround(F.sum(F.col("share") * F.col("share")), 6).alias("herfindahl"))


def gravity_fit(flows: DataFrame, points: DataFrame) -> DataFrame:
    """(beta, scale, n): the gravity model's exponent and factor by least squares on logarithms, over pairs with a
    positive flow and distance: log(flow / (outflow * inflow)) = log(scale) - beta * log(distance)."""
    rows = gravity(flows, points).where("flow_value > 0 and outflow > 0 and inflow > 0")
    y, x = F.log(F.col("flow_value") / (F.col("outflow") * F.col("inflow"))), F.log("distance")
    made = rows.select(y.alias("y"), x.alias("x")).agg((-F.regr_slope("y", "x")).alias("beta"), F.exp(F.regr_intercept("y", "x")).alias("scale"), F.count("*").alias("n"))
    return made.select("beta", "scale", "n")


def gravity(flows: DataFrame, points: DataFrame, beta: float = 2.0) -> DataFrame:
    """Flows by pair and what a gravity model gives: outflow * inflow * distance ** -beta; pairs with a distance."""
    sums = flows.groupBy("origin_id", "destination_id").agg(F.sum("flow_value").alias("flow_value"))
    out = sums.groupBy("origin_id").agg(F.sum("flow_value").alias("outflow"))
    into = sums.groupBy("destination_id").agg(F.sum("flow_value").alias("inflow"))
    at = [points.select(F.col("id").alias(f"{s}_id"), F.col("x").alias(f"{s}_x"), F.col("y").alias(f"{s}_y")) for s in ("origin", "destination")]
    rows = sums.join(out, "origin_id").join(into, "destination_id").join(at[0], "origin_id").join(at[1], "destination_id")
    dx, dy = F.col("origin_x") - F.col("destination_x"), F.col("origin_y") - F.col("destination_y")
    rows = rows.withColumn("_square", dx * dx + dy * dy).where("_square > 0").withColumn("distance", F.sqrt("_square"))
    return rows.select("origin_id", "destination_id", "flow_value", "outflow", "inflow", "distance", (F.col("outflow") * F.col("inflow") / F.pow("_square", F.lit(beta / 2))).alias("expected"))


def balanced(seed: DataFrame, outflow: DataFrame, inflow: DataFrame, tolerance: float = 1e-9, most_rounds: int = 200) -> DataFrame:
    """(origin_id, destination_id, flow_value): the seed's flows times a factor per origin and one per destination, so
    that origins sum to outflow (origin_id, total) and destinations to inflow (destination_id, total), by rescaling
    both in turn until no total is off by more than `tolerance` of itself.

    Pairs that the seed lacks stay empty; origins and destinations without a total have none to reach and are left out.
    The two lists must have the same sum, and the seed must leave a way to meet them: else the rounds run out, which is
    an error. Each round is two joins and sums; only the factors are staged, one row per area.
    """
    pairs = seed.groupBy("origin_id", "destination_id").agg(F.sum("flow_value").alias("seed")).where("seed > 0")
    pairs = staged(pairs.join(outflow.select("origin_id"), "origin_id", "left_semi").join(inflow.select("destination_id"), "destination_id", "left_semi"))
    rows, columns = (staged(df.where("total > 0").groupBy(k).agg(F.sum("total").alias("total"))) for df, k in ((outflow, "origin_id"), (inflow, "destination_id")))
    sums = [df.agg(F.sum("total")).first()[0] or 0.0 for df in (rows, columns)]
    if abs(sums[0] - sums[1]) > 1e-6 * max(sums):
        raise ValueError(f"origins sum to {sums[0]}, destinations to {sums[1]}")
    to = columns.select("destination_id", F.lit(1.0).alias("into"))
    for _ in range(most_rounds):
        reached = pairs.join(to, "destination_id").groupBy("origin_id").agg(F.sum(F.col("seed") * F.col("into")).alias("reached"))
        of = staged(rows.join(reached, "origin_id").select("origin_id", (F.col("total") / F.col("reached")).alias("out_of")))
        reached = pairs.join(of, "origin_id").groupBy("destination_id").agg(F.sum(F.col("seed") * F.col("out_of")).alias("reached"))
        last, to = to, staged(columns.join(reached, "destination_id").select("destination_id", (F.col("total") / F.col("reached")).alias("into"), "total"))
        # destinations are met by these factors; origins are as far off as the factors have moved
        moved = to.join(last.select("destination_id", F.col("into").alias("before")), "destination_id").agg(F.max(F.abs(F.col("into") / F.col("before") - 1))).first()[0]
        if moved is None or moved <= tolerance:
            return pairs.join(of, "origin_id").join(to, "destination_id").select("origin_id", "destination_id", (F.col("seed") * F.col("out_of") * F.col("into")).alias("flow_value"))
    raise ValueError(f"totals not met after {most_rounds} rounds")


def scan_centroids(spark, path: str) -> DataFrame:
    """(id, pos, lng, lat) of files that hold one JSON array of points each; pos is the place in load order, by file and
    within it. A file is read as a whole."""
    text = spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("file"), "value")
    made = text.select("file", F.posexplode(F.from_json("value", "array<struct<id:string,lng:double,lat:double>>")).alias("place", "p"))
    return made.select("p.id", F.struct("file", "place").alias("pos"), "p.lng", "p.lat")
