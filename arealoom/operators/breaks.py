"""Exact quantile breaks at any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import valid
from ..sources.scratch import staged

#: Different values that one task sorts at most, and buckets of a round of the selection.
SORTED, BUCKETS = 50_000, 1024


def group_breaks(rows: DataFrame, keys: list[str], value: str, classes: int = 4) -> DataFrame:
    """(keys, breaks): per group the elements at 0-based place floor((i + 1) / classes * n) of the sorted valid values.

    A null key is a group of its own. Groups with fewer than `classes` values have empty breaks. Places are found by
    selection in rounds (see order_statistics), so no task holds more than SORTED different values of a group.
    """
    places = break_places(classes)
    sums, found = order_statistics(rows, keys, value, places, classes)
    breaks = F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"])
    made = found.groupBy(*keys).agg(breaks.alias("breaks"))
    return null_safe(sums.select(*keys), made, keys, "left").withColumn("breaks", F.coalesce("breaks", F.array().cast("array<double>")))


def break_places(classes: int = 4) -> list[Column]:
    """The 0-based places of the breaks among `total` sorted values."""
    return [F.least(F.floor((i + 1) / classes * F.col("total")), F.col("total") - 1) for i in map(F.lit, range(classes - 1))]


def group_quantiles(rows: DataFrame, keys: list[str], value: str, spots: list[float]) -> DataFrame:
    """(keys, i, value): per group and spot the quantile of the valid values, interpolated between the two around it."""
    at = [F.lit(float(q)) * (F.col("total") - 1) for q in spots]
    sums, found = order_statistics(rows, keys, value, [end(p).cast("long") for p in at for end in (F.floor, F.ceil)], 1)
    spot = F.element_at(F.array(*[F.lit(float(q)) for q in spots]), (F.col("i") + 1).cast("int"))
    ends = found.select(*keys, F.expr("i div 2").alias("i"), (F.col("i") % 2).alias("end"), "v")
    ends = ends.groupBy(*keys, "i").agg(F.min(F.when(F.col("end") == 0, F.col("v"))).alias("low"), F.min(F.when(F.col("end") == 1, F.col("v"))).alias("high"))
    part = spot * (F.col("total") - 1) - F.floor(spot * (F.col("total") - 1))
    return null_safe(ends, sums, keys).select(*keys, F.col("i").cast("int").alias("i"), ((1 - part) * F.col("low") + part * F.col("high")).alias("value"))


def null_safe(one: DataFrame, two: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi join in which null keys are equal; two's keys go."""
    other = two.select(*[F.col(c).alias(f"_other_{c}" if c in keys else c) for c in two.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_other_{k}")) for k in keys]
    return one.join(other, on, how).drop(*[f"_other_{k}" for k in keys])


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: list[Column], least: int) -> tuple[DataFrame, DataFrame]:
    """(keys, total) of the valid values, and (keys, i, place, v): the value at the 0-based places[i], in groups of
    `least` or more. rows are evaluated once: their different values and counts are staged.

    The interval of values that holds a wanted place is cut into buckets, and the one with the place is the next
    interval, until it has SORTED different values at most: these are sorted. The first cut of an interval that spans
    many magnitudes is by sign and power of two, further cuts are even, so some seven rounds do for any doubles.
    """
    good = rows.where(valid(F.col(value))).select(*keys, F.col(value).cast("double").alias("v"))
    counts = staged(good.groupBy(*keys, "v").agg(F.count("*").alias("n")))
    held = [F.count("*").alias("values"), F.min("v").alias("low"), F.max("v").alias("high")]
    sums = staged(counts.groupBy(*keys).agg(F.sum("n").alias("total"), *held))
    wanted = sums.where(F.col("total") >= least).select("*", F.posexplode(F.array(*places)).alias("i", "place"))
    wanted = wanted.select(*keys, "i", "place", F.lit(0).cast("long").alias("before"), "values", "low", "high")
    slot, at, most = [*keys, "low", "high"], F.col("place") - F.col("before"), sums
    while (most.agg(F.max("values")).first()[0] or 0) > SORTED:
        dealt = in_slots(counts, wanted.where(F.col("values") > SORTED), keys)
        per = dealt.groupBy(*slot, bucket(F.col("v"), F.col("low"), F.col("high")).alias("b")).agg(F.sum("n").alias("own"), F.count("*").alias("_values"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        per = per.withColumn("start", F.sum("own").over(Window.partitionBy(*slot).orderBy("b")) - F.col("own"))
        cut = null_safe(wanted, per, slot).where((at >= F.col("start")) & (at < F.col("start") + F.col("own")))
        cut = cut.select(*keys, "i", "place", (F.col("before") + F.col("start")).alias("before"), F.col("_values").alias("values"), F.col("_low").alias("low"), F.col("_high").alias("high"))
        wanted = most = staged(cut.union(wanted.where(F.col("values") <= SORTED)))
    ranked = in_slots(counts, wanted, keys).select(*slot, "v", "n", F.sum("n").over(Window.partitionBy(*slot).orderBy("v")).alias("upto"))
    found = null_safe(ranked, wanted, slot).where((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")))
    return sums.select(*keys, "total"), found.select(*keys, "i", "place", "v")


def in_slots(counts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The counted values within the wanted intervals of their group: a few intervals a group."""
    return null_safe(counts, wanted.select(*keys, "low", "high").distinct(), keys).where(F.col("v").between(F.col("low"), F.col("high")))


def bucket(v: Column, low: Column, high: Column) -> Column:
    """The bucket of v in an interval, never falling where v rises: even ones, or the sign and power of two where the
    ends differ in sign or by more than BUCKETS times."""
    power = lambda x: F.when(x == 0, 0).otherwise(F.signum(x) * (F.floor(F.log2(F.abs(x))) + 1100))
    even = F.least(F.floor(F.try_divide(v - low, high - low) * BUCKETS), F.lit(BUCKETS - 1))
    near = (F.signum(low) == F.signum(high)) & (F.greatest(F.abs(low), F.abs(high)) / BUCKETS <= F.least(F.abs(low), F.abs(high)))
    return F.when(near, even).otherwise(power(v)).cast("long")


def breaks_of(rows: DataFrame, value: str, classes: int = 4) -> list[float]:
    """The breaks of one column, as numbers for further plans."""
    found = group_breaks(rows.select(F.lit(0).alias("_all"), value), ["_all"], value, classes).first()
    return list(found.breaks) if found else []
