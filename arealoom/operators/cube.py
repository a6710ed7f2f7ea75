"""Slices of stored cubes, in which null in a dimension means all."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import at_least_one, format_code, label


def slice_filter(dim: str, others: Iterable[str]) -> Column:
    return reduce(and_, [F.col(o).isNull() for o in others], F.col(dim).isNotNull())


def cube_slice(cube: DataFrame, area: str, year: str, dim: str, others: Iterable[str], years: Iterable | None = None, value: str = "value") -> DataFrame:
    """Sums by area, year and one dimension, of the rows that mean all of the others."""
    rows = cube.where(slice_filter(dim, others))
    rows = rows.where(F.col(year).isin(*years)) if years is not None else rows
    return rows.groupBy(area, year, dim).agg(F.sum(value).alias(value))


def cube_total(cube: DataFrame, area: str, year: str, over: str, others: Iterable[str], years: Iterable | None = None, value: str = "value") -> DataFrame:
    """Totals by area and year, summed over one dimension's rows."""
    return cube_slice(cube, area, year, over, others, years, value).groupBy(area, year).agg(F.sum(value).alias("total"))


def cube_build(base: DataFrame, dims: Iterable[str], value: str = "value") -> DataFrame:
    return base.cube(*dims).agg(F.sum(value).alias(value))


def node_marginals(cube: DataFrame, area: str, year: str, dims: list[str], labels: dict[str, dict] | None = None, value: str = "value") -> DataFrame:
    """All single-dimension marginals in one scan: (code, year, dim, label, n). A row belongs to the marginal of its
    only dimension that is not null."""
    one = sum((F.col(d).isNotNull().cast("int") for d in dims), F.lit(0)) == 1
    name = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dims])
    shown = F.coalesce(*[label(F.col(d), labels[d]) if labels and d in labels else F.col(d).cast("string") for d in dims])
    rows = cube.where(one).select(format_code(F.col(area)).alias("code"), F.col(year).alias("year"), name.alias("dim"), shown.alias("label"), value)
    return rows.groupBy("code", "year", "dim", "label").agg(F.sum(value).alias("n"))


def nodes_summary(work: DataFrame, home: DataFrame, people: DataFrame, on: list[str]) -> DataFrame:
    """Totals of three tables side by side and their ratios, from the rows of the first."""
    wide = work.join(home, on, "left").join(people, on, "left")
    ratio = lambda a: F.bround(F.col(a) / at_least_one(F.col("people")), 4)
    return wide.withColumn("work_per_person", ratio("work")).withColumn("home_per_person", ratio("home"))


def year_change(totals: DataFrame, area: str, year: str, first: int, last: int, value: str) -> DataFrame:
    wide = totals.where(F.col(year).isin(first, last)).groupBy(area).pivot(year, [first, last]).agg(F.sum(value))
    a, b = F.col(str(first)), F.col(str(last))
    return wide.select(area, a.alias("before"), b.alias("after"), (b - a).alias("change"), F.bround(F.try_divide(b - a, a), 6).alias("relative"))


def write_cube(cube: DataFrame, dims: list[str], path: str) -> None:
    """A cube (null: all) in folders by grouping set: `kept` names the dims that are not null, in order."""
    kept = F.concat_ws("+", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in dims])
    cube.withColumn("kept", F.when(kept == "", "none").otherwise(kept)).write.partitionBy("kept").parquet(path)


def stored_set(spark, path: str, dims: list[str], kept: list[str]) -> DataFrame:
    """The rows of one grouping set of a cube that write_cube wrote; other sets' folders are not read."""
    return spark.read.parquet(path).where(F.col("kept") == ("+".join(c for c in dims if c in kept) or "none")).drop("kept")
