"""What the operators of this package share: tables, scratch tables, running totals, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..sources.scratch import shared_folder, staged  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running_total(df: DataFrame, keys: list[str], bucket: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Add `out`: the total of `value` before each row, per keys, in the order (bucket, *order).

    A key may hold any share of the rows: rows are summed per (keys, bucket) first, only these sums meet
    in one window per key, and the rows' own window covers one bucket. keys and bucket may be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, bucket])],
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"),
    )
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate([*keys, bucket])]
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(totals, on, "left")
    return joined.select(*df.columns, (F.col("_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(out))


def nested(df: DataFrame, leave: tuple[str, ...] = ()) -> DataFrame:
    """One column `row` that holds df's columns, so that columns added beside it clash with none of them."""
    return df.select(F.struct(*[quoted(c) for c in df.columns if c not in leave]).alias("row"))


def needs_long(df: DataFrame, name: str) -> None:
    if (own := df.schema[name].dataType) != LongType():
        raise TypeError(f"{name} is {own.simpleString()}: cast it to bigint")


def quoted(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def content(df: DataFrame) -> Column:
    """A text that rows share only if they are equal in every column (texts by MD5)."""
    others = [quoted(c) for c in df.columns if c != "text"]
    return F.concat(F.coalesce(F.md5("text"), F.lit("null")), F.to_json(F.struct(*others)) if others else F.lit(""))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected edges (a, b): rows (node, component), component the smallest node.

    Alternating large-star and small-star steps: each node's neighbours move to its smallest neighbour until
    every component is a star, which takes about as many rounds as the logarithm of the longest path. All steps are
    joins and partial aggregates on (a); nothing is collected.
    Nodes are longs; nodes without an edge to another node do not appear.
    """
    now = staged(_pairs(edges.where("a <> b")))
    mark = _mark(now)
    last = None
    while mark != last:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = staged(_pairs(small.select("e.*").where("a <> b")))
        last, mark = mark, _mark(now)
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """A set of edges in one row: its size and two sums of hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())


def find(root: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The roots of x in a forest of arrays (inside one task)."""
    while ((up := root[x]) != x).any():
        x = up
    return x


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of a[i] and b[i]; smaller indices become roots."""
    while True:
        a, b = find(root, a), find(root, b)
        differ = a != b
        if not differ.any():
            return
        a, b = a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))


def parts(batches, rows: int = 128):
    """Arrow batches in parts of a few rows, for texts can be long."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
