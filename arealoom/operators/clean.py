"""Cleaning tables of area statistics."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions.values import COLUMN_SUPPRESSED, SUPPRESSED


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def null_suppressed(df: DataFrame, codes: Iterable[float] = SUPPRESSED) -> DataFrame:
    """Suppression codes in numeric columns become null."""
    numeric = set(numeric_columns(df))
    return df.select([F.when(~F.col(c).isin(*codes), F.col(c)).alias(c) if c in numeric else F.col(c) for c in df.columns])


def drop_suppressed_columns(df: DataFrame, codes: Iterable[float] = COLUMN_SUPPRESSED, nulls: str = "keep") -> DataFrame:
    """Without the numeric columns that hold nothing but codes. One aggregate answers for all columns.

    nulls "keep": a null is a value, so a column with one stays; "ignore": nulls do not count, so a column of nulls
    goes too. Of an empty table all numeric columns go.
    """
    numeric = numeric_columns(df)
    if not numeric:
        return df
    is_other = {"keep": lambda c: ~F.coalesce(c.isin(*codes), F.lit(False)), "ignore": lambda c: c.isNotNull() & ~c.isin(*codes)}[nulls]
    others = df.agg(*[F.count_if(is_other(F.col(c))).alias(c) for c in numeric]).first()
    return df.drop(*[c for c in numeric if not others[c]])


def drop_columns_like(df: DataFrame, pattern: str = r"_\d+$") -> DataFrame:
    return df.select([c for c in df.columns if not re.search(pattern, c)])


def split_levels(df: DataFrame, code: str, prefixes: Iterable[str] = ("BU", "WK", "GM")) -> dict[str, DataFrame]:
    """One frame per prefix of the trimmed code; each reads the table with its own pushed-down filter."""
    rows = df.withColumn(code, F.trim(code))
    return {p: rows.where(F.col(code).startswith(p)) for p in prefixes}


def in_parents(code: Column, parents: Iterable[str]) -> Column:
    """Characters 3 to 6 of a code are the digits of a listed parent."""
    digits = [m[0] for p in parents if (m := re.search(r"\d+", p))]
    return F.substring(code, 3, 4).isin(*digits)


def not_water(df: DataFrame, column: str = "water", value: str = "WATER") -> DataFrame:
    """Rows whose column is null or another value; all rows if there is no such column."""
    return df.where(F.col(column).isNull() | (F.col(column) != value)) if column in df.columns else df


def populated(df: DataFrame, column: str, wanted: bool = True) -> DataFrame:
    return df.where(F.col(column) > 0) if wanted and column in df.columns else df


def require_codes(df: DataFrame, code: str, wanted: DataFrame, strict: bool = False, shown: int = 1000) -> DataFrame:
    """Codes of `wanted` (its first column) that df lacks; with strict their presence is an error, which gives their
    number and, in order, the codes (the first `shown` of them, and says so)."""
    missing = wanted.toDF(code, *wanted.columns[1:]).select(code).distinct().join(df.select(code), code, "left_anti")
    if strict and (n := missing.count()):
        first = [str(r[0]) for r in missing.orderBy(code).limit(shown).collect()]
        raise ValueError(f"{n} codes not found{f', the first {shown} of them' if n > shown else ''}: {', '.join(first)}")
    return missing


def schema_difference(one: DataFrame, two: DataFrame) -> tuple[list[str], list[str]]:
    """Column names that only the first frame has, and only the second, each in its own order."""
    return [c for c in one.columns if c not in two.columns], [c for c in two.columns if c not in one.columns]


def join_stats(areas: DataFrame, stats: DataFrame, left: str, right: str) -> DataFrame:
    """Left equi join; the key stays from the left, other clashing names get _x and _y."""
    clash = (set(areas.columns) & set(stats.columns)) - {right}
    a = areas.select([F.col(c).alias(f"{c}_x" if c in clash else c) for c in areas.columns])
    b = stats.select([F.col(c).alias("_key" if c == right else f"{c}_y" if c in clash else c) for c in stats.columns])
    return a.join(b, F.col(f"{left}_x" if left in clash else left) == F.col("_key"), "left").drop("_key")


def only_listed(df: DataFrame, key: str, listed: DataFrame, listed_key: str) -> DataFrame:
    return df.join(listed.select(F.col(listed_key).alias(key)).distinct(), key, "left_semi")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in a repeatable mixed order of their key."""
    return df.orderBy(F.pmod(F.col(key) * 7919 + seed, F.lit(100003)), key).limit(n)


def column_profile(df: DataFrame, column: str) -> DataFrame:
    """Count, smallest and largest of the positive numbers that are not suppressed."""
    return df.where((F.col(column) > 0) & ~F.col(column).isin(*SUPPRESSED)).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
