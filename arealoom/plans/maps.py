"""Classified map layers."""

from __future__ import annotations

import ast

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import classify, unsuppressed
from ..operators.breaks import group_breaks
from ..sources.scratch import staged


def choropleth(df: DataFrame, id_column: str, value: Column, classes: int = 4, null_as_zero: bool = False) -> DataFrame:
    """(id, value, cls). Breaks are classes - 1 numbers; a null value has class -1, or counts as 0 if asked. df is
    evaluated once: ids and values are staged for the breaks and the classes."""
    v = F.coalesce(value.cast("double"), F.lit(0.0)) if null_as_zero else value.cast("double")
    rows = staged(df.select(F.col(id_column).cast("string").alias("id"), v.alias("value"), F.lit(0).alias("_all")))
    breaks = group_breaks(rows, ["_all"], "value", classes)
    made = rows.join(F.broadcast(breaks), "_all", "left")  # one row of some numbers
    return made.select("id", "value", classify(F.col("value"), F.coalesce("breaks", F.array().cast("array<double>"))).alias("cls"))


def stats_choropleth(df: DataFrame, id_column: str, column: str, value=lambda c: c, **options) -> DataFrame:
    """Of one statistics column, suppression codes nulled first; a column that is not there gives no rows."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], "id string, value double, cls int")
    return choropleth(df, id_column, value(unsuppressed(F.col(column))), **options)


def choropleth_many(df: DataFrame, id_column: str, variables: list[str], scale: str) -> DataFrame:
    """(scale, variable, id, value, cls) of all variables in one job, each with its own breaks."""
    rows = df.select(F.col(id_column).cast("string").alias("id"), *[unsuppressed(F.col(v)).cast("double").alias(v) for v in variables])
    long = rows.unpivot("id", variables, "variable", "value").withColumn("scale", F.lit(scale))
    breaks = group_breaks(long, ["scale", "variable"], "value")
    made = long.join(F.broadcast(breaks), ["scale", "variable"], "left")  # one row of three numbers per variable
    return made.select("scale", "variable", "id", "value", classify(F.col("value"), F.col("breaks")).alias("cls"))


def two_layers(inner: tuple[DataFrame, str, str], outer: tuple[DataFrame, str, str], shared: bool = False, value=lambda c: c, **options) -> DataFrame:
    """(layer, variable, id, value, cls) of an inner and an outer (table, id column, variable), each with its own
    breaks; `shared` shows the inner layer's variable on both. A layer without the variable has no rows."""
    made = []
    for name, (df, id_column, variable) in (("inner", inner), ("outer", outer)):
        variable = inner[2] if shared else variable
        rows = stats_choropleth(df, id_column, variable, value, **options)
        made.append(rows.select(F.lit(name).alias("layer"), F.lit(variable).alias("variable"), "id", "value", "cls"))
    return made[0].union(made[1])


def available(variables: DataFrame, scale: str) -> DataFrame:
    """Rows of a variable registry (key, label, group, can_normalise, available_at array<string>) for one scale."""
    return variables.where(F.array_contains("available_at", scale))


def registered_layer(registry: DataFrame, tables: dict[tuple[str, str], tuple[DataFrame, str]], scale: str, variable: str, value=lambda c, row: c, **options) -> DataFrame:
    """(scale, variable, id, value, cls) of a variable as its registry row says: `kind` is the table to take it from
    ('stats', 'node' or 'flow') and `source` its column there. tables gives (rows, id column) by (scale, kind).
    value(column, row) may normalise where the row allows it. A variable that the registry does not have at this scale,
    or whose table is missing, has no rows."""
    row = available(registry, scale).where(F.col("key") == variable).first()  # one row by its key
    if row is None or (scale, row.kind) not in tables:
        return registry.sparkSession.createDataFrame([], "scale string, variable string, id string, value double, cls int")
    df, id_column = tables[scale, row.kind]
    made = stats_choropleth(df, id_column, row.source, lambda c: value(c, row), **options)
    return made.select(F.lit(scale).alias("scale"), F.lit(variable).alias("variable"), "id", "value", "cls")


def feature_states(features: DataFrame, id_column: str, classed: DataFrame) -> DataFrame:
    """Every feature with its class; -1 for those without a row."""
    rows = features.select(F.col(id_column).cast("string").alias("id"))
    return rows.join(classed.select("id", "cls"), "id", "left").withColumn("cls", F.coalesce("cls", F.lit(-1)))


def computed(df: DataFrame, name: str, formula: str, allowed: list[str]) -> DataFrame:
    """df plus a column of plain arithmetic (+ - * / and brackets) over allowed columns; division by zero gives null."""
    means = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide}

    def column(node) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in means:
            return means[type(node.op)](column(node.left), column(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -column(node.operand)
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name) and node.id in allowed:
            return F.col(node.id).cast("double")
        raise ValueError(f"not allowed in a formula: {ast.unparse(node)}")

    return df.withColumn(name, column(ast.parse(formula, mode="eval").body))
