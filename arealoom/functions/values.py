"""Values of area statistics: suppression codes, codes of areas, labels, normalisation, classes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes that stand for suppressed numbers; those that make a whole column useless; the guard below
#: which no number is shown.
SUPPRESSED = (-99995, -99997, -99994, -99993, -99999)
COLUMN_SUPPRESSED = (-99995, -99997)
LEAST_VALID = -99990

def unsuppressed(value: Column, codes=SUPPRESSED) -> Column:
    return F.when(~value.isin(*codes), value)


def valid(value: Column) -> Column:
    """Finite and above the guard; null is not valid."""
    v = value.cast("double")
    return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")) & (v > LEAST_VALID), F.lit(False))


def format_code(value: Column, prefix: str = "GM", digits: int = 4) -> Column:
    """363, "363", "GM363", "gm0363" and 363.7 become GM0363; longer numbers are not cut. Anything but digits, and
    digits past a long, become null."""
    text = F.when(value.isNotNull(), F.trim(value.cast("string")))
    number = F.regexp_extract(text, rf"(?i)^(?:{prefix})?(\d+)(?:\.\d*)?$", 1).try_cast("long")
    return F.when(number.isNotNull(), F.format_string(f"{prefix}%0{digits}d", number))


def label(code: Column, labels: Mapping) -> Column:
    """The label of a code, compared as text; null for codes without one. Label maps are the caller's data: those of
    a layer come with it, as a table (labels_of) or a dict."""
    pairs = [F.lit(str(x)) for kv in labels.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), code.cast("string"))


def labels_of(table: DataFrame, code: str, text: str, most: int = 1000) -> dict[str, str]:
    """A code list of up to `most` rows as a label map; longer lists are joined (label_joined)."""
    rows = table.select(F.col(code).cast("string"), F.col(text).cast("string")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a code list of more than {most} rows: use label_joined")
    return {r[0]: r[1] for r in rows if r[0] is not None}


def label_joined(df: DataFrame, column: str, table: DataFrame, code: str, text: str, out: str) -> DataFrame:
    """df plus `out`: the label of its column in a code list of any length, null where it has none. A code that is
    listed twice takes the smallest label."""
    names = table.where(F.col(code).isNotNull()).groupBy(F.col(code).cast("string").alias("_code")).agg(F.min(F.col(text).cast("string")).alias(out))
    return df.drop(out).join(names, F.col(column).cast("string") == F.col("_code"), "left").drop("_code")


def at_least_one(value: Column) -> Column:
    """A divisor that is never zero; null stays null."""
    return F.when(value.isNotNull(), F.greatest(value, F.lit(1)))


def normalise(value: Column, how: str = "none", land_ha: Column | None = None, inhabitants: Column | None = None) -> Column:
    if how == "none":
        return value.cast("double")
    if how == "per_km2":
        return F.when(land_ha > 0, value / (land_ha / F.lit(100.0)))
    if how == "per_1000":
        return F.when(inhabitants > 0, value.cast("double") / inhabitants * 1000)
    raise ValueError(f"unknown normalisation {how}")


def classify(value: Column, breaks: Column) -> Column:
    """-1 for what is not valid, else the number of breaks below the value (a break belongs to the lower class)."""
    below = F.size(F.filter(breaks, lambda b: b < value.cast("double")))
    return F.when(valid(value), F.when(breaks.isNull(), F.lit(0)).otherwise(below)).otherwise(F.lit(-1))
