"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words; each of its documents expects target / size copies. The expected
copies are prefix-summed within the source, one random offset is added, and a document is taken once for each
integer that its interval crosses. So a document is taken floor or ceil of its expectation times.

Edge cases: a null text has size 0; rows without a doc_id are dealt to buckets and ordered by their text instead (null
ids and null texts together are one bucket); ties of size are taken in order of doc_id; a very long text is a document
like any other, with an interval no longer than theirs; a null source is a source of its own, last in order; a source without words
has target 0 and none of its documents is taken; an empty table gives an empty result; repeated rows are documents
of their own, and the mix takes rows that are equal in every column as one total; columns of any name come through
the mix unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import content, quoted, running_total, staged

#: A word, and the fixed point of expected copies (copies sum up exactly, in any order).
WORD = r"[^\x20\x09-\x0D]+"
POINT = 26


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digest_number(text: Column) -> Column:
    """A number below 2^32 from the text's MD5: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def own_key(docs: DataFrame) -> Column:
    """What deals a row to its bucket: its doc_id or, without one, its text."""
    return F.coalesce(docs["doc_id"].cast("string"), F.md5(docs["text"]), F.lit("")).alias("_own")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size) rows.

    Sources in order of code points, null last, take the weights in turn and split share * all sizes by them;
    a target stops at most * its source's size and the excess goes to the others by weight (water filling:
    sources that fill up first come first, and the level is what is left for the weights that are left).
    One row per source meets in one window.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("rank", rank).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    earlier, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    weights_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))
    per = per.withColumn("level", left / weights_left).withColumn("pos", F.row_number().over(order))
    per = per.withColumn("open", F.min(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("pos"))).over(everything))
    per = per.withColumn("level", F.max(F.when(F.col("pos") == F.col("open"), F.col("level"))).over(everything))
    filled = F.col("open").isNull() | (F.col("pos") < F.col("open"))
    return per.select("source", "source_size", "n_docs", F.when(filled, F.col("cap")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 1000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies; texts are read once, never shuffled.

    A source's documents lie in hashed buckets of about bucket_rows and in order of size within each, so the
    copies taken follow the sizes and one hot source spreads over many tasks.
    """
    return _planned(docs.select("doc_id", "source", words(F.col("text")).alias("size"), own_key(docs)), weights, share, most, seed, bucket_rows).select("doc_id", "source", "size", "source_size", "target", "copies")


def _planned(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, bucket_rows: int = 1000) -> DataFrame:
    """sizes (doc_id, source, size, _own and more) with source_size, target and copies."""
    sizes = staged(sizes)
    targets = staged(source_targets(sizes, weights, share, most)).withColumnRenamed("source", "_source")
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    n_buckets = F.ceil(F.col("n_docs") / bucket_rows).cast("long")
    rows = rows.withColumn("_bucket", F.pmod(digest_number(F.col("_own")), n_buckets))
    units = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.lit(float(1 << POINT)))).otherwise(F.lit(0.0))
    rows = rows.withColumn("_units", units.cast("long"))
    rows = running_total(rows, ["source"], "_bucket", [F.col("size"), F.col("doc_id").asc_nulls_last(), F.col("_own")], "_units", "_before")
    offset = F.pmod(digest_number(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("\0")))), F.lit(1 << POINT))
    low = F.col("_before") + offset
    copies = F.shiftright(low + F.col("_units"), POINT) - F.shiftright(low, POINT)
    return rows.select(*sizes.columns, "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with docs' own columns.

    The plan joins the rows by their content. Rows that are equal in every column share a total: each is taken as
    often as that divides, and one of them again for the rest, so the mix has exactly the planned copies and no
    window or group holds the texts of equal rows.
    """
    key = F.md5(content(docs))
    plan = _planned(docs.select("doc_id", "source", words(F.col("text")).alias("size"), own_key(docs), key.alias("key")), **options)
    plan = staged(plan.groupBy("key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0"))
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), key.alias("key"))
    each = rows.join(plan.select("key", F.expr("cast(copies div n as int)").alias("take")).where("take > 0"), "key")
    rest = plan.select("key", F.expr("cast(copies % n as int)").alias("take")).where("take > 0")
    if not rest.isEmpty():
        each = each.union(rows.join(rest, "key").groupBy("key").agg(F.first("row").alias("row"), F.first("take").alias("take")).select("key", "row", "take"))
    return each.select("row", F.explode(F.sequence(F.lit(1), "take"))).select("row.*")
