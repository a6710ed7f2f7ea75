"""Sharding by a two-pass external shuffle, in DataFrame operations only.

Pass one scatters the records into memory-sized buckets by a seeded hash; pass two shuffles each bucket in memory
(Spark's `shuffle` is a Fisher-Yates walk). The buckets in turn are one random order of all records, which is cut
into shards of equal counts.

Edge cases: a null text has no bytes and the CRC of an empty text; records that are equal in every column are
records of their own; columns may be of any type, maps too (hashed as JSON); an empty table gives an empty result. Input columns named like an added one (ADDED) are
replaced, all others come through unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, staged

ADDED = ["size", "text_crc32", "shard", "slot"]


def shuffled_shards(docs: DataFrame, shards: int = 16, seed: int = 29, bucket_bytes: int = 8 << 20, most_tasks: int = 100_000) -> DataFrame:
    """The whole records of docs plus size, text_crc32, shard and slot: a seeded random order in `shards` parts.

    Counts of shards differ by one at most, slots have no gaps. bucket_bytes bounds what one task holds at once
    (a single longer record is a bucket by itself). Past most_tasks buckets a task takes several, one after the other
    in order; Spark holds at most 128 of them before it goes over to sorting.
    """
    kept = [c for c in docs.columns if c not in ADDED]
    # a record's own columns are nested, so that they clash with none of the names below
    size, crc = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1, F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    hashed = [F.to_json(F.struct(quoted(c))) if "map<" in docs.schema[c].dataType.simpleString() else quoted(c) for c in kept if c != "text"]
    key = F.xxhash64(F.lit(seed), *hashed, crc)
    rows = docs.select(F.struct(*map(quoted, kept)).alias("record"), size.alias("size"), crc.alias("text_crc32"), key.alias("key"))
    rows = _spread(rows, bucket_bytes // 4)
    total = rows.agg(F.count("*"), F.sum("size")).first()
    n, buckets = total[0], max(1, math.ceil((total[1] or 0) / bucket_bytes))
    rows = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    starts = staged(rows.groupBy("bucket").count()).select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    scattered = rows.repartition(min(buckets, most_tasks), "bucket").sortWithinPartitions("bucket", "key")
    whole = F.struct("record", "size", "text_crc32")
    walked = scattered.groupBy("bucket").agg(F.collect_list(whole).alias("all")).select("bucket", F.shuffle("all", F.lit(seed)).alias("all"))
    walked = walked.join(starts, "bucket").select("start", F.posexplode("all").alias("at", "one"))
    walked = walked.select("one", (F.col("start") + F.col("at")).alias("place"))
    walked = walked.select("one", "place", F.expr(f"cast(place * {shards} div {max(n, 1)} as int)").alias("shard"))
    first = F.expr(f"(shard * {n}L + {shards - 1}) div {shards}")
    return walked.select("one.record.*", "one.size", "one.text_crc32", "shard", (F.col("place") - first).alias("slot"))


def _spread(rows: DataFrame, most_bytes: int) -> DataFrame:
    """rows, where records under one key that take over most_bytes get keys by their number among equal records.

    Equal records are interchangeable, so they are counted (in part before the shuffle) and numbered from the count:
    the same rows have the same keys at each evaluation, in whatever order they come.
    """
    heavy = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where((F.col("n") > 1) & (F.col("bytes") > most_bytes))
    heavy = staged(heavy.select("key"))  # as many as a few for each bucket
    if heavy.isEmpty():
        return rows
    equal = rows.join(heavy, "key", "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    numbered = equal.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("key", F.xxhash64("key", "i"))
    return rows.join(heavy, "key", "left_anti").select(*rows.columns).union(numbered.select(*rows.columns))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; each file holds the rows of a task's buckets in order of slot, which stays a column."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
