"""WARC archives written and read by Spark, with boundary-chain verification.

Writing: one record per page, in files of the tasks that write them. Of equal payloads of at least `least` bytes
the page with the smallest id is a response, the others are revisits of it.

Reading: the text source splits files at the magic line that starts a record, so each of its rows is a candidate,
and the running total of row lengths gives offsets. A candidate's Content-Length points to its successor. Chains
are followed by pointer jumping, first within each block of a file (a task each), then across blocks from offset 0;
only candidates on that chain are records. A magic line inside a payload is not, and its rows are put back into the
payload around them.

Edge cases: a null html is an empty payload; a null url is left out; a null page_id is written as null and reads
back as null, and is never a response to others; rows with the same page_id and payload are all responses or all
revisits; a payload is one row, so 2 GB is its end; payloads may hold any text, also whole records; an empty table gives no records. Other columns are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import running_total, staged

#: Fixed values of the format.
MAGIC, CRLF = "WARC/1.0\r\n", "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    again = staged(revisits(rows.select("page_id", "payload_digest", "payload_bytes"), least))
    rows = rows.join(again, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("_first").isNotNull()
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first")).alias("refers_to"))


def revisits(light: DataFrame, least: int) -> DataFrame:
    """(_page, _digest, _first): the pages that revisit page _first, decided without their payloads.

    Pages are joined to it by id and digest, so that many copies of one payload are as many keys.
    """
    light = staged(light.where(F.col("payload_bytes") >= least).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")))
    firsts = light.groupBy("_digest").agg(F.min("_page").alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _first is not null")
    return light.join(firsts.drop("_n"), "_digest").where(~F.col("_page").eqNullSafe(F.col("_first"))).select("_page", "_digest", "_first").distinct()


def write_warc(pages: DataFrame, path: str, least: int = 100) -> None:
    """One record per page below path. The text writer ends each row with the separator, so a row is a record
    without its last line end."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    record = F.concat(head, F.when(revisit, F.lit("")).otherwise(F.col("payload")), F.lit(CRLF))
    page_records(pages, least).select(record.alias("value")).write.option("lineSep", CRLF).text(path)


def field(name: str, kind: str = r"[^\r\n]*") -> Column:
    found = F.regexp_extract("head", rf"(?i)(?:^|\n){name}:[ \t]*({kind})", 1)
    return F.when(found != "", found)


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, nth, value, bytes): what lies between magic lines; nth orders the rows of a block."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return rows.select(*place, F.monotonically_increasing_id().alias("nth"), "value", F.octet_length("value").cast("long").alias("bytes"))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per magic line (and per file start): file, block, at (its offset), next (the offset that its
    Content-Length leads to, null without one), its header fields, and its own payload where that is whole."""
    end = len(MAGIC)
    rows = scanned(spark, path).withColumn("head", F.substring_index("value", CRLF * 2, 1))
    rows = rows.withColumn("body", F.octet_length("head").cast("long") + 4)
    rows = rows.withColumn("length", F.when(F.col("body") <= F.col("bytes"), field("Content-Length", r"\d{1,18}").try_cast("long")))
    whole = F.col("body") + F.col("length") <= F.col("bytes")
    payload = F.substring(F.col("value").cast("binary"), (F.col("body") + 1).cast("int"), F.col("length").cast("int"))
    light = rows.select(
        "file", "block", "nth", (F.col("bytes") + end).alias("span"), "body", "length",
        field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers"),
        field("WARC-Payload-Digest").alias("digest"), field("WARC-Payload-Length", r"\d{1,18}").alias("payload_length"),
        F.when(whole, F.sha2(payload, 256)).alias("sha256"),
    )
    light = running_total(staged(light), ["file"], "block", [F.col("nth")], "span", "start").drop("nth")
    light = light.withColumn("at", F.col("start") - end)  # the row before the first magic line of a file is at -end
    return light.withColumn("next", F.col("at") + end + F.col("body") + F.col("length") + 4)


def chained(found: DataFrame) -> DataFrame:
    """found plus on_chain: whether the chain from the file's start reaches the candidate."""
    found = staged(found)

    def groups(batches):
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns], strict=True))
        for key, group in groupby(rows, lambda r: r[:2]):
            file_block_rows = list(group)
            at = np.array([r[2] for r in file_block_rows])
            to = np.array([-1 if r[3] is None else r[3] for r in file_block_rows])
            where = np.minimum(np.searchsorted(at, to), len(at) - 1)
            yield key, at, to, np.where((at[where] == to) & (to > at), where, np.arange(len(at))), [r[4] for r in file_block_rows]

    def exits(batches):
        for key, at, to, step, _ in groups(batches):
            while (step[step] != step).any():  # jumps double until each candidate knows the last of its chain here
                step = step[step]
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at)), pa.array(at), pa.array(to[step])], ["file", "at", "to"])

    def reached(batches):
        for key, at, _, step, entry in groups(batches):
            true = np.array(entry, bool)
            for i in np.flatnonzero(true):
                while not true[j := step[i]]:
                    true[j], i = True, j
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(at)), pa.array(at), pa.array(true)], ["file", "at", "on_chain"])

    light = found.select("file", "block", "at", "next")
    by_block = lambda df: df.repartition("file", "block").sortWithinPartitions("file", "block", "at")
    jump = staged(by_block(light.withColumn("entry", F.lit(False))).mapInArrow(exits, "file string, at long, to long"))
    starts = light.where("at = 0").select("file", "at")
    entries, n = staged(starts), -1
    while (now := entries.count()) != n:
        n = now
        step = entries.join(jump, ["file", "at"]).select("file", F.col("to").alias("at")).join(jump.select("file", "at"), ["file", "at"])
        entries = staged(entries.union(step).distinct())
        far = jump.select("file", F.col("at").alias("from"), F.col("to").alias("at")).join(jump, ["file", "at"], "left")
        jump = staged(far.select("file", F.col("from").alias("at"), F.coalesce("to", F.col("at")).alias("to")))
    marked = light.join(entries.withColumn("entry", F.lit(True)), ["file", "at"], "left").select("file", "block", "at", "next", F.coalesce("entry", F.lit(False)).alias("entry"))
    true = by_block(marked).mapInArrow(reached, "file string, at long, on_chain boolean")
    return found.join(true, ["file", "at"])


def records(spark: SparkSession, path: str) -> DataFrame:
    """The archives' records: file, at, header fields, length and sha256 of what follows the header."""
    rows = staged(chained(candidates(spark, path)))
    true = rows.where("on_chain")
    parts = true.where("length is not null and sha256 is null")
    if parts.isEmpty():
        return true
    put = payloads(spark, path, rows, parts.select("file", "at")).select("file", "at", F.sha2("payload", 256).alias("_sha256"))
    true = true.join(put, ["file", "at"], "left").withColumn("sha256", F.coalesce("sha256", "_sha256"))
    return true.drop("_sha256")


def payloads(spark: SparkSession, path: str, rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(file, at, payload binary) of the wanted (file, at) records; rows: all candidates with their `on_chain`.

    The rows of a record are its own and those of the false candidates up to the next true one.
    """
    own = F.max(F.when(F.col("on_chain"), F.col("at"))).over(Window.partitionBy("file", "block").orderBy("at"))
    per = rows.groupBy("file", "block").agg(F.max(F.when(F.col("on_chain"), F.col("at"))).alias("last"))
    before = F.max("last").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    per = per.select("file", "block", before.alias("carry"))
    owner = rows.withColumn("own", own).join(per, ["file", "block"]).select("file", F.col("at").alias("row_at"), F.coalesce("own", "carry").alias("at"))
    owner = staged(owner.join(wanted, ["file", "at"]))
    files = owner.select("file").distinct()
    texts = scanned(spark, path).join(files, "file", "left_semi").withColumn("span", F.col("bytes") + len(MAGIC))
    texts = running_total(texts, ["file"], "block", [F.col("nth")], "span", "start").select("file", (F.col("start") - len(MAGIC)).alias("row_at"), "value")
    put = texts.join(owner, ["file", "row_at"]).groupBy("file", "at").agg(F.sort_array(F.collect_list(F.struct("row_at", "value"))).alias("v"))
    whole = put.select("file", "at", F.array_join("v.value", MAGIC).cast("binary").alias("value"))
    sizes = rows.where("on_chain").select("file", "at", "body", "length")
    return whole.join(sizes, ["file", "at"]).select("file", "at", F.substring("value", (F.col("body") + 1).cast("int"), F.col("length").cast("int")).alias("payload"))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives say; a response's bytes and
    digest are those of the payload that was read."""
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("long")
    revisit = F.col("type") == "revisit"
    return records(spark, path).select(
        page("id").alias("page_id"),
        F.when(revisit, F.col("payload_length").try_cast("long")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace("digest", "^sha256:", "")).otherwise(F.col("sha256")).alias("payload_digest"),
        F.col("type").alias("record_type"),
        F.when(revisit, page("refers")).alias("refers_to"),
    )
