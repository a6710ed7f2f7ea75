"""A corpus pipeline of five operators: quality, line dedup, near-dedup, source mix, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet to the
shared folder and hands what it reads back to the next stage. All stages but the last return docs' own columns, of any
name; the last one returns (doc_id, n_tokens, ids_sha256, decoded_sha256, ids).

Edge cases: a null text is an empty one, and the classifier, which sees all texts as they are, decides on it; after line
dedup it is empty, not null. A null doc_id takes part in each stage. Rows that are equal are documents of their own up
to near-dedup, which keeps one of them. Long texts stay whole. An empty table gives an empty result. A table without
n_chars, lang or further columns is taken as it is; doc_id, text and source are needed.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arealoom.llm import lines, mixing, quality, queries, simhash
from arealoom.llm.shared import shared_folder, table

def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay only where they occur first; n_chars follows the text."""
    rows = lines.dedup_lines(docs, min_docs=10, keep_first=True, counts=False)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return simhash.without_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the source mix takes it."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids with their count and digest, and the digest of the bytes they decode to."""
    return queries.bpe_digests(spark, docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [("quality", keep_quality), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_copies), ("mix", mix), ("byte_bpe", tokenize)]

#: SQL has neither the trained scores nor XXH64 fingerprints: run() is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
