"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A labelled good document is preferred to a labelled bad one; the chance of that is the logistic of the difference
of their scores, a score being linear in features of the text. The threshold is the quantile of the training
scores at the share of bad documents; there a document's final score is exactly `cut`.

Edge cases: a null text is an empty one; without labels of both kinds every score is the share of good labels
(1 without labels); labels that are null or neither 0 nor 1, and labels without a document, are left out; a doc_id
with several labels counts as the worst; a null doc_id is held out; an empty table gives an empty result. Input
columns named held_out, score or predicted are replaced.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import nested, parts

#: Bytes whose shares are features, each a group of its own.
GROUPS = [b"!?", b"|", b"#", b"$", b"%", b"&", b"*", b".", b",;:", b"0123456789", b"<>{}[]()=_\\/~^@+", b"\"'-", b"\n", b" \t\r"]
_OF = np.full(256, len(GROUPS) + 3)
for _i, _g in enumerate(GROUPS):
    _OF[list(_g)] = _i
_OF[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = len(GROUPS)
_OF[list(b"abcdefghijklmnopqrstuvwxyz")] = len(GROUPS) + 1
_OF[128:] = len(GROUPS) + 2


def features(text: str | None) -> np.ndarray:
    """Of the whole text: lengths, repetition, and shares of kinds of bytes, plain and as square roots."""
    data = (text or "").encode()
    n = max(len(data), 1)
    kinds = np.bincount(_OF, np.bincount(np.frombuffer(data, np.uint8), minlength=256), len(GROUPS) + 4)
    found = data.split()
    m = max(len(found), 1)
    upper = kinds[len(GROUPS)]
    shares = np.append(kinds / n, upper / max(upper + kinds[len(GROUPS) + 1], 1))
    own = [math.log1p(len(found)), n / m / 10, len(set(found)) / m, sum(map(eq, found, found[1:])) / m, float(not found)]
    return np.concatenate([own, shares, np.sqrt(shares)])


WIDTH = len(features(""))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int, seed: int) -> DataFrame:
    """(doc_id, quality, features) of at most `most` labelled documents that are not held out, chosen by hash."""
    chosen = labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(most)

    def of(batches):
        for b in parts(batches):
            rows = [features(t).tolist() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "quality", "features"])

    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most `most` rows of two numbers
    rows = joined.select("doc_id", F.col("quality").cast("int"), "text").mapInArrow(of, "doc_id long, quality int, features array<double>")
    return rows.groupBy("doc_id", "quality").agg(F.min("features").alias("features"))  # a repeated doc_id counts once


def fit(x: np.ndarray, good: np.ndarray, pairs: int, ridge: float, cut: float, seed: int) -> dict:
    """Newton steps on the mean logistic loss of score differences over random (good, bad) pairs."""
    a, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(a) or not len(b):
        return {"weights": None, "constant": float(good.mean()) if len(good) else 1.0}
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    z, rng = (x - mean) / scale, np.random.default_rng(seed)
    d = z[rng.choice(a, pairs)] - z[rng.choice(b, pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # chance that the pair is ranked wrongly
        step = np.linalg.solve((d.T * (p * (1 - p))) @ d / pairs + ridge * np.eye(len(w)), d.T @ p / pairs - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    s = np.sort(z @ w)
    k = len(b)
    return {"weights": w / scale, "shift": float(mean @ (w / scale)) + (s[k - 1] + s[k]) / 2 - math.log(cut / (1 - cut)), "constant": None}


def quality_scores(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, pairs: int = 60_000, ridge: float = 1e-3, cut: float = 0.3, seed: int = 5) -> DataFrame:
    """docs plus held_out, score (0 to 1) and predicted (score >= cut); see scored()."""
    rows = scored(nested(docs, ("held_out", "score", "predicted")), docs, labels, max_labels, pairs, ridge, cut, seed)
    made = rows.select("row.*", "score", held_out(F.col("row.doc_id")).alias("held_out"))
    return made.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, max_labels: int = 20_000, pairs: int = 60_000, ridge: float = 1e-3, cut: float = 0.3, seed: int = 5) -> DataFrame:
    """The rows of docs with a score of cut or more, unchanged."""
    return scored(nested(docs), docs, labels, max_labels, pairs, ridge, cut, seed).where(F.col("score") >= cut).select("row.*")


def scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, max_labels: int, pairs: int, ridge: float, cut: float, seed: int) -> DataFrame:
    """rows (column `row`, with a text) plus their score, by a model of docs and labels.

    max_labels bounds the labelled rows that the model is fitted on (on the driver: max_labels rows of some 40
    numbers); every document is scored.
    """
    known = sorted(training_rows(docs, labels, max_labels, seed).collect())
    x = np.array([r.features for r in known]).reshape(len(known), WIDTH)
    model = fit(x, np.array([r.quality == 1 for r in known], bool), pairs, ridge, cut, seed)

    def score(batches):
        for b in parts(batches):
            texts = b.column("row").field("text").to_pylist()
            if model["weights"] is None:
                s = np.full(len(texts), model["constant"])
            else:
                x = np.array([features(t) for t in texts]).reshape(len(texts), WIDTH)
                s = 1 / (1 + np.exp(-np.clip((x * model["weights"]).sum(1) - model["shift"], -700, 700)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    return rows.mapInArrow(score, StructType([*rows.schema.fields]).add("score", "double"))
