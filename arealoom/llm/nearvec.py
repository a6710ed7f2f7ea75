"""Embedding near-dedup by cross-polytope hashing.

A hash rotates a vector (three rounds of random signs and fast Hadamard transform) and names the closest of the
2d points +-e_i. A table's key is `depth` hashes; a vector lies in its own bucket of each table and probes the
buckets of its next-best points. Vectors that meet in a bucket are candidates, and cosine decides.

Equal vectors are one node from the start. A pair is counted in the first bucket where it meets, which both sides
know from their keys, so buckets send counts and spanning forests instead of pairs. A bucket of more than
`bucket_rows` rows is cut into blocks, and each pair of blocks is a task of its own: large buckets are whole.

Edge cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of
different lengths do not link; a null vec_id takes part and is never the smallest; repeated rows are vectors of
their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, find, staged, unite


def rotations(dim: int, count: int, seed: int) -> tuple[int, np.ndarray]:
    """The padded power of two and the random signs, (count, 3, padded)."""
    padded = 1 << max(1, (dim - 1).bit_length())
    return padded, np.random.default_rng([seed, dim]).choice([-1.0, 1.0], (count, 3, padded))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


def bucket_keys(x: np.ndarray, tables: int, depth: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) keys of unit vectors: the own bucket first, then those of the smallest losses.

    A point's loss is how far its coordinate falls short of the best; a probe changes one hash or two.
    """
    padded, signs = rotations(x.shape[1], tables * depth, seed)
    x = np.pad(x, ((0, 0), (0, padded - x.shape[1])))
    out = np.zeros((len(x), tables, 1 + probes), np.int64)
    near = min(2 * padded, 1 + probes)
    for t in range(tables):
        best, loss = [], []
        for k in range(depth):
            y = x
            for s in signs[t * depth + k]:
                y = hadamard(y * s)
            both = np.concatenate([y, -y], 1)
            top = np.argpartition(-both, near - 1, 1)[:, :near]
            value = np.take_along_axis(both, top, 1)
            order = np.lexsort((top, -value), axis=1)
            top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
            best.append(top)
            loss.append(value[:, :1] - value)
        code, cost = best[0].astype(np.int64), loss[0]
        for top, extra in zip(best[1:], loss[1:], strict=True):
            code = (code[:, :, None] * (2 * padded) + top[:, None, :]).reshape(len(x), -1)
            cost = (cost[:, :, None] + extra[:, None, :]).reshape(len(x), -1)
            order = np.argsort(cost, 1, kind="stable")[:, :near]
            code, cost = np.take_along_axis(code, order, 1), np.take_along_axis(cost, order, 1)
        out[:, t, : code.shape[1]] = code[:, : 1 + probes]
        out[:, t, code.shape[1] :] = -1
    return out


def packed_keys(keys: np.ndarray, dim: int, depth: int) -> list[bytes]:
    return [k.tobytes() for k in keys.reshape(len(keys), -1).astype(key_type(dim, depth))]


def key_type(dim: int, depth: int) -> str:
    """The narrowest type that holds every key: there are (2 * padded) ** depth."""
    most = (2 * rotations(dim, 0, 0)[0]) ** depth
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def packed_vector(v: np.ndarray) -> bytes:
    """Single precision if that loses nothing."""
    with np.errstate(over="ignore", under="ignore"):
        short = v.astype("<f4")
    return short.tobytes() if (short.astype(float) == v).all() else v.astype("<f8").tobytes()


def units(vs: list[bytes], dim: int) -> np.ndarray:
    v = np.array([np.frombuffer(b, "<f4" if len(b) == 4 * dim else "<f8") for b in vs], float)
    v = v / np.abs(v).max(1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def near_vectors(vectors: DataFrame, least: float = 0.9, tables: int = 8, depth: int = 2, probes: int = 7, bucket_rows: int = 2048, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of vectors (vec_id, embedding)."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))) | ~F.exists("v", lambda c: c != 0)
    rows = vectors.select("vec_id", x.alias("v")).withColumn("v", F.when(F.col("v").isNotNull() & ~bad, F.transform("v", lambda c: c + F.lit(0.0))))
    # classes of equal vectors; the key is the text of the vector's numbers, hashed
    rows = rows.withColumn("class_key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256)))
    classes = rows.where("class_key is not null").groupBy("class_key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.min("v").alias("v"))
    for attempt in count():  # until no two classes share a number
        numbered = staged(classes.select("class_key", F.xxhash64(F.lit(attempt), "class_key").alias("node"), "copies", "least", "v"))
        if numbered.groupBy("node").count().where("count > 1").isEmpty():
            break
    classes = numbered
    met = buckets(classes, tables, depth, probes, seed)
    seen = staged(pair_counts(met, least, tables, depth, bucket_rows))
    counts = seen.groupBy("node").agg(F.sum("links").alias("links"))
    of = components(seen.where("hub is not null").select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("node", "_node")
    labelled = classes.select("class_key", "node", "copies", "least").join(of, F.col("node") == F.col("_node"), "left").withColumn("component", F.coalesce("component", "node"))
    labelled = labelled.drop("_node").join(counts, "node", "left")
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    per = staged(labelled.join(smallest, "component").select(F.col("class_key").alias("_key"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    joined = rows.select("vec_id", "class_key").join(per, F.col("class_key") == F.col("_key"), "left")
    component = F.when(F.col("_key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def buckets(classes: DataFrame, tables: int, depth: int, probes: int, seed: int) -> DataFrame:
    """(tab, bucket, own, node, copies, dim, keys, v): a row for each bucket where a class lies (own) or probes.
    keys are all its bucket keys, table by table, and v its numbers, both packed."""

    def of(batches):
        for b in batches:
            vs, ids, copies = b.column("v").to_pylist(), b.column("node").to_numpy(), b.column("copies").to_numpy()
            for dim in {len(v) for v in vs}:
                at = [i for i, v in enumerate(vs) if len(v) == dim]
                own = [packed_vector(np.array(vs[i], float)) for i in at]
                keys = bucket_keys(units(own, dim), tables, depth, probes, seed)
                for i, v, k, p in zip(at, own, keys, packed_keys(keys, dim, depth), strict=True):
                    yield int(ids[i]), int(copies[i]), dim, k.ravel().tolist(), p, v

    def batches_of(batches):
        out = []
        for row in of(batches):
            out.append(row)
            if len(out) >= 1000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(out):
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["node", "copies", "dim", "buckets", "keys", "v"])

    rows = staged(classes.select("node", "copies", "v").mapInArrow(batches_of, "node long, copies long, dim int, buckets array<long>, keys binary, v binary"))
    rows = rows.select("node", "copies", "dim", "keys", "v", F.posexplode("buckets").alias("place", "bucket")).where("bucket >= 0")
    width = 1 + probes
    return rows.select(F.expr(f"cast(place div {width} as int)").alias("tab"), "bucket", (F.col("place") % width == 0).alias("own"), "node", "copies", "dim", "keys", "v")


def pair_counts(met: DataFrame, least: float, tables: int, depth: int, bucket_rows: int) -> DataFrame:
    """(node, links, hub): links found first in one bucket, and a node that it links to, by bucket and block pair."""
    large = staged(met.groupBy("tab", "bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows))
    large = large.select(F.col("tab").alias("_tab"), F.col("bucket").alias("_bucket"), F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
    rows = met.join(large, (F.col("tab") == F.col("_tab")) & (F.col("bucket") == F.col("_bucket")), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    cell = ["tab", "bucket", "low", "high"]

    def of(batches):
        def cells():
            held, key = [], None
            for b in batches:
                for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    if row[:4] != key and held:
                        yield key, held
                        held = []
                    key = row[:4]
                    held.append(row[4:])
            if held:
                yield key, held

        for (tab, bucket, low, high), rows in cells():
            if len(rows) < 2:
                continue
            out = linked(tab, bucket, low, high, rows, least, tables, depth)
            if len(out[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["node", "links", "hub"])

    columns = [*cell, "block", "own", "node", "copies", "dim", "keys", "v"]
    dealt = rows.select(*columns).repartition(*cell).sortWithinPartitions(*cell, "node")
    return dealt.mapInArrow(of, "node long, links long, hub long")


def linked(tab, bucket, low, high, rows, least, tables, depth):
    """node, links and hub arrays of one cell; rows: (block, own, node, copies, dim, keys, v)."""
    block, own, node, copies, lengths = (np.array([r[i] for r in rows]) for i in range(5))
    links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for dim in set(lengths.tolist()):
        at = np.flatnonzero(lengths == dim)
        if len(at) < 2 or not own[at].any():
            continue
        v = units([rows[i][6] for i in at], dim)
        keys = np.frombuffer(b"".join(rows[i][5] for i in at), key_type(dim, depth)).reshape(len(at), tables, -1)
        for start in range(0, len(at), 512):
            part = slice(start, start + 512)
            near = v[part] @ v.T >= least
            i, j = np.nonzero(near)
            i = i + start
            good = (i < j) & (own[at[i]] | own[at[j]])
            if low != high:
                good &= block[at[i]] != block[at[j]]
            i, j = i[good], j[good]
            # the pair counts here if it meets in no earlier table, nor in a smaller bucket of this one
            first = np.ones(len(i), bool)
            for t in range(tab + 1):
                a, b = keys[i, t], keys[j, t]
                hit_a, hit_b = (b == a[:, :1]).any(1), (a == b[:, :1]).any(1)  # b probes a's bucket; a probes b's
                if t < tab:
                    first &= ~(hit_a | hit_b)
                else:
                    first &= ~(hit_a & (a[:, 0] < bucket)) & ~(hit_b & (b[:, 0] < bucket))
            i, j = at[i[first]], at[j[first]]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            unite(root, i, j)
    top, found = find(root, np.arange(len(rows))), links > 0
    hub = [int(node[t]) if t != i else None for i, t in enumerate(top.tolist()) if found[i]]
    return node[found], links[found], hub
