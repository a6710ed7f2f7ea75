"""Exact top-k by inner product: a ball tree per shard, branch and bound.

Vectors become integers, floor(scale * x). Each shard's tree holds balls (centre, radius, and the norms and angles
of the rows about the centre); a query takes leaves in order of an upper bound of the inner product and stops below
its current kth score. A block of queries searches at once: queries that come to the same leaf share one matrix
product. The kth score is shared: every query first searches one shard, the kth score found there goes along to all
others, and a task that holds several shards of a block of queries hands it on from shard to shard.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows with a null
vec_id; a repeated vec_id counts once, with its smallest vector; a query meets only vectors of its own length;
empty vectors score 0 with each other; a component that passes a double's range when scaled counts as the largest
double; sums are exact at any size (past 2^53 they are added as Python integers) and ranked exactly, only the
returned score is cut to a long's range; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged

#: Fixed value: rows of a leaf.
LEAF = 64
#: Returned scores are cut to this range; of greater ones REST holds what ranks them.
MOST = (1 << 63) - 2
REST = 1 << 2200

TREE = {"shard": "int", "dim": "int", "small": "int", "ids": "array<long>", "x": "array<double>", "centres": "array<double>", "shapes": "array<double>", "parents": "array<int>", "leaves": "array<int>"}
FOUND = {"block": "int", "dim": "int", "query_id": "long", "ids": "array<long>", "scores": "array<long>", "rests": "array<binary>", "visited": "int", "leaves": "int"}
KINDS = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<binary>": pa.list_(pa.binary())}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {k}" for c, k in columns.items())


def arrow(columns: dict[str, str], rows: list[tuple]) -> pa.RecordBatch:
    values = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, k in zip(values, columns.values(), strict=True)], list(columns))


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<double>): whole numbers, of the vectors that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    top = F.lit(float(np.finfo(float).max))
    scaled = lambda c: F.greatest(F.least(F.lit(float(scale)) * c.cast("double"), top), -top)
    # past 2^52 a double is whole already, and floor() would overflow its long
    whole = F.transform(x, lambda c: F.when(F.abs(scaled(c)) < 2.0**52, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    return rows.select("vec_id", whole.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def is_small(x: np.ndarray) -> np.ndarray:
    """Rows whose inner products with each other are exact in doubles."""
    return np.abs(x).max(1, initial=0.0) ** 2 * max(1, x.shape[1]) < 2.0**53


class BallTree:
    """Balls over the small rows of x, halved at the median along their direction of largest variance down to LEAF
    rows; parents come before their children. Rows that are not small follow, outside the tree."""

    def __init__(self, small, ids, x, centres, shapes, parents, leaves):
        self.small, self.ids, self.x, self.centres, self.shapes, self.parents, self.leaves = small, ids, x, centres, shapes, parents, leaves

    @classmethod
    def built(cls, ids: np.ndarray, x: np.ndarray) -> BallTree:
        fits = is_small(x)
        order, small = np.concatenate([np.flatnonzero(fits), np.flatnonzero(~fits)]), int(fits.sum())
        centres, shapes, parents, leaves, todo = [], [], [], [], [(0, small, -1)] if small else []
        while todo:
            low, high, parent = todo.pop()
            own, at = x[order[low:high]], len(centres)
            centre = own.mean(0)
            away = own - centre
            norms, length = np.sqrt((own * own).sum(1)), float(np.sqrt(centre @ centre))
            round_ = float(np.sqrt((away * away).sum(1).max()))
            cosine = (own @ centre / np.maximum(norms * length, 1e-300)).min() if length and norms.min() > 0 else -1.0
            centres.append(centre)
            shapes.append((round_, norms.min(), norms.max(), max(-1.0, cosine - 1e-9)))
            parents.append(parent)
            if high - low > LEAF and round_ > 0:
                line = away[int(np.argmax((away * away).sum(1)))]
                for _ in range(4):
                    line = away.T @ (away @ line)
                    line = line / max(np.abs(line).max(), 1e-300)
                middle = (high - low) // 2
                order[low:high] = order[low:high][np.argpartition(away @ line, middle)]
                todo += [(low + middle, high, at), (low, low + middle, at)]
            else:
                leaves.append((at, low, high))
        of = lambda v, kind, width: np.array(v, kind).reshape(-1, width)
        return cls(small, ids[order], np.ascontiguousarray(x[order]), of(centres, float, x.shape[1]) if x.shape[1] else np.zeros((len(centres), 0)), of(shapes, float, 4), np.array(parents, np.int32), of(leaves, np.int32, 3))

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, leaves): upper bounds of q's inner products with a leaf's rows; a node's bound holds below it."""
        length = np.sqrt((q * q).sum(1))[:, None]
        size = np.sqrt((self.centres**2).sum(1))
        radius, least, most, narrow = self.shapes.T
        along = q @ self.centres.T
        ball = along + length * radius
        cos = np.clip(along / np.maximum(length * size, 1e-300), -1, 1)
        near = np.where(cos >= narrow, 1.0, cos * narrow + np.sqrt((1 - cos * cos) * (1 - narrow * narrow)))
        cone = length * np.where(near > 0, most, least) * near
        out = np.minimum(ball, cone)
        out += 1 + np.abs(out) * 1e-6 + length * np.maximum(most, size) * 1e-7
        for at, parent in enumerate(self.parents):
            if parent >= 0:
                np.minimum(out[:, at], out[:, parent], out=out[:, at])
        return out[:, self.leaves[:, 0]]

    def search(self, qids: np.ndarray, q: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(scores, ids, visited leaves) of small queries among the small rows: the k best that reach the floor
        (a float, -inf for none); missing ones have score -inf. Leaves below a query's kth score are not visited."""
        scores, ids = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        kth, visited = floors.copy(), np.zeros(len(q), np.int64)
        if not self.small:
            return scores, ids, visited
        bounds = self.bounds(q)
        order = np.argsort(-bounds, 1, kind="stable")
        active = np.arange(len(q))
        for turn in range(order.shape[1]):
            leaf = order[active, turn]
            go = bounds[active, leaf] >= kth[active]  # an equal bound may still hide a smaller vec_id
            active, leaf = active[go], leaf[go]
            if not len(active):
                break
            visited[active] += 1
            for one in np.unique(leaf):
                who, (_, low, high) = active[leaf == one], self.leaves[one]
                found = q[who] @ self.x[low:high].T
                found[self.ids[low:high][None, :] == qids[who][:, None]] = -np.inf
                better = (found >= kth[who][:, None]).any(1)
                who, found = who[better], found[better]
                found[found < kth[who][:, None]] = -np.inf
                both = np.concatenate([scores[who], found], 1)
                names = np.concatenate([ids[who], np.broadcast_to(self.ids[low:high], found.shape)], 1)
                names = np.where(np.isneginf(both), np.iinfo(np.int64).max, names)
                best = np.lexsort((names, -both), axis=1)[:, :k]
                scores[who], ids[who] = np.take_along_axis(both, best, 1), np.take_along_axis(names, best, 1)
                kth[who] = np.maximum(kth[who], scores[who, -1])
        return scores, ids, visited


def exact(q: np.ndarray, qid: int, x: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(score, id) of all rows but the query's own, in whole numbers."""
    whole = [int(c) for c in q]
    return [(sum(a * int(b) for a, b in zip(whole, row, strict=True)), int(i)) for row, i in zip(x, ids, strict=True) if i != qid]


def asked_in(tree: BallTree, qids: np.ndarray, q: np.ndarray, floors: list, k: int) -> list[tuple[int, list[tuple[int, int]], int]]:
    """(query_id, [(score, id)] best first, visited leaves) per query; floors: known kth scores, or None."""
    as_float = lambda s: -np.inf if s is None else float(s) if abs(s) < 2**53 else np.nextafter(float(s), -np.inf)
    fits, out = is_small(q), []
    at = np.flatnonzero(fits)
    scores, ids, visited = tree.search(qids[at], q[at], np.array([as_float(floors[i]) for i in at]), k)
    of = dict(zip(at.tolist(), range(len(at)), strict=True))
    for i, qid in enumerate(qids.tolist()):
        if i in of:
            rows = [(int(s), int(v)) for s, v in zip(scores[of[i]], ids[of[i]], strict=True) if s > -np.inf]
            rows += exact(q[i], qid, tree.x[tree.small :], tree.ids[tree.small :])
        else:
            rows = exact(q[i], qid, tree.x, tree.ids)
        rows = [r for r in rows if floors[i] is None or r[0] >= floors[i]]
        out.append((qid, sorted(rows, key=lambda r: (-r[0], r[1]))[:k], int(visited[of[i]]) if i in of else len(tree.leaves)))
    return out


def top_k(vectors: DataFrame, k: int = 10, **options) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores against all other rows, ties to smaller vec_id."""
    found = shard_results(vectors, k=k, **options).select("query_id", F.explode(F.arrays_zip("ids", "scores", "rests")).alias("x")).select("query_id", "x.*")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(-F.col("scores"), "rests", "ids"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)  # reduced to k rows a query before the shuffle
    return ranked.select("query_id", "rank", F.col("ids").alias("vec_id"), F.col("scores").alias("score"))


def shard_results(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, scale: int = 1024, shard_rows: int = 8192, block_rows: int = 256, span_blocks: int = 64) -> DataFrame:
    """(block, dim, query_id, ids, scores, rests, visited, leaves): each query's best rows of each shard, best first,
    and how many of the shard's leaves it visited.

    Queries are rows themselves, chosen by the SQL predicate. They travel in blocks, one row of arrays per block
    and shard; trees are built once, one row each, and copied once per span_blocks blocks, so nothing is broadcast
    or collected.
    """
    rows = staged(integers(vectors, scale))
    n = rows.count()
    shards, blocks = max(1, -(-n // shard_rows)), max(1, -(-rows.where(queries).count() // block_rows))
    pack = lambda df, name, count: df.groupBy(
        F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias(name), F.size("v").alias("dim")
    ).agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
    shard, block = pack(rows, "shard", shards), pack(rows.where(queries), "block", blocks)

    def plant(batches):
        for b in batches:
            for i, (number, dim) in enumerate(zip(b.column("shard").to_pylist(), b.column("dim").to_pylist(), strict=True)):
                ids = b.column("ids")[i].values.to_numpy()
                t = BallTree.built(ids, b.column("x")[i].values.to_numpy().reshape(len(ids), dim))
                yield arrow(TREE, [(number, dim, t.small, t.ids, t.x.ravel(), t.centres.ravel(), t.shapes.ravel(), t.parents, t.leaves.ravel())])

    trees = staged(shard.select("shard", "dim", F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("x")).mapInArrow(plant, ddl(TREE)))
    asked = staged(block.select("block", "dim", F.col("rows.vec_id").alias("qids"), F.flatten("rows.v").alias("q")))

    first = asked.withColumn("shard", F.pmod("block", F.lit(shards))).withColumn("floor", F.lit(None).cast("array<long>"))
    lows = staged(searched(first, trees, k, span_blocks))
    # the kth score of each query after its first shard, a lower bound for all others
    own = F.when((F.size("scores") >= k) & (F.element_at("scores", -1) > -MOST), F.element_at("scores", -1))
    known = lows.groupBy("block", "dim").agg(F.sort_array(F.collect_list(F.struct("query_id", own.alias("low")))).alias("low"))
    known = known.select("block", "dim", F.col("low.low").alias("floor"))
    others = asked.join(known, ["block", "dim"], "left")
    others = others.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("shard") != F.pmod("block", F.lit(shards)))
    return lows.union(searched(others, trees, k, span_blocks))


def searched(asked: DataFrame, trees: DataFrame, k: int, span_blocks: int) -> DataFrame:
    """FOUND rows of each query in the shard that its block asks.

    A tree travels once to each span of blocks that asks it, ahead of these blocks, which stream by.
    """
    parts = [c for c in TREE if c not in ("shard", "dim")]

    def of(batches):
        key_of, tree, best_of = None, None, {}
        for b in batches:
            out = []
            array = lambda c, i: b.column(c)[i].values.to_numpy()
            for i, (shard, dim, block) in enumerate(zip(*[b.column(c).to_pylist() for c in ("shard", "dim", "block")], strict=True)):
                if block is None:
                    small, *held = [b.column("small")[i].as_py(), *(array(c, i) for c in parts[1:])]
                    ids, x, centres, shapes, parents, leaves = held
                    key_of, tree = (shard, dim), BallTree(small, ids, x.reshape(len(ids), dim), centres.reshape(len(parents), dim), shapes.reshape(-1, 4), parents, leaves.reshape(-1, 3))
                    continue
                if key_of != (shard, dim):
                    continue  # no row of this length in the shard
                qids = array("ids", i)
                known = b.column("floor")[i].as_py() or [None] * len(qids)
                floors = [max((s for s in (low, best_of.get(qid)) if s is not None), default=None) for qid, low in zip(qids.tolist(), known, strict=True)]
                for qid, rows, visited in asked_in(tree, qids, array("x", i).reshape(len(qids), dim), floors, k):
                    if len(rows) == k:
                        best_of[qid] = max(rows[-1][0], best_of.get(qid, rows[-1][0]))
                    cut = [min(max(s, -MOST), MOST) for s, _ in rows]
                    rests = [b"" if abs(s) < MOST else (REST - s).to_bytes(276, "big") for s, _ in rows]
                    out.append((block, dim, qid, [v for _, v in rows], cut, rests, visited, len(tree.leaves)))
            yield arrow(FOUND, out)

    asked = asked.withColumn("span", F.expr(f"cast(block div {span_blocks} as int)"))
    held = trees.join(asked.select("shard", "dim", "span").distinct(), ["shard", "dim"])
    place, none = ["shard", "span", "dim"], lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows = held.select(*place, none("int", "block"), *parts, none("array<long>", "floor"))
    of_query = {"ids": F.col("qids").alias("ids"), "x": F.col("q").alias("x")}
    rows = rows.union(asked.select(*place, "block", *[of_query.get(c, none(TREE[c], c)) for c in parts], "floor"))
    dealt = rows.repartition("shard", "span").sortWithinPartitions(*place, F.col("block").asc_nulls_first())
    return dealt.mapInArrow(of, ddl(FOUND))
