"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into two segments. Of at most three differing bits, one segment has at most one, so
two linked fingerprints agree in a segment with one bit wiped out. Each different fingerprint is indexed under its
64 such variants; fingerprints that meet under a variant are compared.

Documents of equal fingerprint are one node from the start, and each variant's fingerprints give a spanning forest
of their links, so large groups of copies never become pairs.

Edge cases: a text without words (null, empty, blank) has fingerprint zero and links like any other; a null doc_id
takes part and is never the smallest, unless its component has no other; repeated rows are documents of their own;
an empty table gives an empty result; very long texts are hashed in steps of 65,536 shingles; a doc_id that is no long
is an error before any job. near_copies() returns its own columns only, without_near_copies() all columns of
docs unchanged, whatever their names.
"""

from __future__ import annotations

from hashlib import md5
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, find, needs_long, parts, quoted, staged, unite

#: Fixed value: fingerprints under one variant up to which all are compared with all in the task that reads them.
DIRECT = 4096


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of all shingles (bytes.lower() and split() know ASCII only)."""
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= width:
        return hashed(joined, seed)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *(e + 1 for e in ends)]
    n = len(found) - width + 1
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = [hashed(joined[a:b], seed) for a, b in zip(starts[at : min(at + (1 << 16), n)], ends[at + width - 1 :])]
        counts += np.unpackbits(np.array(part, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_md5, fp): the fingerprint as a signed long."""

    def of(batches):
        for b in parts(batches):
            texts = b.column("text").to_pylist()
            fps = np.array([fingerprint(t, width, seed) for t in texts], np.uint64)
            digests = [md5((t or "").encode()).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(digests, pa.string()), pa.array(fps.view(np.int64))], ["doc_id", "text_md5", "fp"])

    return docs.select("doc_id", "text").mapInArrow(of, "doc_id long, text_md5 string, fp long")


def forest(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links (larger, smallest fingerprint) that span each component of `fps` under at most `most` differing bits:
    each fingerprint is compared with all that are not yet reached."""
    left, out = fps, []
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = np.bitwise_count(left ^ front.pop()) <= most
            out += [(int(x), int(root)) for x in left[near]]
            front += list(left[near])
            left = left[~near]
    return out


def flipped(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """As forest(), for three differing bits at most, in work linear in the fingerprints.

    Links of one bit are looked up as such. Fingerprints that are one flip (or none) from the same value are within two bits of each other; one that is
    two flips from it is within three of them. Every link of three bits or fewer has such a value.
    """
    spread = int(np.bitwise_or.reduce(fps ^ fps[0]))
    flips = np.array([1 << b for b in range(64) if spread >> b & 1], np.uint64)
    root = np.arange(len(fps))

    everyone = np.arange(len(fps))
    if most < 2:
        order = np.argsort(fps)
        for f in flips if most else []:
            at = order[np.minimum(np.searchsorted(fps, fps ^ f, sorter=order), len(fps) - 1)]
            hit = fps[at] == fps ^ f
            unite(root, everyone[hit], at[hit])
        return spanning(fps, root)
    values, owner = np.concatenate([fps, *(fps ^ f for f in flips)]), np.tile(everyone, len(flips) + 1)
    order = np.lexsort((owner, values))
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    head = owner[first]
    unite(root, owner, np.repeat(head, np.diff(np.append(first, len(values)))))
    values = values[first]
    if most > 2:
        for i, f in enumerate(flips):
            for g in flips[:i]:
                z = fps ^ f ^ g
                at = np.minimum(np.searchsorted(values, z), len(values) - 1)
                hit = values[at] == z
                unite(root, everyone[hit], head[at[hit]])
    return spanning(fps, root)


def spanning(fps: np.ndarray, root: np.ndarray) -> list[tuple[int, int]]:
    """A link to the root of its tree for each other fingerprint."""
    everyone = np.arange(len(fps))
    top = find(root, everyone)
    return [(int(fps[i]), int(fps[top[i]])) for i in np.flatnonzero(top != everyone)]


def wiped(fp: Column, place: Column, low: int, width: int) -> Column:
    """One bit (number place) of the segment of `width` bits from bit `low` on set to zero, all others left out."""
    segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
    return segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))))


def segments(fp: Column, place: Column, low: int, width: int) -> Column:
    """The variant number `place` (0 to 2 * width - 1) of two neighbouring segments, with its place above it."""
    own = F.when(place < width, wiped(fp, place, low, width)).otherwise(wiped(fp, place - width, low + width, width))
    return own.bitwiseOR(F.shiftleft(place.cast("long"), width))


def links(fps: DataFrame, most: int = 3, direct: int = DIRECT) -> DataFrame:
    """Edges (a, b) that span the components of different fingerprints (column fp) linked at `most` bits or fewer.

    A variant with more than `direct` fingerprints is not compared in its task. Its fingerprints agree in one half,
    so their other half is cut into two segments in turn and indexed under its 32 one-bit-wiped variants: these
    groups fix 46 bits and hold 2^18 different fingerprints at most, whatever the table.
    """
    if not 0 <= most <= 3:
        raise ValueError("two segments find up to three differing bits")
    place = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("place")
    v = fps.select("fp", place(64)).select(segments(F.col("fp"), F.col("place"), 0, 32).alias("variant"), F.lit(0).cast("long").alias("part"), "fp")
    met = staged(_compared(v, most, direct))
    large = met.where("b is null").select("variant", F.col("a").alias("fp"))  # variants of the lower half come first
    large = large.select("variant", "fp", place(32))
    other = F.when(F.shiftright("variant", 32) < 32, segments(F.col("fp"), F.col("place"), 32, 16)).otherwise(segments(F.col("fp"), F.col("place"), 0, 16))
    again = _compared(large.select("variant", other.alias("part"), "fp"), most, None)
    return met.where("b is not null").select("a", "b").union(again.select("a", "b")).distinct()


def _compared(dealt: DataFrame, most: int, direct: int | None) -> DataFrame:
    """(variant, a, b): links within each (variant, part), which streams by. Of a group of more than `direct`
    fingerprints (None: no bound) each one comes as a row with b null instead."""
    schema = pa.schema([("variant", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def of(variant, part, fp):
        """Links of whole groups, sorted by (variant, part)."""
        first = np.flatnonzero(np.append(True, (variant[1:] != variant[:-1]) | (part[1:] != part[:-1])))
        size, found = np.diff(np.append(first, len(variant))), []
        two = first[size == 2]
        near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= most]
        found.append(np.stack([fp[near], fp[near + 1]], 1))
        for a, n in zip(first[size > 2], size[size > 2], strict=True):
            pairs = (forest if n <= DIRECT else flipped)(fp[a : a + n], most)
            found.append(np.array(pairs, np.uint64).reshape(-1, 2))
        pairs = np.unique(np.concatenate(found).view(np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    def passed(variant, fp):
        return pa.RecordBatch.from_arrays([pa.array(variant), pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64())], schema=schema)

    def spans(batches):
        held, n, large = [], 0, None  # parts of the last group, which may go on; the large variant that is passed on
        for b in batches:
            variant, part = b.column("variant").to_numpy(), b.column("part").to_numpy()
            fp = b.column("fp").to_numpy().view(np.uint64)
            if large is not None:
                end = int(np.searchsorted(variant, large, "right"))
                if end:
                    yield passed(variant[:end], fp[:end])
                variant, part, fp = variant[end:], part[end:], fp[end:]
            if not len(variant):
                continue
            large = None
            if held and (held[-1][0][-1], held[-1][1][-1]) != (variant[0], part[0]):
                yield of(*map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
            last = np.flatnonzero((variant != variant[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                whole = [np.concatenate(x) for x in zip(*held, (variant[:cut], part[:cut], fp[:cut]), strict=True)]
                held, n = [], 0
                if direct is None:
                    yield of(*whole)
                else:
                    yield from split(*whole)
            held.append((variant[cut:], part[cut:], fp[cut:]))
            n += len(variant) - cut
            if direct is not None and n > direct:
                for v, _, f in held:
                    yield passed(v, f)
                large, held, n = int(variant[-1]), [], 0
        if held:
            yield of(*map(np.concatenate, zip(*held, strict=True)))

    def split(variant, part, fp):
        """Small groups compared, large ones passed on."""
        first = np.flatnonzero(np.append(True, variant[1:] != variant[:-1]))
        size = np.diff(np.append(first, len(variant)))
        much = np.repeat(size > direct, size)
        if much.any():
            yield passed(variant[much], fp[much])
        if not much.all():
            yield of(variant[~much], part[~much], fp[~much])

    return dealt.repartition("variant", "part").sortWithinPartitions("variant", "part", "fp").mapInArrow(spans, "variant long, a long, b long")


def grouped(docs: DataFrame, most: int = 3, width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, text_md5, fp, component, component_id): component is the smallest fingerprint of the component."""
    needs_long(docs, "doc_id")
    rows = staged(fingerprints(docs, width, seed))
    classes = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    of = components(links(classes.select("fp"), most))
    labelled = classes.join(of, classes.fp == of.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    per = staged(labelled.join(smallest, "component").select(F.col("fp").alias("_fp"), "component", "component_id"))
    return rows.join(per, F.col("fp") == F.col("_fp")).drop("_fp")


def near_copies(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, fingerprint, component_id) per document: component_id is the smallest doc_id reachable by links."""
    return grouped(docs, **options).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component: the smallest doc_id (null last), then the smallest text MD5.

    Of rows that share both, the first in order of their other columns (as JSON) stays; they are reduced before
    they meet.
    """
    rows = grouped(docs, **options).groupBy("component", "doc_id", "text_md5").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_md5", "n"))
    kept = rows.groupBy("component").agg(first.alias("r")).select(_row_key(F.col("r.doc_id"), F.col("r.text_md5")).alias("key"), "r.n")
    kept, others = staged(kept), [quoted(c) for c in docs.columns if c != "text"]
    found = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), _row_key(F.col("doc_id"), F.md5(F.coalesce("text", F.lit("")))).alias("key"), F.to_json(F.struct(*others)).alias("place"))
    one = found.join(kept.where("n = 1").select("key"), "key").select("row")
    several = kept.where("n > 1").select("key")
    if not several.isEmpty():
        one = one.union(found.join(several, "key").groupBy("key").agg(F.min_by("row", "place").alias("row")).select("row"))
    return one.select("row.*")


def _row_key(doc_id: Column, text_md5: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), text_md5)
