"""Line dedup with two Bloom filters.

Every line has a key (stripped of ASCII white space, A-Z lower-cased). A first pass writes each document's different
keys as digests to the shared folder, packed; the filters are sized by their number and cut into slices by hash
range, a task each. A key sets bits in the filter of keys seen once, and in that of keys seen twice where all its
bits were already set. Only keys that the second filter suspects are shuffled one by one, as digests; an exact count
confirms them and finds each one's first occurrence.

Up to broadcast_bits the second filter goes to every task. A larger one stays where its slices were built: there the
keys' hashes come in packed, and those of suspects go back to the documents' digests. Results are the same.

Edge cases: a null or empty text is one empty line, and empty keys are never dropped; a text that loses all lines
is empty; rows are documents, repeated rows too; with keep_first, rows that are equal in doc_id and text share
their occurrences; an empty table gives an empty result; a very long text is one row of packed keys; a doc_id that is no long is an error
before any job. Input columns named n_lines or n_dropped are replaced, all
others come through unchanged.
"""

from __future__ import annotations

import uuid
from hashlib import blake2b, md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .shared import needs_long, nested, parts, quoted, staged

#: White space that is stripped; hashes of a filter; keys of a row of packed digests.
BLANK = b" \t\n\x0b\x0c\r"
HASHES = 3
PACKED = 50_000
LAST_ID = (1 << 63) - 1


def keys(text: str | None) -> list[bytes]:
    """One key per line. bytes.lower() changes A-Z only."""
    return [k.strip(BLANK) for k in (text or "").encode().lower().split(b"\n")]


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def line_keys(docs: DataFrame, min_length: int) -> DataFrame:
    """(part, n, digests, lines, ends, doc_ids, text_md5): the keys of some documents, packed.

    digests are 16 bytes a key, lines its first line in its document; document i has the keys before ends[i].
    """
    schema = pa.schema([("part", pa.int64()), ("n", pa.int32()), ("digests", pa.binary()), ("lines", pa.binary()), ("ends", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("text_md5", pa.binary())])

    def of(batches):
        ids, own, found, lines, ends = [], [], [], [], []

        def row():
            one = (uuid.uuid4().int >> 65, len(found), b"".join(found), np.array(lines, "<u4").tobytes(), np.array(ends, "<u4").tobytes(), list(ids), b"".join(own))
            for x in (ids, own, found, lines, ends):
                x.clear()
            return batch(schema, [one])

        for b in parts(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                first = {}
                for at, k in enumerate(keys(t)):
                    if k and len(k) >= min_length and (min_length < 2 or len(k.decode()) >= min_length):
                        first.setdefault(k, at)
                ids.append(i)
                own.append(md5((t or "").encode()).digest())
                found.extend(map(digest, first))
                lines.extend(first.values())
                ends.append(len(found))
                if len(found) >= PACKED:
                    yield row()
        if ids:
            yield row()

    return staged(docs.select("doc_id", "text").mapInArrow(of, "part long, n int, digests binary, lines binary, ends binary, doc_ids array<long>, text_md5 binary"))


def hashes(digests: bytes) -> np.ndarray:
    return np.frombuffer(digests, "<u8")[::2]


def places(h: np.ndarray, slices: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The slice of each hash, by its first bits, and its HASHES bits in the slice, by the 32 next ones."""
    shift = 64 - (slices.bit_length() - 1)
    part = (h >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(h), np.int64)
    return part, bits_of((h >> np.uint64(shift - 32)).astype(np.uint32), slice_bits)


def bits_of(rest: np.ndarray, slice_bits: int) -> np.ndarray:
    rest = rest.astype(np.uint64)
    step = (rest * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) | np.uint64(1)
    return np.stack([(rest + np.uint64(i) * step) & np.uint64(slice_bits - 1) for i in range(HASHES)], 1).astype(np.int64)


def filter_size(n: int, bits_per_key: int, most_bits: int = 1 << 25) -> tuple[int, int]:
    """(slices, bits of a slice), powers of two: a slice has up to most_bits, 4 MB packed, and there are 16 at least."""
    power = lambda x: 1 << max(0, int(x) - 1).bit_length()
    total = power(max(n * bits_per_key, 1 << 16))
    slices = max(16, total // most_bits)
    return slices, total // slices


def twice_filter(packed: DataFrame, slices: int, slice_bits: int) -> DataFrame:
    """(slice, bits): the filter of keys seen twice, packed. A key travels as 4 bytes, once per million of a task's."""
    schema = pa.schema([("slice", pa.int32()), ("once", pa.binary()), ("again", pa.binary())])

    def local(batches):
        held, n = [], 0

        def rows():
            seen, times = np.unique(np.concatenate(held), return_counts=True)
            part, _ = places(seen, slices, 1)
            rest = (seen >> np.uint64(64 - (slices.bit_length() - 1) - 32)).astype("<u4")
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else []
            cuts = [*first, len(part)]
            return batch(schema, [(int(part[a]), rest[a:b].tobytes(), rest[a:b][times[a:b] > 1].tobytes()) for a, b in zip(cuts, cuts[1:])])

        for b in batches:
            for d in b.column("digests").to_pylist():
                held.append(hashes(d))
                n += len(held[-1])
                if n > 1_000_000:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    def together(batches):
        now, once, twice = None, None, None

        def done():
            return batch(pa.schema([("slice", pa.int32()), ("bits", pa.binary())]), [(now, np.packbits(twice).tobytes())])

        for b in batches:
            for s, o, a in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if s != now:
                    if now is not None:
                        yield done()
                    now, once, twice = s, np.zeros(slice_bits, bool), np.zeros(slice_bits, bool)
                bits = bits_of(np.frombuffer(o, "<u4"), slice_bits)
                twice[bits[once[bits].all(1)].ravel()] = True  # all set before, so perhaps by the same key
                twice[bits_of(np.frombuffer(a, "<u4"), slice_bits).ravel()] = True
                once[bits.ravel()] = True
        if now is not None:
            yield done()

    sent = packed.mapInArrow(local, "slice int, once binary, again binary")
    return sent.repartition(slices, "slice").sortWithinPartitions("slice").mapInArrow(together, "slice int, bits binary")


SUSPECT = "digest binary, doc_id long, text_md5 binary, line int"
SUSPECT_ARROW = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("text_md5", pa.binary()), ("line", pa.int32())])


def unpacked(digests: bytes, lines: bytes, ends: bytes, doc_ids: list, text_md5: bytes, hit: np.ndarray) -> pa.RecordBatch:
    """The keys at hit, one row each."""
    doc = np.searchsorted(np.frombuffer(ends, "<u4"), hit, "right")
    at = np.frombuffer(lines, "<u4")[hit]
    return batch(SUSPECT_ARROW, [(digests[16 * k : 16 * k + 16], doc_ids[d], text_md5[16 * d : 16 * d + 16], n) for k, d, n in zip(hit.tolist(), doc.tolist(), at.tolist(), strict=True)])


def suspects(packed: DataFrame, slices: int, slice_bits: int, broadcast_bits: int) -> DataFrame:
    """(digest, doc_id, text_md5, line) of every key that the filter of keys seen twice suspects."""
    columns = ["digests", "lines", "ends", "doc_ids", "text_md5"]
    filters = twice_filter(packed, slices, slice_bits)
    if slices * slice_bits > broadcast_bits:
        return _asked(packed, filters, slices, slice_bits, columns)
    whole = np.zeros((slices, max(1, slice_bits // 8)), np.uint8)
    for row in filters.toLocalIterator():  # broadcast_bits / 8 bytes together at most
        whole[row.slice] = np.frombuffer(row.bits, np.uint8)
    shared = packed.sparkSession.sparkContext.broadcast(whole)

    def probe(batches):
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in columns], strict=True):
                part, at = places(hashes(row[0]), slices, slice_bits)
                hit = (shared.value[part[:, None], at >> 3] >> (7 - (at & 7))) & 1
                yield unpacked(*row, np.flatnonzero(hit.all(1)))

    return packed.select(*columns).mapInArrow(probe, SUSPECT)


def _asked(packed: DataFrame, filters: DataFrame, slices: int, slice_bits: int, columns: list[str]) -> DataFrame:
    """As suspects(), past the size of a broadcast: hashes are packed by slice and meet the slice's bits, a slice
    after the other; the suspects' hashes are packed by part and meet its digests."""
    asking = pa.schema([("slice", pa.int32()), ("bits", pa.binary()), ("parts", pa.binary()), ("hashes", pa.binary())])

    def ask(batches):
        held, n = [], 0

        def rows():
            h, part = np.concatenate([x for x, _ in held]), np.concatenate([np.full(len(x), p, "<i8") for x, p in held])
            own = places(h, slices, 1)[0]
            order = np.argsort(own, kind="stable")
            h, part, own = h[order], part[order], own[order]
            cuts = [*np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own)]
            return batch(asking, [(int(own[a]), None, part[a:b].tobytes(), h[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])])

        for b in batches:
            for p, d in zip(b.column("part").to_pylist(), b.column("digests").to_pylist(), strict=True):
                if len(d):
                    held.append((hashes(d), p))
                    n += len(d) // 16
                if n > 1_000_000:
                    yield rows()
                    held, n = [], 0
        if n:
            yield rows()

    def answer(batches):
        bits = None
        for b in batches:
            out = []
            for _, own, part, h in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if own is not None:
                    bits = np.frombuffer(own, np.uint8)
                    continue
                h, part = np.frombuffer(h, "<u8"), np.frombuffer(part, "<i8")
                at = places(h, slices, slice_bits)[1]
                hit = ((bits[at >> 3] >> (7 - (at & 7))) & 1).all(1)
                h, part = h[hit], part[hit]
                out += [(p, h[part == p].tobytes()) for p in np.unique(part).tolist()]
            yield batch(pa.schema([("part", pa.int64()), ("hashes", pa.binary())]), out)

    def pick(batches):
        for b in batches:
            for *row, found in zip(*[b.column(c).to_pylist() for c in [*columns, "found"]], strict=True):
                hit = np.isin(hashes(row[0]), np.frombuffer(b"".join(found), "<u8"))
                yield unpacked(*row, np.flatnonzero(hit))

    asked = packed.mapInArrow(ask, "slice int, bits binary, parts binary, hashes binary")
    none = F.lit(None).cast("binary")
    asked = asked.union(filters.select("slice", "bits", none.alias("parts"), none.alias("hashes")))
    replies = asked.repartition(slices, "slice").sortWithinPartitions("slice", F.col("bits").isNull()).mapInArrow(answer, "part long, hashes binary")
    replies = replies.groupBy("part").agg(F.collect_list("hashes").alias("found"))  # of one part, PACKED keys or one document
    return packed.join(replies, "part").select(*columns, "found").mapInArrow(pick, SUSPECT)


def suspected_keys(docs: DataFrame, min_length: int, bits_per_key: int = 8, broadcast_bits: int = 1 << 28) -> DataFrame:
    """suspects() of docs, with filters of bits_per_key bits for each document's different keys."""
    packed = line_keys(docs, min_length)
    n = packed.agg(F.sum("n")).first()[0] or 0
    return suspects(packed, *filter_size(n, bits_per_key), broadcast_bits)


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_length: int = 1, keep_first: bool = False, broadcast_rows: int = 300_000, counts: bool = True, **filters) -> DataFrame:
    """docs with the lines dropped whose key is in at least min_docs documents, plus (with counts) n_lines and n_dropped.

    keep_first leaves each such line in place where it occurs first, by (doc_id, text_md5, line). Up to
    broadcast_rows repeated keys (some 50 MB) go to every executor; more are joined to the documents that hold them.
    """
    needs_long(docs, "doc_id")
    added = ["n_lines", "n_dropped"] if counts else []
    kept = [c for c in docs.columns if c not in added]
    rows = staged(suspected_keys(docs, min_length, **filters))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("doc_id"), "text_md5", "line"))
    found = rows.groupBy("digest").agg(F.count("*").alias("n_docs"), first.alias("first")).where(F.col("n_docs") >= min_docs)
    found = staged(found.select("digest", "first.*"))
    schema = StructType([docs.schema[c] for c in kept] + [StructField(c, LongType()) for c in added])

    def cut(text, doc_id, firsts):
        """The text without its repeated lines; firsts: {digest: first occurrence}."""
        own_keys = keys(text)
        bad = {k: d for k in {*own_keys} if k and (d := digest(k)) in firsts} if firsts else {}
        if not bad:
            return text or "", len(own_keys), 0
        own, left, at_id = md5((text or "").encode()).digest() if keep_first else None, [], LAST_ID if doc_id is None else doc_id
        for i, (k, line) in enumerate(zip(own_keys, (text or "").split("\n"), strict=True)):
            if k not in bad or keep_first and firsts[bad[k]] == (at_id, own, i):
                left.append(line)
        return "\n".join(left), len(own_keys), len(own_keys) - len(left)

    def out(columns, cuts):
        texts, n, dropped = zip(*cuts, strict=True) if cuts else ((), (), ())
        columns = [pa.array(texts, pa.string()) if c == "text" else columns(c) for c in kept]
        numbers = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, *numbers[: len(added)]], [*kept, *added])

    if found.count() <= broadcast_rows:
        firsts = {bytes(r.digest): (r.doc_id, bytes(r.text_md5), r.line) for r in found.toLocalIterator()}
        shared = docs.sparkSession.sparkContext.broadcast(firsts)

        def here(batches):
            for b in parts(batches):
                own = b.column("row").field
                yield out(own, [cut(t, i, shared.value) for t, i in zip(own("text").to_pylist(), own("doc_id").to_pylist(), strict=True)])

        return nested(docs.select(*map(quoted, kept))).mapInArrow(here, schema)

    def there(batches):
        for b in parts(batches):
            own, cuts = b.column("row").field, []
            for t, i, firsts in zip(own("text").to_pylist(), own("doc_id").to_pylist(), b.column("firsts").to_pylist(), strict=True):
                cuts.append(cut(t, i, {f["digest"]: (f["doc_id"], f["text_md5"], f["line"]) for f in firsts or ()}))
            yield out(own, cuts)

    held = rows.select("digest", F.col("doc_id").alias("own_id"), F.col("text_md5").alias("own_md5")).distinct().join(found, "digest")
    per = held.groupBy("own_id", "own_md5").agg(F.collect_list(F.struct("digest", "doc_id", "text_md5", "line")).alias("firsts"))
    whole = docs.select(F.struct(*map(quoted, kept)).alias("row"), F.col("doc_id").alias("row_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("row_md5"))
    joined = whole.join(per, F.col("row_id").eqNullSafe(F.col("own_id")) & (F.col("row_md5") == F.col("own_md5")), "left")
    return joined.select("row", "firsts").mapInArrow(there, schema)
