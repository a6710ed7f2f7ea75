"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf is a byte position where a live token starts; it holds the rank of the token merged with the next live one.
Inner nodes hold the leftmost smallest rank of their FAN children, so a merge reads the root and updates the leaves
of the token, the one before and the one swallowed: O(log n) each, O(n log n) for a piece of n bytes, however long.

Edge cases: a null or empty text has no ids; strings of special tokens are ordinary text; repeated rows and null
doc_ids pass through. Input columns named ids or decoded are replaced.
"""

from __future__ import annotations

import base64
import struct
import uuid

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .shared import nested, parts

NONE = 1 << 60
#: Children of a node of the tree; a piece of up to FAN + 1 bytes has one node.
FAN = 16
#: The Unicode property White_Space, as the pattern's \s means it.
SPACE = r"\t-\r \x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of lines `base64 rank` (50 thousand lines, a published vocabulary)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def splitter(pattern: str) -> regex.Pattern:
    """The pattern with \\s and \\S spelled out as White_Space, for the two engines differ in control characters."""
    p = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    return regex.compile(p)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: always merge the leftmost pair of smallest rank."""
    if piece in ranks:
        return [ranks[piece]]
    n, get = len(piece), ranks.get
    # a leaf is rank * n + position, so that the minimum is the leftmost of the smallest rank
    leaves = [NONE if (r := get(piece[i : i + 2])) is None else r * n + i for i in range(n - 1)]
    tree = [leaves]
    while len(tree[-1]) > FAN:
        tree.append([min(tree[-1][i : i + FAN]) for i in range(0, len(tree[-1]), FAN)])
    top, inner = tree[-1], tree[:-1]
    end = list(range(1, n + 1))  # of the token that starts here
    prev = list(range(-1, n))  # the start of the token before the one that starts here
    while (least := min(top)) < NONE:
        i = least % n
        j = end[i]  # the token at j is swallowed
        stop = end[i] = end[j]
        if stop < n:
            prev[stop] = i
            leaves[j] = NONE
            leaves[i] = NONE if (r := get(piece[i : end[stop]])) is None else r * n + i
        else:
            leaves[i] = NONE
            if j < n - 1:
                leaves[j] = NONE
        if i:
            p = prev[i]
            leaves[p] = NONE if (r := get(piece[p:stop])) is None else r * n + p
        if inner:
            for at in (i, j, prev[i]):
                for level, above in zip(inner, tree[1:]):
                    at //= FAN
                    if not 0 <= at < len(above) or above[at] == (m := min(level[at * FAN : at * FAN + FAN])):
                        break
                    above[at] = m
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Encoder(dict):
    """Encodes texts piece by piece; remembers the ids (as uint32 bytes) of up to `most` different pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 300_000):
        super().__init__()
        self.ranks, self.find, self.most = ranks, splitter(pattern).findall, most

    def __missing__(self, piece: str) -> bytes:
        own = merge(piece.encode(), self.ranks)
        ids = struct.pack(f"<{len(own)}I", *own)
        if len(piece) < 100:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        pieces, parts = self.find(text), []
        for at in range(0, len(pieces), 50_000):
            if len(self) > self.most:
                self.clear()
            parts.append(b"".join(map(self.__getitem__, pieces[at : at + 50_000])))
        return b"".join(parts)


#: The last encoder of this Python worker, which its next task goes on with.
_KEPT: dict[str, Encoder] = {}


def kept_encoder(key: str, ranks: dict[bytes, int], pattern: str) -> Encoder:
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Encoder(ranks, pattern)
    return _KEPT[key]


def encoded(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """docs plus ids array<int>: the ids of the whole text."""
    shared, key = docs.sparkSession.sparkContext.broadcast(ranks), uuid.uuid4().hex  # a vocabulary: 50 thousand entries

    def of(batches):
        encoder = kept_encoder(key, shared.value, pattern)
        for b in parts(batches):
            ids = [np.frombuffer(encoder.encode(t.as_py() or ""), "<i4") for t in b.column("row").field(text)]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*b.schema.names, "ids"])

    rows = nested(docs, ("ids",))
    return rows.mapInArrow(of, StructType([*rows.schema.fields]).add("ids", ArrayType(IntegerType()))).select("row.*", "ids")


def decoder(ranks: dict[bytes, int]):
    """The function from an array of ids to bytes."""
    of_id = {i: b for b, i in ranks.items()}
    return lambda ids: b"".join(map(of_id.__getitem__, ids.tolist()))


def decoded(rows: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """rows with ids plus decoded binary: the bytes that the ids stand for."""
    shared = rows.sparkSession.sparkContext.broadcast(ranks)

    def of(batches):
        decode = decoder(shared.value)
        for b in parts(batches):
            texts = [decode(x.values.to_numpy()) if x.is_valid else b"" for x in b.column("row").field("ids")]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "decoded"])

    rows = nested(rows, ("decoded",))
    return rows.mapInArrow(of, StructType([*rows.schema.fields]).add("decoded", "binary")).select("row.*", "decoded")
