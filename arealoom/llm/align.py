"""Cross-tokenizer alignment: which tokens of two vocabularies end together, and how often over a corpus.

A text with a space before it is encoded by a byte-level BPE (A) and by a piece BPE with byte fallback (B). Offsets
where tokens of both end cut them into groups; an A and a B token that end together are a link.

Texts are encoded once and their ids are staged, two bytes each for these vocabularies. Very long texts are cut before
single spaces or newlines between two characters that are no space: no token of either spans such a place (`Aligner`
checks B's vocabulary for it; in A's pattern a space can only lead). What is of common characters is encoded by the
ranks of A's merges, which give the same ids (checked when A is loaded), the rest by the library that A's file is for.

Counts: pairs of linked ids are vocabulary, not corpus, for of two tokens that end together the shorter is a suffix of
the longer: their number has a bound that `most_pairs` computes from the two vocabularies. The distinct pairs get a
minimal perfect hash (keys that fall alone into a place of a level take its rank, the others go to the next level);
partitions sum their local counts into dense vectors by hash, vectors are summed in a tree, and a second pass aligns
each document again and looks its links up, comparing the pair held at each place.

Edge cases: a text that is null or empty, or that a tokenizer does not give back byte by byte, has no tokens: zeros and
an empty `groups`. Strings of special tokens are plain text. Repeated rows count as often as they occur; long texts
are taken segment by segment, whole; a null doc_id passes through; an empty table gives an empty result. Input columns
named as the added ones are replaced, others of any name come through.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from .shared import nested, parts, quoted, staged

#: Before a space or newline on its own: neither neighbour is a space to any of the engines involved.
CUT = re.compile(r"(?<=[^\s\u180e\u200b])(?=[ \n][^\s\u180e\u200b])")
#: Characters that all engines class alike; what holds others goes to the slower library that the vocabulary is for.
COMMON = re.compile(r"[\n -~\u00c0-\u024f]+")
#: Columns of packed ids.
IDS = ("a_ids", "b_ids")
#: Counted for each text; `groups` is the text of its groups.
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: A pair of ids is a * WIDTH + b.
WIDTH = 1 << 24
#: Characters of a text that are encoded at once, if it can be cut there.
LONG = 1 << 16
#: Slots of one piece of a dense vector; vectors summed at once.
SLOTS, FAN = 1 << 15, 16


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Aligner:
    """Two tokenizers and where their tokens end together."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary = model["vocab"]
        letter = byte_letters()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(map(letter.__getitem__, token)) if all(c in letter for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("▁")
        self.whole = any("▁" in p.lstrip("▁") or ("\n" in p and p != "\n") for p in pieces)  # a piece could span a cut
        self.fast = ranked_encoder(model, self.a_bytes)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t]) for t in (self.a_bytes, self.b_bytes))
        self.names = [f"{i}{end}" for i in range(len(self.a_bytes)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b_bytes)) for end in ",;"]
        self.width = np.dtype("H" if max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16 else "I")

    def encoded(self, text: str | None) -> tuple[bytes, bytes] | None:
        """A's and B's ids, packed; None if the text has no tokens."""
        if not text:
            return None
        whole = f" {text}"
        data, own = whole.encode(), self.segments(whole)
        safe = self.fast is not None and COMMON.fullmatch(whole) is not None  # ranks of all bytes lose none
        for held in [own] if len(own) == 1 else [own, [whole]]:
            a, b = (list(chain.from_iterable(map(of, held))) for of in (self.of_a, self.of_b))
            if b"".join(map(self.b_bytes.__getitem__, b)) == data and (safe or b"".join(map(self.a_bytes.__getitem__, a)) == data):
                return array(self.width.char, a).tobytes(), array(self.width.char, b).tobytes()
        return None

    def segments(self, text: str) -> list[str]:
        """text, cut about every LONG characters where no token can lie across."""
        at, out = 0, []
        while not self.whole and len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
            out.append(text[at : cut.start()])
            at = cut.start()
        return [*out, text[at:]]

    def of_a(self, text: str) -> list[int]:
        if self.fast and COMMON.fullmatch(text):
            return self.fast(text)
        ids = []
        for common, run in groupby(CUT.split(text), lambda c: self.fast is not None and COMMON.fullmatch(c) is not None):
            own = "".join(run)
            ids += self.fast(own) if common else self.a.encode(own, add_special_tokens=False).ids
        return ids

    def of_b(self, text: str) -> list[int]:
        """B's ids of a text that begins with a space or newline; B puts a space before each text, which stays a piece
        of its own before a newline."""
        if text[0] == " ":
            return self.b.encode(text[1:], num_threads=1)
        ids = self.b.encode(text, num_threads=1)
        return ids[1:] if ids[:1] == [self.space] else []

    def ends(self, tokens: list[tuple[bytes, bytes]]) -> Ends:
        """Where the tokens of some documents, one after the other, end together."""
        a, b = (np.frombuffer(b"".join(own), self.width) for own in zip(*tokens, strict=True))
        sizes = np.array([(len(x), len(y)) for x, y in tokens]) // self.width.itemsize
        end_a, end_b = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])  # of equal bytes, so documents begin together
        in_a, in_b = np.zeros(end_a[-1] + 1, bool), np.zeros(end_a[-1] + 1, bool)
        in_a[end_a], in_b[end_b] = True, True
        return Ends(a, b, in_b[end_a], in_a[end_b], np.cumsum(sizes, 0))

    def groups(self, own: Ends) -> list[str]:
        """The groups of each document as text: its tokens' names with what follows each."""
        before_a, before_b = np.append(0, np.flatnonzero(own.last_a) + 1), np.append(0, np.flatnonzero(own.last_b) + 1)
        line = np.empty(len(own.a) + len(own.b), np.int64)
        line[np.arange(len(own.a)) + before_b[np.cumsum(own.last_a) - own.last_a]] = own.a * np.int64(2) + own.last_a
        line[np.arange(len(own.b)) + before_a[np.cumsum(own.last_b) - own.last_b + 1]] = own.b * np.int64(2) + own.last_b + 2 * len(self.a_bytes)
        ends = own.upto.sum(1).tolist()
        return ["".join(map(self.names.__getitem__, line[x:y].tolist()))[:-1] for x, y in zip([0, *ends], ends)]

    def most_pairs(self) -> int:
        """A bound of the different pairs in any corpus: one token's bytes are a suffix of the other's."""
        of_b: dict[bytes, int] = {}
        of_a: dict[bytes, int] = {}
        for held, tokens in ((of_a, self.a_bytes), (of_b, self.b_bytes)):
            for t in tokens:
                held[t] = held.get(t, 0) + 1
        suffixes = lambda t: (t[i:] for i in range(len(t) + 1))
        longer = sum(of_b.get(s, 0) for t in self.a_bytes for s in suffixes(t))
        return longer + sum(of_a.get(s, 0) for t in self.b_bytes for s in suffixes(t) if len(s) < len(t))


@dataclass
class Ends:
    """Ids of some documents in a row, which of them end where one of the other vocabulary ends, and the numbers of
    A's and B's tokens up to the end of each document."""

    a: np.ndarray
    b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray
    upto: np.ndarray

    def pairs(self) -> np.ndarray:
        return self.a[self.last_a].astype(np.int64) * WIDTH + self.b[self.last_b]


def ranked_encoder(model: dict, tokens: list[bytes]):
    """The encoder by ranks of a byte-level vocabulary whose k-th merge makes the k-th id after the bytes; None if it is
    not of that kind."""
    import public_tokenizers
    import tiktoken

    merged = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"].get(a + b) for a, b in merged] != list(range(256, 256 + len(merged))):
        return None
    ranks = {tokens[i]: i for i in range(256 + len(merged))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


#: The last aligner of this Python worker, which its next task goes on with.
_KEPT: dict[tuple, Aligner] = {}


def kept_aligner(*paths: str) -> Aligner:
    if paths not in _KEPT:
        _KEPT.clear()
        _KEPT[paths] = Aligner(*paths)
    return _KEPT[paths]


def mixed_bits(keys: np.ndarray, level: int) -> np.ndarray:
    """Hashes of 64-bit keys, another function for each level (the published finalizer of splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: slots 0 to n - 1, each with its key for comparison."""

    def __init__(self, keys: np.ndarray):
        self.levels, left, start = [], np.unique(keys), 0
        n = len(left)
        while len(left):
            size = 2 * len(left)
            at = (mixed_bits(left, len(self.levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((size, np.where(alone, start + np.cumsum(alone) - 1, -1).astype(np.int32)))
            start += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros(n, np.int64)
        own = np.unique(keys)
        self.keys[self.slots(own)] = own

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; that of a key that was not in the set is any, or -1."""
        found = np.full(len(keys), -1, np.int64)
        for level, (size, ranks) in enumerate(self.levels):
            open_ = np.flatnonzero(found < 0)
            found[open_] = ranks[(mixed_bits(keys[open_], level) % np.uint64(size)).astype(np.int64)]
        return found

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """The slots of keys of the set; another key is an error."""
        found = self.slots(keys)
        if len(keys) and (not len(self.keys) or (self.keys[found] != keys).any()):
            raise ValueError("a pair that the first pass did not see: the texts changed between the passes")
        return found


@dataclass
class Pairs:
    """The distinct pairs of a corpus by slot, how often each is linked, and whether that is its B id's most."""

    hash: PerfectHash
    counts: np.ndarray
    best: np.ndarray


def encoded(docs: DataFrame, a_path: str, b_path: str, text: str = "text") -> DataFrame:
    """docs plus a_ids and b_ids, packed (null for a text without tokens). Stage it, for two passes read it."""

    def of(batches):
        aligner = kept_aligner(a_path, b_path)
        for b in parts(batches, 32):
            ids = [aligner.encoded(t) or (None, None) for t in b.column("row").field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array([x[i] for x in ids], pa.binary()) for i in (0, 1))], ["row", *IDS])

    rows = nested(docs, IDS)
    schema = StructType([rows.schema["row"]]).add("a_ids", BinaryType()).add("b_ids", BinaryType())
    return rows.mapInArrow(of, schema).select("row.*", *IDS)


def local_counts(tokens: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(pair, n): linked pairs counted within each task, at most `most_pairs` rows each."""

    def of(batches):
        aligner = kept_aligner(a_path, b_path)
        keys, counts, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for b in parts(batches):
            if own := list(zip(*(b.column(c).to_pylist() for c in IDS), strict=True)):
                held.append(aligner.ends(own).pairs())
                n += len(held[-1])
            if n > 1 << 20:
                keys, counts, held, n = *summed(keys, counts, held), [], 0
        keys, counts = summed(keys, counts, held)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    def summed(keys, counts, held):
        own, n = np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)
        both, at = np.unique(np.concatenate([keys, own]), return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, at, np.concatenate([counts, n]))
        return both, total

    return tokens.where("a_ids is not null").select(*IDS).mapInArrow(of, "pair long, n long")


def pair_table(tokens: DataFrame, a_path: str, b_path: str) -> Pairs:
    """First pass: the distinct pairs of all encoded documents and their counts."""
    local = staged(local_counts(tokens, a_path, b_path))
    keys = local.select("pair").distinct().toArrow().column(0).to_numpy()  # vocabulary, see most_pairs
    if len(keys) > (bound := Aligner(a_path, b_path).most_pairs()):
        raise ValueError(f"{len(keys)} pairs, but {bound} are possible")
    table = PerfectHash(keys)
    counts = tree_sum(local, table)
    ids = table.keys % WIDTH
    highest = np.zeros(int(ids.max()) + 1 if len(ids) else 0, np.int64)
    np.maximum.at(highest, ids, counts)
    return Pairs(table, counts, counts == highest[ids])


def tree_sum(local: DataFrame, table: PerfectHash) -> np.ndarray:
    """The counts of all partitions by slot: one dense vector a partition, summed FAN at a time, piece by piece."""
    shared, n = local.sparkSession.sparkContext.broadcast(table), len(table.keys)  # at most most_pairs keys

    def dense(batches):
        total = np.zeros(n, np.int64)
        for b in batches:
            np.add.at(total, shared.value.verified(b.column(0).to_numpy()), b.column(1).to_numpy())
        return pieces((at // SLOTS, total[at : at + SLOTS]) for at in range(0, n, SLOTS))

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for piece, data in zip(b.column("piece").to_pylist(), b.column("data").to_pylist(), strict=True):
                own = np.frombuffer(data, np.int64)
                held[piece] = held[piece] + own if piece in held else own
        return pieces(held.items())

    def pieces(found):
        for piece, own in found:
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int64()), pa.array([own.tobytes()], pa.binary())], ["piece", "data"])

    rows, nodes = local.mapInArrow(dense, "piece long, data binary"), local.rdd.getNumPartitions()
    while nodes > 1:
        nodes = -(-nodes // FAN)
        # a node of the tree sums some FAN nodes of the level below; as many tasks as nodes times pieces
        rows = rows.withColumn("node", F.spark_partition_id() % nodes).repartition(nodes * -(-n // SLOTS) or 1, "node", "piece").drop("node").mapInArrow(added, "piece long, data binary")
    found = {}
    for r in rows.collect():  # one dense vector, in pieces
        own = np.frombuffer(r.data, np.int64)
        found[r.piece] = found.get(r.piece, 0) + own
    return np.concatenate([*(found[k] for k in sorted(found)), np.zeros(0, np.int64)])


def aligned(tokens: DataFrame, pairs: Pairs, a_path: str, b_path: str) -> DataFrame:
    """Second pass: the columns beside the ids plus n_a, n_b, n_groups, n_links, n_best (links that are their B id's most
    frequent), count_sum and groups (`a1,a2|b1;a3|b2,b3`)."""
    shared, names = tokens.sparkSession.sparkContext.broadcast(pairs), (*NUMBERS, "groups")  # at most most_pairs keys

    def of(batches):
        aligner = kept_aligner(a_path, b_path)
        for b in parts(batches, 32):
            ids = list(zip(*(b.column(c).to_pylist() for c in IDS), strict=True))
            at = [i for i, x in enumerate(ids) if x[0] is not None]
            numbers, groups = np.zeros((len(NUMBERS), len(ids)), np.int64), np.full(len(ids), "", object)
            if at:
                own = aligner.ends([ids[i] for i in at])
                numbers[:, at], groups[at] = looked_up(own, shared.value), aligner.groups(own)
            yield pa.RecordBatch.from_arrays([b.column("row"), *map(pa.array, numbers), pa.array(groups, pa.string())], ["row", *names])

    rows = tokens.select(F.struct(*[quoted(c) for c in tokens.columns if c not in (*IDS, *names)]).alias("row"), *IDS)
    schema = StructType([rows.schema["row"]])
    for name in NUMBERS:
        schema = schema.add(name, LongType())
    return rows.mapInArrow(of, schema.add("groups", StringType())).select("row.*", *names)


def looked_up(own: Ends, pairs: Pairs) -> np.ndarray:
    """NUMBERS of each document, a row a number."""
    at = pairs.hash.verified(own.pairs())
    ends = np.cumsum(own.last_a)[own.upto[:, 0] - 1]  # links up to the end of each document; each ends a group
    total = lambda values: np.diff(np.append(0, np.cumsum(values))[ends], prepend=0)
    links = np.diff(ends, prepend=0)
    return np.stack([*np.diff(own.upto, axis=0, prepend=0).T, links, links, total(pairs.best[at]), total(pairs.counts[at])])
