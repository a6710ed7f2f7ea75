"""Language identification by rank-order profiles.

A profile is a language's most frequent n-grams (1 to 3 letters, a word's start and end marked) in order of count. A
document's own most frequent n-grams are compared with each profile by out-of-place distance: for each n-gram the
difference of its two places, or the length of a profile where the profile lacks it. The nearest language wins.

n-grams are numbers: three code points of 21 bits, 0 for a word's border or for what a shorter n-gram lacks. Ties of
counts go to the smaller number, ties of distances to the smaller language.

Profiles count every training text as a whole. A task holds the pending texts of one slice and the n-grams of one
document; a very long text is counted in slices. Profiles are sent to the tasks in blocks of languages (`block`), so
that what is broadcast has a fixed bound for any number of languages.

Edge cases: a null text, or one without a letter, is `und` with score 0; so is every text if there is nothing to learn
from. A null lang is not learned; a null doc_id is an empty one for the fold; repeated rows count as often as they
occur. An empty table gives an empty result. doc_id may have any type. Input columns named lang_pred or score are
replaced; others of any name come through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructType

from .shared import nested, parts, staged

#: N-grams of a profile.
PLACES = 300
#: Code points counted at once.
SLICE = 1 << 20
#: Languages whose profiles are broadcast together: with PLACES n-grams each, the table of places has at most
#: 64 * PLACES rows of 64 numbers, 10 MB.
BLOCK = 64
UND = "und"

_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, in order, and how often each occurs."""
    low, found = text.lower(), []
    for at in range(0, len(low), SLICE):
        # two code points of the slice before, so that no n-gram is lost at the cut
        code = np.frombuffer(low[max(at - 2, 0) : at + SLICE].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        new = np.arange(len(code)) >= min(at, 2)
        found.append(np.unique(_numbers(np.where(letters()[code], code, 0), new, at == 0, at + SLICE >= len(low)), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else added(found)


def _numbers(code: np.ndarray, new: np.ndarray, first: bool, last: bool) -> np.ndarray:
    """The n-grams that end in a new place; 0 stands for all that is no letter."""
    code = np.concatenate([np.zeros(int(first), np.int64), code, np.zeros(int(last), np.int64)])
    new = np.concatenate([np.ones(int(first), bool), new, np.ones(int(last), bool)])
    one = code[new & (code > 0)] << 42
    a, b = code[:-1], code[1:]
    two = ((a << 42) | (b << 21))[new[1:] & ((a > 0) | (b > 0))]
    a, b, c = code[:-2], code[1:-1], code[2:]
    three = ((a << 42) | (b << 21) | c)[new[2:] & (b > 0)]
    # a letter and a border is told apart from a letter alone by a mark that is no code point
    two = np.where((two >> 21) & 0x1FFFFF == 0, two | (0x1FFFFF << 21), two)
    three = np.where(three & 0x1FFFFF == 0, three | 0x1FFFFF, three)
    return np.concatenate([one, two, three])


def added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, at, np.concatenate([n for _, n in found]))
    return keys, counts


def ranked(text: str | None, places: int = PLACES) -> np.ndarray:
    """The most frequent n-grams of a text, the most frequent first."""
    keys, counts = grams(text or "")
    if len(keys) > places:
        least = np.partition(counts, len(counts) - places)[len(counts) - places]
        held = counts >= least
        keys, counts = keys[held], counts[held]
    return keys[np.lexsort([keys, -counts])][:places]


def profiles(training: DataFrame, text: str = "text", lang: str = "lang", places: int = PLACES) -> DataFrame:
    """(lang, gram, place): the most frequent n-grams of all texts of a language, place from 0."""

    def counted(batches):
        held, size = {}, 0
        for b in parts(batches):
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(name, []).append(t or "")
                size += len(t or "") + 1
                if size >= SLICE:
                    yield from rows(held)
                    held, size = {}, 0
        yield from rows(held)

    def rows(held):
        for name, texts in held.items():
            keys, counts = grams("\n".join(texts))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])

    learned = training.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    sums = learned.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return sums.withColumn("place", place).where(F.col("place") < places).select("lang", "gram", "place")


def identified(docs: DataFrame, known: DataFrame, text: str = "text", places: int = PLACES, block: int = BLOCK) -> DataFrame:
    """docs plus lang_pred and score: the nearest profile of `known`, and the second distance as a share of the two
    smallest (0.5 where they tie, 1 where no other language or nothing is out of place)."""
    known = staged(known)
    number = known.select("lang").distinct().withColumn("block", F.expr(f"(row_number() over (order by lang) - 1) div {block}"))
    known = staged(known.join(number, "lang"))
    rows = nested(docs, ("lang_pred", "score")).withColumn("found", F.lit(None).cast("struct<lang:string,near:double,next:double,grams:array<long>>"))
    last = known.agg(F.max("block")).first()[0]
    for i in range(0 if last is None else last + 1):
        rows = _compared(rows, known.where(F.col("block") == i), text, places, last=i == last)
    near, second = F.col("found.near"), F.col("found.next")
    share = F.when(second.isNull() | (second == 0), F.when(near == second, 0.5).otherwise(1.0)).otherwise(second / (near + second))
    none = F.col("found.lang").isNull()
    return rows.select("row.*", F.when(none, UND).otherwise(F.col("found.lang")).alias("lang_pred"), F.when(none, 0.0).otherwise(share).alias("score"))


def _compared(rows: DataFrame, own: DataFrame, text: str, places: int, last: bool) -> DataFrame:
    """rows with `found` brought up to date with the profiles of one block."""
    names, table, numbers = profile_table(own, places)
    shared = rows.sparkSession.sparkContext.broadcast((names, table, numbers))
    kind = pa.struct([("lang", pa.string()), ("near", pa.float64()), ("next", pa.float64()), ("grams", pa.list_(pa.int64()))])

    def of(batches):
        names, table, numbers = shared.value
        for b in parts(batches):
            made = []
            for t, before in zip(b.column("row").field(text).to_pylist(), b.column("found").to_pylist(), strict=True):
                own = np.array(before["grams"], np.int64) if before else ranked(t, places)
                made.append(nearest(own, names, table, numbers, places, before) | {"grams": None if last else own.tolist()})
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(made, kind)], ["row", "found"])

    return rows.mapInArrow(of, StructType([rows.schema["row"]]).add("found", StructType().add("lang", StringType()).add("near", DoubleType()).add("next", DoubleType()).add("grams", ArrayType(LongType()))))


def profile_table(own: DataFrame, places: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, and of each n-gram its place in each profile (`places` twice over where it is missing)."""
    held = own.toPandas()
    names = sorted(held["lang"].unique().tolist(), key=lambda x: x.encode())
    column = {x: i for i, x in enumerate(names)}
    numbers, at = np.unique(held["gram"].to_numpy(np.int64), return_inverse=True)
    table = np.full((len(numbers) + 1, len(names)), -1, np.int64)
    table[at, [column[x] for x in held["lang"]]] = held["place"]
    return names, table, numbers


def nearest(own: np.ndarray, names: list[str], table: np.ndarray, numbers: np.ndarray, places: int, before: dict | None) -> dict:
    """The nearest language so far, its distance and the next one."""
    if not len(own) or not names:
        return {"lang": before["lang"] if before else None, "near": before["near"] if before else None, "next": before["next"] if before else None}
    at = np.searchsorted(numbers, own)
    at[(at == len(numbers)) | (numbers[np.minimum(at, len(numbers) - 1)] != own)] = len(numbers)
    held = table[at]
    away = np.where(held < 0, places, np.abs(held - np.arange(len(own))[:, None])).sum(0)
    ranks = [(float(d), names[i]) for i, d in enumerate(away)]
    if before and before["lang"] is not None:
        ranks.append((before["near"], before["lang"]))
    ranks = sorted(ranks, key=lambda x: (x[0], x[1].encode()))[:2]
    others = [r[0] for r in ranks[1:]] + ([before["next"]] if before and before["next"] is not None else [])
    return {"lang": ranks[0][1], "near": ranks[0][0], "next": min(others, default=None)}
