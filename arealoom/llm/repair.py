"""Conversation structure repair by a suffix-shared automaton.

Each row becomes one letter: its role initial and its fault. A conversation is then a word, and words that end alike
share the nodes of their common suffix: sorted from the end, each node is made once for all conversations (words that
a border between two tasks parts make theirs twice). A node holds, for each state of the grammar `(s?(ua)+)?`, the
cost to the end and the edit to begin with, so that the best audit of any conversation is a walk along its own nodes.
What a letter adds depends only on how the four costs differ, so equal steps are looked up.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; required for blank and duplicate rows), Insert an empty
user or assistant row (2); a truncated row that stays adds 1. In any state one role at most can follow by Rerole or
Insert, so the edits of a state differ in their initials, and ties go to the smaller one, D < I < K < R.

Rows are in order of (turn, role, SHA-256 of the text), null turns first. They are dealt to tasks by range of all of
these, so that neither a long conversation nor many rows of one turn meet in one task. What is gathered per
conversation is two letters a row, no more than the audit that is returned; the repaired rows of one conversation pass
through one task in order, for a digest has an order.

Edge cases: a null conv_id is one conversation; nulls in role and text are one space, also in the key of the damage (so
a null text is blank); equal rows are duplicates; an empty text is blank; texts of any length pass row by row; other
columns are ignored; an empty table gives an empty result. conv_id may have any type that can be sorted, turn is a
whole number.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .chat import streamed
from .shared import parts, staged

#: A text's last character that is no space, and the ends of a sentence.
LAST, ENDS = r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", "[.!?]"
#: Rows of one piece of a word, as a power of two.
PIECE = 12
#: Grammar states, the role that may follow each by Rerole or Insert, and the state after a role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = "uuau"
AFTER = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NAMES = {"u": "user", "a": "assistant"}
#: Costs where no row is left: an open user turn gets its answer.
FINAL = (0, 4, 2, 0)


def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after damage by crc32(conv_id:turn) % 20: dropped (0), emptied (1), without the ends
    of sentences (2), twice (3), as a user's (4)."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies)).drop("col")


def ordered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, role, text, digest, last), staged: pos is in order within a conversation."""
    rows = rows.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("last", F.regexp_extract("text", LAST, 1))
    order = ["conv_id", "turn", "role", "digest", "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(rows.drop("tie").withColumn("pos", F.monotonically_increasing_id()))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, initial, fault): blank, duplicate (role and text occur earlier) or truncated, the first that
    holds. Texts are not read."""
    firsts = rows.groupBy("conv_id", "role", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    light = rows.select("conv_id", "pos", "turn", "last", F.substring("role", 1, 1).alias("initial")).join(firsts, "pos", "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").rlike(ENDS), "truncated")
    return light.select("conv_id", "pos", "turn", F.when(F.col("initial").isin(*AFTER), F.col("initial")).otherwise("o").alias("initial"), fault.alias("fault"))


def words(light: DataFrame) -> DataFrame:
    """Per conversation: its word, gaps, faults by kind, and pairs of adjacent rows that are not su, ua or au."""
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper("initial")).otherwise(F.col("initial"))
    kinds = ("blank", "duplicate", "truncated")
    piece = light.groupBy("conv_id", F.shiftright("pos", PIECE).alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("pos", letter.alias("letter"), "initial"))).alias("own"),
        F.size(F.collect_set("turn")).alias("turns"), F.min("turn").alias("low"), F.max("turn").alias("high"),
        *[F.count_if(F.col("fault") == k).alias(k) for k in kinds],
    )
    text = lambda c: F.array_join(F.transform("own", lambda x: x[c]), "").alias(c)
    piece = piece.select("conv_id", F.struct("piece", text("letter"), text("initial"), "turns", "low", "high").alias("p"), *kinds)
    whole = piece.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"), *[F.sum(k).alias(k) for k in kinds])
    joined = lambda c: F.array_join(F.transform("ps", lambda p: p[c]), "")
    total = F.aggregate("ps", F.lit(0).cast("long"), lambda n, p: n + p["turns"])
    again = F.size(F.filter(F.zip_with(F.slice("ps", 2, F.size("ps")), F.slice("ps", 1, F.size("ps") - 1), lambda p, before: p["low"] == before["high"]), lambda same: same))
    span = F.array_max(F.transform("ps", lambda p: p["high"])) - F.array_min(F.transform("ps", lambda p: p["low"])) + 1
    good = F.regexp_count(joined("initial"), F.lit("(?=su|ua|au)"))
    return whole.select("conv_id", joined("letter").alias("word"), F.coalesce(span - total + again, F.lit(0)).cast("long").alias("gaps"), *kinds, (F.length(joined("initial")) - 1 - good).cast("long").alias("illegal"))


class Automaton:
    """Nodes of the current word's suffixes, from the empty one on: what each state costs (less the smallest), that
    smallest cost, and the edits. The next word keeps the nodes that it shares."""

    def __init__(self):
        self.costs, self.base, self.edits, self.word, self.steps = [FINAL], [0], [" II "], "", {}

    def read(self, word: str) -> tuple[int, str, str]:
        """The least cost, the audit, and the role initial that each edit leaves (- for none)."""
        back = word[::-1]
        shared = len(commonprefix([back, self.word]))
        for held in (self.costs, self.base, self.edits):
            del held[shared + 1 :]
        for letter in back[shared:]:
            key = letter, self.costs[-1]
            if key not in self.steps:
                self.steps[key] = step(*key)
            low, costs, edits = self.steps[key]
            self.costs.append(costs)
            self.base.append(self.base[-1] + low)
            self.edits.append(edits)
        self.word = back
        return self.base[-1] + self.costs[-1][START], *self.walk(word)

    def walk(self, word: str) -> tuple[str, str]:
        state, left, audit, made = START, len(word), [], []
        while left or state in (SYSTEM, USER):
            edit = self.edits[left][state]
            role = "-" if edit == "D" else word[-left].lower() if edit == "K" else NEXT[state]
            audit.append(edit)
            made.append(role)
            state = AFTER.get(role, state)
            left -= edit != "I"
        return "".join(audit), "".join(made)


def step(letter: str, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], str]:
    """A node before `letter`: its smallest cost, the states' costs less that, and their edits."""
    role, late, own = letter.lower(), int(letter.isupper()), []
    for state in range(4):
        ways = [(after[state] + 3, "D")]
        if letter != "x":
            if role == NEXT[state] or (role, state) == ("s", START):
                ways.append((after[AFTER[role]] + late, "K"))
            ways.append((after[AFTER[NEXT[state]]] + late + 2, "R"))
        own.append(min(ways))
    for _ in range(2):  # two inserts in a row at most are of use
        own = [min(own[state], (own[AFTER[NEXT[state]]][0] + 2, "I")) for state in range(4)]
    low = min(c for c, _ in own)
    return low, tuple(c - low for c, _ in own), "".join(e for _, e in own)


def edits(found: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, made) of each word; words in order from their end, so that suffixes are shared."""
    kind = found.schema["conv_id"].dataType

    def solve(batches):
        automaton = Automaton()
        for b in parts(batches):
            made = [automaton.read(w) for w in b.column("word").to_pylist()]
            columns = [pa.array([m[i] for m in made], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], ["conv_id", "cost", "audit", "made"])

    order = [F.reverse("word"), F.col("conv_id")]
    dealt = found.select("conv_id", "word").repartitionByRange(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(solve, StructType().add("conv_id", kind).add("cost", LongType()).add("audit", StringType()).add("made", StringType()))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, step, edit, role, text): the edits in order with the rows that they leave, or delete (D). All rows of a
    conversation are in one partition, in order."""
    schema = StructType([rows.schema["conv_id"]]).add("step", LongType()).add("edit", StringType()).add("role", StringType()).add("text", StringType())
    heads = found.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.col("made").alias("role"), F.col("audit").alias("text"))
    dealt = heads.union(rows.select("conv_id", "pos", "role", "text")).repartition("conv_id").sortWithinPartitions("conv_id", "pos")

    def of(batches):
        return in_batches((made for conv, group in groupby(streamed(parts(batches)), lambda r: r[0]) for made in applied(conv, group)), schema)

    return dealt.mapInArrow(of, schema)


def applied(conv, group):
    """The edited rows of one conversation; the first row holds its edits."""
    _, _, made, audit = next(group)
    for i, (edit, role) in enumerate(zip(audit, made, strict=True)):
        if edit == "I":
            yield conv, i, edit, NAMES[role], ""
        else:
            _, _, own, text = next(group)
            yield conv, i, edit, NAMES[role] if edit == "R" else own, text


def in_batches(rows, schema: StructType, most: int = 1 << 22):
    """Tuples as Arrow batches of up to 1,000 rows or some `most` characters."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape, held, size = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, str))
        if len(held) == 1000 or size > most:
            yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in held], shape)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in held], shape)


def digests(made: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): of the repaired rows as lines role:text."""
    schema = StructType([made.schema["conv_id"]]).add("repaired_sha256", StringType())

    def of(batches):
        return in_batches(((conv, digest(group)) for conv, group in groupby(streamed(batches), lambda r: r[0])), schema)

    def digest(group) -> str:
        total, first = sha256(), True
        for _, _, edit, role, text in group:
            if edit != "D":
                total.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
        return total.hexdigest()

    return made.mapInArrow(of, schema)


def repair(rows: DataFrame, conversations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conv_id of
    `conversations` (by default of rows), and the repaired rows."""
    everyone = (rows if conversations is None else conversations).select("conv_id").distinct()
    rows = ordered(rows)
    found = staged(words(faults(rows)))
    best = staged(edits(found))
    made = repaired(rows, best)
    known = everyone.select(F.col("conv_id").alias("_conv"))
    for other in (found.drop("word"), best.drop("made"), digests(made)):
        known = known.join(other, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    ends = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256")]
    return known.select(F.col("_conv").alias("conv_id"), *numbers, *ends), made
