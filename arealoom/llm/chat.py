"""Chat formatting in budgeted windows.

A running total of a conversation's turn tokens cuts it into segments, and each segment greedily into windows of
whole turns. A window repeats the system turn and the latest earlier turns that fit the history budget; repeated
turns are outside the loss mask, so each assistant text is a target once.

Template: every turn is TURN + role + newline + text + END. Control strings inside texts, of this template and of
others in use, lose their first character to an entity; reading back restores it.

Edge cases: a null text or role is empty; turns are in order of (turn, role, text), null turns first; equal rows
are turns of their own; a null conv_id is one conversation; a turn over the budget is a window by itself, uncut;
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from hashlib import sha256
from itertools import batched, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import running_total

#: The template's marks, the control strings that are escaped, and their entities.
TURN, END = "<|turn|>", "<|end|>"
CONTROL = re.compile(r"<(?=\||/?s>|<SYS|</SYS)|\[(?=/?INST\])|&(?=amp;|lt;|lsqb;|#10;)")
ENTITY = {"<": "&lt;", "[": "&lsqb;", "&": "&amp;", "\n": "&#10;"}
PLAIN = {v: k for k, v in ENTITY.items()}
#: Tokens that a turn's marks count for.
MARKS = 3
WINDOW = pa.schema([("conv_id", pa.int64()), ("segment", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("masked", pa.int32()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def streamed(batches):
    """The rows of Arrow batches as tuples."""
    for b in batches:
        yield from zip(*[c.to_pylist() for c in b.columns], strict=True)


def arrow(rows, schema: pa.Schema, size: int = 1000):
    """Tuples as Arrow batches of `size` rows."""
    for part in batched(rows, size):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: ENTITY[m[0]], text)


def unescape(text: str) -> str:
    return re.sub("&(?:amp|lt|lsqb|#10);", lambda m: PLAIN[m[0]], text)


def window_text(turns: list[tuple[str, str]], masked: int) -> tuple[str, list[int], list[int]]:
    """The text of a window and the starts and ends of its loss mask; the first `masked` turns are repeated."""
    out, at, starts, ends = [], 0, [], []
    for i, (role, text) in enumerate(turns):
        head, body = f"{TURN}{escape(role).replace(chr(10), ENTITY[chr(10)])}\n", escape(text)
        if i >= masked and role == "assistant":
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(out), starts, ends


def read_window(text: str) -> list[tuple[str, str]]:
    """The turns of a window's text."""
    parts = (x.removesuffix(END).split("\n", 1) for x in text.split(TURN)[1:])
    return [(unescape(role), unescape(body)) for role, body in parts]


def formatted(turns: DataFrame, budget: int = 1024, history: int = 256, segment_windows: int = 64) -> DataFrame:
    """(conv_id, segment, window, text, masked, starts, ends): `masked` turns at the front of a window's text are
    repeated; [starts, ends) are the code points under the loss mask.

    Conversations spread over tasks by segments of budget * segment_windows tokens, however long they are.
    """
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    rows = rows.withColumn("tokens", F.regexp_count("text", F.lit(r"\S+")).cast("long") + MARKS).withColumn("block", F.floor(F.col("turn") / 512))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    rows = running_total(rows, ["conv_id"], "block", order, "tokens", "before")
    length = budget * segment_windows
    rows = rows.withColumn("segment", F.floor(F.col("before") / length)).withColumn("kind", F.lit(2)).drop("block")
    late = rows.where((F.col("before") % length) >= length - history)
    late = late.withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    system = rows.where("before = 0 and role = 'system'").withColumn("kind", F.lit(0)).drop("segment")
    later = rows.where("segment > 0").select(F.col("conv_id").alias("_conv"), "segment").distinct()
    again = system.join(later, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(*rows.columns)
    rows = rows.union(late.select(*rows.columns)).union(again)

    def segments(batches):
        made = ((conv, segment, w, *x) for (conv, segment), group in groupby(streamed(batches), lambda r: (r[0], r[6])) for w, x in enumerate(windows(group, budget, history)))
        return arrow(made, WINDOW)

    columns = ["conv_id", "turn", "role", "text", "tokens", "before", "segment", "kind"]
    dealt = rows.select(*columns).repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "before", *order)
    return dealt.mapInArrow(segments, "conv_id long, segment long, window int, text string, masked int, starts array<int>, ends array<int>")


def windows(rows, budget: int, history: int):
    """(text, masked, starts, ends) of each window of one segment; rows by kind (system copy, history copy, new)."""
    system, past, now, used, head = [], [], [], 0, None

    def close():
        repeated = [(r, t) for r, t, _ in head]
        text, starts, ends = window_text(repeated + now, len(repeated))
        return text, len(repeated), starts, ends

    for _, _, role, text, tokens, before, _, kind in rows:
        if kind == 0:
            system = [(role, text, tokens)]
        elif kind == 1:
            past.append((role, text, tokens))
        else:
            if now and used + tokens > budget:
                yield close()
                now = []
            if not now:
                head = fitting(system, past, tokens, budget, history)
                used = sum(x[2] for x in head)
            now.append((role, text))
            used += tokens
            if before == 0 and role == "system":
                system = [(role, text, tokens)]
            else:
                past.append((role, text, tokens))
            while sum(x[2] for x in past) > history:
                past.pop(0)
    if now:
        yield close()


def fitting(system: list, past: list, tokens: int, budget: int, history: int) -> list:
    """The system turn if it fits with the new turn, then the latest turns within history and budget."""
    head = system if sum(x[2] for x in system) + tokens <= budget else []
    room, kept = min(history, budget - tokens - sum(x[2] for x in head)), []
    for turn in reversed(past):
        if (room := room - turn[2]) < 0:
            break
        kept.append(turn)
    return head + kept[::-1]


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Windows stream by in order, digests are kept up turn by turn."""

    def digests(batches):
        return arrow((of(conv, group) for conv, group in groupby(streamed(batches), lambda r: r[0])), DIGEST)

    def of(conv, group):
        n, chars, loss_chars, turns, loss = 0, 0, 0, sha256(), sha256()
        for _, _, _, text, masked, starts, ends in group:
            chars += len(text)
            for role, body in read_window(text)[masked:]:
                turns.update(f"{role}\n{body}\n".encode())
                n += 1
            for a, b in zip(starts, ends, strict=True):
                target = unescape(text[a:b])
                loss_chars += len(target)
                loss.update(target.encode())
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    rows = made.select("conv_id", "segment", "window", "text", "masked", "starts", "ends").repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return rows.mapInArrow(digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
