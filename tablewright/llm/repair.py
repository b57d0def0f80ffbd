"""Repair of conversations: the cheapest edits that bring the roles back to turns, with an audit letter for every edit.

Rows have a fault (blank, duplicate or truncated text) and are kept (K, cost 0), given the role the turn needs (R, 2) or deleted (D, 3;
required for blank and duplicate rows); turns without text are inserted (I, 2); a truncated row that stays costs 1 more. What stays is one system
turn at most, then pairs of user and assistant. Among the cheapest ways the audit that is least in ASCII order is taken.

The edits are the edges of a graph from state to state, row by row. A path's weight is one integer: its cost in the high digits and, below,
the letters of its audit in places of three bits, first letter highest, zeros after the last. Prepending an edge adds its cost, moves the letters
by one place and puts its own in front, so the least integer decides cost and ties at once.

A graph covers at most ``BLOCK`` rows. A longer conversation is read twice: once from its end, which gives the cost still to come
after each block (costs are enough there: of two edges with the same letter from one state there is never a choice), then block by block from
its start. A task holds one block of one conversation; only the audit, one letter an edit, and the running hash go along.

Nulls in any of the four columns are read as one space, but a null conv_id stays a conversation of its own, null turns come first, and
gaps ignore them. Rows of one turn are ordered by role, then text. Equal rows are counted before they are moved. A role counts by its first
letter; one that is not s, u or a (an empty one too) cannot be kept. Empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..session import write_table

BLOCK = 256
BLANKS = " \t\n\x0b\f\r"
LETTERS = ".DIKR"  # by digit, in ASCII order; the padding is 0
D, I, K, R = 1, 2, 3, 4
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = (USER, USER, ASSISTANT, USER)  # the state that a user or assistant turn leads to
NAMES = ("", "", "user", "assistant")
FAR = 1 << 60  # more than any cost
RESULT = {"gaps": LongType(), "blank": LongType(), "duplicate": LongType(), "truncated": LongType(), "illegal": LongType(), "cost": LongType(), "audit": StringType(), "repaired_sha256": StringType()}


def _prepend(weight: int, cost: int, letter: int, width: int) -> int:
    """The weight with an edge in front: its cost above, its letter as the first of ``width`` places."""
    bits = 3 * width
    high, low = weight >> bits, weight & ((1 << bits) - 1)
    return (high + cost << bits) | (letter << bits - 3 if width else 0) | low >> 3


def _insertions(weights: list[int], width: int) -> list[int]:
    """Weights of the states where turns may be inserted first; two are enough, three would be a pair for nothing."""
    for _ in range(2):
        weights = [min(w, _prepend(weights[NEEDS[s]], 2, I, width)) for s, w in enumerate(weights)]
    return weights


def _before(weights: list[int], role: str, forced: int, truncated: bool, width: int) -> list[int]:
    """Weights of the states before a row from those after it. ``forced``: copies of a row that must go, 0 for a row that may stay."""
    found = []
    for s in range(4):
        edges = [_prepend(weights[s], 3 * max(1, forced), D, width)]
        if not forced:
            edges.append(_prepend(weights[NEEDS[s]], 2 + truncated, R, width))
            if role == "s" and s == START:
                edges.append(_prepend(weights[SYSTEM], truncated, K, width))
            if role == NAMES[NEEDS[s]][0]:
                edges.append(_prepend(weights[NEEDS[s]], truncated, K, width))
        found.append(min(edges))
    return _insertions(found, width)


def _end(width: int) -> list[int]:
    return _insertions([w << 3 * width for w in (0, FAR, FAR, 0)], width)


def _plan(rows: list[tuple[str, int, bool]], after: list[int] | None, start: int) -> list[int]:
    """The audit digits of a block of (role letter, forced copies, truncated) from a state; ``after``: costs of the states after it,
    None at the conversation's end."""
    width = 3 * len(rows) + 2
    weights = _end(width) if after is None else [cost << 3 * width for cost in after]
    for row in reversed(rows):
        weights = _before(weights, *row, width)
    digits, low = [], weights[start] & ((1 << 3 * width) - 1)
    for place in range(width - 1, -1, -1):
        digit = low >> 3 * place & 7
        if not digit:
            break
        digits.append(digit)
    return digits


class Conversation:
    """The running state of a conversation that is repaired block by block."""

    def __init__(self) -> None:
        self.turns, self.first, self.last = 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.before: str | None = None
        self.audit: list[str] = []
        self.state, self.empty = START, True
        self.hash = hashlib.sha256()
        self.block: list[dict] = []

    def read(self, row: dict) -> None:
        """Count one row of ``copies`` equal ones; the rows after the first are duplicates."""
        copies, letter = row["copies"], row["role"][:1]
        if row["turn"] is not None and row["turn"] != self.last:
            self.first = row["turn"] if self.first is None else self.first
            self.turns, self.last = self.turns + 1, row["turn"]
        if self.before is not None:
            self.illegal += self.before + letter not in ("su", "ua", "au")
        self.illegal += copies - 1  # a letter beside itself
        self.before = letter
        stays = not row["blank"] and row["fresh"]
        if row["blank"]:
            self.blank += copies
        else:
            self.duplicate += copies - stays
            self.truncated += stays and row["truncated"]
        if stays:
            self.block.append({**row, "forced": 0})
        if copies > stays:
            self.block.append({**row, "forced": copies - stays, "truncated": False})

    def settle(self, after: list[int] | None) -> None:
        rows = [(row["role"][:1], row["forced"], row["truncated"]) for row in self.block]
        at = iter(self.block)
        for digit in _plan(rows, after, self.state):
            row = next(at) if digit != I else None
            self.audit.append(LETTERS[digit] * (row["forced"] or 1 if row else 1))
            if digit == D:
                self.cost += 3 * (row["forced"] or 1)
                continue
            self.cost += (0 if digit == K else 2) + (row["truncated"] if row else 0)
            self.state = SYSTEM if digit == K and row["role"][:1] == "s" else NEEDS[self.state]
            role = row["role"] if digit == K else NAMES[self.state]
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{row['text'] if row else ''}".encode())
            self.empty = False
        self.block = []

    def result(self) -> list:
        self.settle(None)
        gaps = min(self.last - self.first + 1 - self.turns, (1 << 63) - 1) if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()]


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows ordered by conversation and turn: one row a conversation."""
    now, conversation = None, None
    names = ["conv_id", *RESULT]

    def made(done: list[list]) -> pa.RecordBatch:
        kinds = [conv_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        done, conv_type = [], batch.schema.field("conv_id").type
        for at in range(0, batch.num_rows, 500):
            for row in batch.slice(at, 500).to_pylist():
                if conversation is None or row["conv_id"] != now:
                    if conversation is not None:
                        done.append([now, *conversation.result()])
                    now, conversation = row["conv_id"], Conversation()
                if row["copies"]:
                    conversation.read(row)
                if row["after"] is not None:
                    conversation.settle(row["after"])
        if done:
            yield made(done)
    if conversation is not None:
        yield made([[now, *conversation.result()]])


def _costs_to_come(block: int):
    """Task function over rows in reverse order: the last row of each block of ``block`` rows gets the costs after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, weights, size = None, None, 0
        for batch in batches:
            after = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "copies", "blank", "fresh", "truncated")]
            for conv, role, copies, blank, fresh, truncated in zip(*columns, strict=True):
                if weights is None or conv != now:
                    now, weights, size = conv, _end(0), 0
                    after.append(None)
                else:
                    after.append(weights if size and size % block == 0 else None)
                size += 1
                stays = copies > 0 and fresh and not blank
                if copies > stays:
                    weights = _before(weights, "", copies - stays, False, 0)
                if stays:
                    weights = _before(weights, role[:1], 0, truncated, 0)
            yield pa.record_batch([*batch.drop_columns(["after"]).columns, pa.array(after, pa.list_(pa.int64()))], names=[*[n for n in batch.schema.names if n != "after"], "after"])

    return run


def _order(reverse: bool = False) -> list[Column]:
    turn = F.desc_nulls_last("turn") if reverse else F.asc_nulls_first("turn")
    return [turn, *[F.desc(c) if reverse else F.asc(c) for c in ("role", "text")]]


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text, copies): conv_id and the columns of ``RESULT``.

    ``copies``: how many equal rows a row stands for; a conversation may have a row of 0 copies only, and then its result is empty.
    """
    cols = ["conv_id", "turn", "role", "text"]
    counted = rows.groupBy(*cols).agg(F.sum("copies").alias("copies"))
    seen = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("copies") == 0, F.asc_nulls_first("turn"))
    trimmed = F.rtrim("text", F.lit(BLANKS))
    marked = write_table(
        counted.withColumns(
            {
                "fresh": F.row_number().over(seen) == 1,
                "blank": trimmed == "",
                "truncated": ~F.substring(trimmed, -1, 1).isin(".", "!", "?"),
                "after": F.lit(None).cast("array<long>"),
            }
        ),
        "turns",
    )
    long = marked.groupBy("conv_id").count().where(F.col("count") > block).select(F.col("conv_id").alias("of"))
    if not long.isEmpty():
        same = F.col("conv_id").eqNullSafe(F.col("of"))
        tail = marked.join(long, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", *_order(reverse=True))
        marked = marked.join(long, same, "left_anti").union(tail.mapInArrow(_costs_to_come(block), marked.schema))
    kind = rows.schema["conv_id"].dataType
    schema = StructType([StructField("conv_id", kind), *[StructField(n, t) for n, t in RESULT.items()]])
    return marked.repartition("conv_id").sortWithinPartitions("conv_id", *_order()).mapInArrow(_repair, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows for :func:`repair` with faults put in by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties its text, 2 removes its sentence
    marks, 3 repeats it, 4 makes it the user's. A dropped row stays as one of 0 copies, so that its conversation is not lost."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    gone = fault == 0
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    return conversations.select(
        "conv_id",
        F.when(~gone, F.col("turn")).cast("long").alias("turn"),
        F.when(gone, "").when(fault == 4, "user").otherwise(shown("role")).alias("role"),
        F.when(gone, "").otherwise(text).alias("text"),
        F.when(gone, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )
