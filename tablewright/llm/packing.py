"""Documents packed into sequences of fixed length with every window of sequences in the target mixture of sources.

Each source is a queue of documents in the order they are read. Deficit round-robin serves the queues by quanta of tokens:
in each window a source adds its share of the window to its credit, and sends the tokens that its credit covers; what is
left of the credit (less than a token, since documents may be cut) is carried to the next window, and from one partition to the next.
When a queue is empty its share goes to the others in proportion, so every window but the last is full. Sequences are cut from the
windows one after the other, so only the very last sequence needs padding.

The credit after any number of windows has a closed form, so nothing is served one by one: a task needs only how many tokens
of a source the partitions before it hold. Token ids are written once and never shuffled.

A null text is an empty document (its end id only); null ids and null sources are kept (null is a queue of its own); repeated
rows are documents of their own; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import bound_batches, new_path
from .textbytes import slices
from .tokens import encoder

LENGTH = 2048
WINDOW_SEQUENCES = 64
BROADCAST_STARTS = 200_000  # rows of (partition, source) up to which their starts are broadcast: a few MB


class Schedule:
    """How many tokens of each queue have been served after any number of windows."""

    def __init__(self, totals: list[int], weights: list[Fraction | int], window: int):
        self.totals, self.window, self.all = totals, window, sum(totals)
        self.windows = -(-self.all // window)
        self.phases: list[tuple[Fraction, list[Fraction], list[Fraction]]] = []  # tokens served before, by queue, and rates
        served, at = [Fraction(0)] * len(totals), Fraction(0)
        while at < self.all:
            open_ = [i for i, total in enumerate(totals) if served[i] < total]
            share = {i: Fraction(weights[i]) for i in open_ if weights[i] > 0} or {i: totals[i] - served[i] for i in open_}
            rates = [share.get(i, Fraction(0)) / sum(share.values()) for i in range(len(totals))]
            self.phases.append((at, served, rates))
            step = min((totals[i] - served[i]) / rates[i] for i in share)
            served, at = [s + step * r for s, r in zip(served, rates, strict=True)], at + step
        self.held: dict[int, tuple[list[int], list[int]]] = {}

    def served(self, window: int) -> list[int]:
        x = window * self.window
        if x >= self.all:
            return self.totals
        at, base, rates = next(p for p in reversed(self.phases) if p[0] <= x)
        return [int(b + r * (x - at)) for b, r in zip(base, rates, strict=True)]

    def edges(self, window: int) -> tuple[list[int], list[int], list[int]]:
        """By queue: its tokens before the window and up to its end, and where its part of the window begins among all tokens."""
        if window not in self.held:
            if len(self.held) > 64:
                self.held.clear()
            low, high = self.served(window), self.served(window + 1)
            self.held[window] = low, high, list(accumulate((b - a for a, b in zip(low, high, strict=True)), initial=sum(low)))
        return self.held[window]

    def find(self, queue: int, token: int, hint: int) -> int:
        """The window that serves a token of a queue; ``hint``: a window not after it."""
        step, low = 1, hint
        while self.edges(low + step)[0][queue] <= token and low + step < self.windows:
            low, step = low + step, step * 2
        high = min(low + step, self.windows)
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.edges(middle)[0][queue] <= token else (low, middle)
        return low


def _encode(tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, before = encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for rows, data, starts in slices(batch):
                ids, counts = enc.encode(data, starts)
                ids = np.insert(ids, np.cumsum(counts), end_id).astype("<u4" if enc.dtype == np.uint32 else "<u2")
                counts = counts + 1
                offsets = np.append(0, np.cumsum(counts)) * ids.itemsize
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.tobytes())])
                ahead = []
                for source, n in zip(rows.column("source").to_pylist(), counts.tolist(), strict=True):
                    ahead.append(before[source])
                    before[source] += n
                columns = [pa.array(np.full(len(counts), part, np.int32)), rows.column("source"), rows.column("doc_id"), pa.array(ahead, pa.int64()), pa.array(counts), packed.cast(pa.binary())]
                yield pa.record_batch(columns, names=["part", "source", "doc_id", "ahead", "n", "ids"])

    return run


def _cut(schedule: Schedule, queues: Mapping[str | None, int], width: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hint: dict[int, tuple[int, int]] = {}
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "source", "start", "n")]
            for doc_id, source, first, n, ids in zip(*columns, batch.column("ids"), strict=True):
                ids = np.frombuffer(ids.as_buffer(), f"<u{width}").astype("<u4")
                queue, at = queues[source], first
                token, window = hint.get(queue, (0, 0))
                window = window if token <= first else 0
                while at < first + n:
                    window = schedule.find(queue, at, window)
                    low, high, place = (x[queue] for x in schedule.edges(window))
                    end = min(high, first + n)
                    while at < end:
                        spot = place + at - low
                        take = min(end - at, length - spot % length)
                        crc = zlib.crc32(ids[at - first : at - first + take])
                        out.append((doc_id, at - first, take, crc, n, spot // length, spot % length))
                        at += take
                hint[queue] = first, window
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.record_batch([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], names=names)

    return run


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    mixture: Mapping[str | None, int] | None = None,
    length: int = LENGTH,
    window_sequences: int = WINDOW_SEQUENCES,
) -> DataFrame:
    """One row a piece: document, tokens of it before the piece, length, CRC, the document's tokens, sequence and offset.

    ``mixture``: weights by source; sources without one come when the others are used up. Without a mixture it is that of
    the corpus, which then holds in every window. There is one queue a source, and the driver knows one total a queue.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = new_path(spark, "token_ids")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    kinds = "part int, source string, doc_id long, ahead long, n long, ids binary"
    slim.mapInArrow(_encode(tokenizer, end_id), kinds).write.option("compression", "zstd").parquet(path)
    ids = spark.read.parquet(path)

    parts = ids.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select(F.col("source").alias("queue"), F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r.source: r.n for r in parts.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    queues = {source: i for i, source in enumerate(sorted(totals, key=lambda s: (s is not None, s)))}
    weights = [totals[s] if mixture is None else mixture.get(s, 0) for s in queues]
    schedule = Schedule([totals[s] for s in queues], weights, window_sequences * length)

    if starts.count() <= BROADCAST_STARTS:
        starts = F.broadcast(starts)
    found = ids.join(starts, (F.col("part") == F.col("of")) & F.col("source").eqNullSafe(F.col("queue")))
    pieces = found.select("doc_id", "source", (F.col("base") + F.col("ahead")).alias("start"), "n", "ids")
    width = encoder(tokenizer).dtype().itemsize
    columns = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.mapInArrow(_cut(schedule, queues, width, length), columns)
