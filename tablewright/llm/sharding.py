"""Shards of nearly equal bytes that never split equal texts, with DataFrame functions only.

The documents with one text are an atomic group. Groups stand in one order, larger first (equal sizes by hash of the text), and
a shard is a contiguous run of it. The smallest capacity for which a greedy pass needs no more than the shards there are is
found by binary search; the first shard is cut there, and the rest is searched again for the shards left, so a group
larger than a fair share has a shard of its own and does not make the others uneven.

In this order equal sizes stand together, so the search needs only how many groups there are of each size: fewer than
the square root of twice the bytes, whatever the number of documents. That table and the few cut places are all the driver sees.

Null and empty texts are two groups of 8 bytes a document; repeated rows are documents like any other; a null id is kept;
an empty table gives no rows; columns beyond ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import write_table

ROW_BYTES = 8
PIECES = 1 << 16  # ranking pieces of all shards together, at most
PIECE_ROWS = 64  # and rows of a piece, at least
DIGIT = 12  # bits of the order hash that one counting job settles


def minimax_cuts(runs: list[tuple[int, int]], shards: int) -> list[tuple[int, int]]:
    """Where each shard after the first begins: (run, groups of that run before it).

    ``runs`` are (size, number of groups) in order. The largest shard is as small as it can be, then the largest of those after it.
    """
    groups = [0, *accumulate(n for _, n in runs)]
    total = [0, *accumulate(size * n for size, n in runs)]

    def after(place: tuple[int, int], capacity: int) -> tuple[int, int]:
        """The place that a shard from ``place`` reaches when it is filled up to ``capacity``."""
        run, done = place
        limit = total[run] + (runs[run][0] * done if run < len(runs) else 0) + capacity
        run = bisect_right(total, limit) - 1
        return (run, (limit - total[run]) // runs[run][0]) if run < len(runs) else (run, 0)

    def bytes_from(place: tuple[int, int]) -> int:
        return total[-1] - total[place[0]] - (runs[place[0]][0] * place[1] if place[0] < len(runs) else 0)

    cuts, place = [], (0, 0)
    for left in range(shards, 1, -1):
        if place[0] >= len(runs):
            cuts.append(place)
            continue
        largest = max(size for size, _ in runs[place[0] :][:1])
        low, high = max(largest, -(-bytes_from(place) // left)), bytes_from(place)
        high = min(high, low + largest * 2)
        while low < high:
            middle, at = (low + high) // 2, place
            for _ in range(left):
                at = after(at, middle)
            low, high = (low, middle) if at[0] >= len(runs) else (middle + 1, high)
        place = after(place, low)
        cuts.append(place)
    assert groups[-1] == sum(n for _, n in runs)
    return cuts


def _order_thresholds(groups: DataFrame, cuts: list[tuple[int, int]]) -> list[int]:
    """For each (size, rank): the order hash that as many groups of that size as ``rank`` are below. Exact, digit by digit."""
    state = [[0, 63, rank] for _, rank in cuts]  # lower end of the range, its width in bits, rank inside
    while open_ := [i for i, (_, bits, rank) in enumerate(state) if bits and rank]:
        marks = []
        for i in open_:
            low, bits, _ = state[i]
            here = (F.col("bytes") == cuts[i][0]) & (F.col("place") >= low) & (F.col("place") <= low + (1 << bits) - 1)
            digit = F.shiftright(F.col("place") - F.lit(low), max(0, bits - DIGIT))
            marks.append(F.when(here, F.struct(F.lit(i).alias("cut"), digit.alias("digit"))))
        counted = groups.select(F.explode(F.filter(F.array(*marks), lambda x: x.isNotNull())).alias("m")).groupBy("m").count()
        found: dict[int, dict[int, int]] = {i: {} for i in open_}
        for row in counted.collect():  # 2**DIGIT rows a cut at most
            found[row.m.cut][row.m.digit] = row["count"]
        for i in open_:
            low, bits, rank = state[i]
            step = max(0, bits - DIGIT)
            for digit in sorted(found[i]):
                if rank < found[i][digit]:
                    break
                rank -= found[i][digit]
            else:
                digit, rank = 1 << (bits - step), 0
            state[i] = [low + (digit << step), step, rank]
    return [low for low, _, _ in state]


def assign_shards(groups: DataFrame, shards: int) -> Column:
    """Shard of a group as an expression of its ``bytes`` and ``place``."""
    runs = sorted(((r.bytes, r.n) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()), reverse=True)
    cuts = [(runs[run][0] if run < len(runs) else 0, done) for run, done in minimax_cuts(runs, shards)]
    starts = zip(cuts, _order_thresholds(groups, cuts), strict=True)
    passed = [
        ((F.col("bytes") < size) | ((F.col("bytes") == size) & (F.col("place") >= place))).cast("int") for (size, _), place in starts
    ]
    return sum(passed, F.lit(0))


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """Every document with size, CRC, law, shard, and its slot in the shard (gapless from 0)."""
    text = F.col("text")
    slim = write_table(
        docs.select(
            "doc_id",
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64(text, text.isNull()).alias("grp"),
        ),
        "sizes",
    )
    # A group's documents are summed where they are read; only one row a group and task moves.
    groups = write_table(
        slim.groupBy("grp").agg(F.sum("size").alias("bytes")).withColumn("place", F.shiftrightunsigned("grp", 1)), "groups"
    )
    shard = assign_shards(groups, shards).cast("int")
    # One row a group on the right; a group with many documents is split by the skew join of adaptive execution.
    placed = write_table(slim.join(groups.select("grp", shard.alias("shard")), "grp"), "placed")
    return with_slots(placed, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def with_slots(placed: DataFrame, shards: int) -> DataFrame:
    """Number the rows of each shard: ranked inside small pieces, which begin where the pieces before them end."""
    rows = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    per_piece = max(PIECE_ROWS, -(-sum(rows.values()) // PIECES))
    pieces = F.array(*[F.lit(-(-rows.get(s, 0) // per_piece) or 1) for s in range(shards)])
    dealt = placed.withColumn("piece", F.pmod(F.xxhash64("doc_id", "grp"), F.element_at(pieces, F.col("shard") + 1)).cast("int"))
    counts = dealt.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(W.partitionBy("shard", "piece").orderBy("doc_id", "size", "text_crc32"))
    # At most PIECES + shards rows.
    return dealt.withColumn("rank", inside).join(F.broadcast(starts), ["shard", "piece"]).withColumn("slot", F.col("start") + F.col("rank") - 1)
