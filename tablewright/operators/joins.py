"""Lookups that stay safe when the key is skewed or the lookup table is large."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column
from ..session import write_table

BROADCAST_ROWS = 50_000
HOT_SHARE = 1000
CELL_PAIRS = 1_000_000
CELLS = 4096
# Copies of a hot row above which rows are sent to all tasks instead; the bytes sent, in all and at a time; rows a task makes with them, and most tasks.
COPIES = 16
SENT_BYTES, SENT_AT_ONCE = 128 << 20, 8 << 20
TASK_ROWS, MOST_TASKS = 4_000_000, 10_000


def bounded(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """A broadcast copy of ``df`` if it has at most ``max_rows`` rows, else None.

    At most ``max_rows + 1`` rows ever reach the driver.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return None
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def lookup_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "left", max_rows: int = BROADCAST_ROWS, counted: DataFrame | None = None
) -> DataFrame:
    """Join ``left`` to a table with one row per key.

    A lookup table proven small is broadcast. A larger one is joined by shuffle, except for the keys
    that hold more than 1/1000 of the left rows: there are fewer than 1000 of those, so their lookup
    rows are broadcast and the hot left rows are never shuffled. Where ``left`` takes work to make, ``counted`` is a stored
    table with its keys, in which they are counted.
    """
    small = bounded(right, max_rows)
    if small is not None:
        return left.join(small, on, how)
    counted = left if counted is None else counted
    keys = counted.groupBy(*on).agg(F.count("*").alias("_n"))
    floor = max(1, counted.count() // HOT_SHARE)
    hot_keys = keys.filter(F.col("_n") > floor).select(*on).na.drop()
    if hot_keys.isEmpty():
        return left.join(right, on, how)
    hot = bounded(hot_keys, HOT_SHARE)
    hot_right = bounded(right.join(hot, on, "left_semi"), HOT_SHARE)
    is_null = reduce(lambda a, b: a | b, [as_column(c).isNull() for c in on])
    hot_rows = left.join(hot, on, "left_semi").join(hot_right, on, how)
    cold_rows = left.join(hot, on, "left_anti").filter(~is_null).join(right, on, how)
    parts = hot_rows.unionByName(cold_rows)
    if how == "left":
        unmatched = left.filter(is_null)
        parts = parts.unionByName(unmatched, allowMissingColumns=True)
    return parts


def dealt_join(
    left: DataFrame, right: DataFrame, on: dict[str, str], pairs: int | None = None, null_equal: bool = False, tasks: int | None = None
) -> DataFrame:
    """Inner join on ``on`` (left column: right column, all columns differently named) that splits keys with many rows on both sides.

    The rows of each key are counted on both sides. A key is hot where it gives more than ``pairs`` pairs (``CELL_PAIRS``); all other keys
    are joined once, as they are. Each side of a hot key is dealt into blocks by a hash of the whole row, the other side is copied to every
    block, and each pair of blocks is joined on its own. The grid is that with the fewest copies: nearly square blocks, or one side whole
    where it is small. A key has about ``CELLS`` pairs of blocks at most, so that the copies grow as its rows do, not as its pairs. Where a
    hot row would have over ``COPIES`` copies and the lesser sides of the hot keys have ``SENT_BYTES`` at most, these are sent to all tasks
    and the other sides' rows are dealt over as many tasks as their pairs need, so no row is shuffled twice.
    With ``null_equal`` missing keys are a value like any other. With ``tasks`` the keys and blocks are dealt over that many tasks, however
    few bytes the two sides have.
    """
    limit = pairs or CELL_PAIRS
    keys = list(on.items())

    def usable(df: DataFrame, columns: list[str]) -> DataFrame:
        return df if null_equal else df.na.drop(subset=columns)

    def counted(df: DataFrame, columns: list[str], n: str, names: list[str]) -> DataFrame:
        return usable(df, columns).groupBy(*[as_column(c).alias(k) for c, k in zip(columns, names)]).agg(F.count("*").alias(n))

    def same(a: list[str], b: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [as_column(p).eqNullSafe(as_column(q)) if null_equal else as_column(p) == as_column(q) for p, q in zip(a, b)])

    def spread(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.repartition(tasks, *[as_column(c) for c in columns]).hint("merge") if tasks else df

    ours, theirs = [a for a, _ in keys], [b for _, b in keys]
    kl, kr = [f"_l{i}" for i in range(len(keys))], [f"_r{i}" for i in range(len(keys))]
    both = counted(left, ours, "_nl", kl).join(counted(right, theirs, "_nr", kr), same(kl, kr))
    product = F.col("_nl").cast("double") * F.col("_nr")
    cell = F.greatest(F.lit(float(limit)), product / CELLS)
    side = F.sqrt(cell)
    hot = both.filter(product > limit).select(
        *kl,
        "_nl",
        "_nr",
        F.ceil(F.when(F.col("_nr") < side, product / cell).otherwise(F.greatest(F.lit(1.0), F.col("_nl") / side))).cast("int").alias("_rows"),
        F.ceil(F.when(F.col("_nl") < side, product / cell).otherwise(F.greatest(F.lit(1.0), F.col("_nr") / side))).cast("int").alias("_cols"),
    )
    small = bounded(hot)
    if small is None:
        small = hot
    elif small.isEmpty():
        return spread(left, ours).join(spread(right, theirs), same(ours, theirs))
    elif (parts := _sent(left, right, small, ours, theirs, kl, same, tasks)) is not None:

        def cold(df: DataFrame, columns: list[str]) -> DataFrame:
            return usable(df, columns).join(small.select(*kl), same(columns, kl), "left_anti")

        whole = spread(cold(left, ours), ours).join(spread(cold(right, theirs), theirs), same(ours, theirs))
        return reduce(DataFrame.unionByName, parts, whole)
    none = F.lit(0)

    def dealt(df: DataFrame, columns: list[str], own: str, other: str, mine: str, copied: str) -> DataFrame:
        grid = small.select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(kl)], F.col("_rows"), F.col("_cols"))
        sized = usable(df, columns).join(grid, same(columns, [f"_g{i}" for i in range(len(keys))]), "left")
        block = F.pmod(F.xxhash64(*[as_column(c) for c in df.columns]), F.coalesce(own, F.lit(1))).cast("int")
        every = F.sequence(none, F.coalesce(other, F.lit(1)) - 1)
        return sized.withColumn(mine, block).withColumn(copied, F.explode(every)).select(*[as_column(c) for c in df.columns], mine, copied)

    a = spread(dealt(left, ours, "_rows", "_cols", "_i1", "_j1"), [*ours, "_i1", "_j1"])
    b = spread(dealt(right, theirs, "_cols", "_rows", "_j2", "_i2"), [*theirs, "_i2", "_j2"])
    cells = (F.col("_i1") == F.col("_i2")) & (F.col("_j1") == F.col("_j2"))
    return a.join(b, same(ours, theirs) & cells).drop("_i1", "_j1", "_i2", "_j2")


def _sent(
    left: DataFrame, right: DataFrame, hot: DataFrame, ours: list[str], theirs: list[str], names: list[str], same: Callable, tasks: int | None
) -> list[DataFrame] | None:
    """The hot keys' pairs, the side of a key with fewer rows broadcast in chunks; None where :func:`dealt_join` makes blocks of them."""
    rows, copies = hot.agg(F.sum(F.col("_nl") + F.col("_nr")), F.sum(F.col("_nl") * F.col("_cols") + F.col("_nr") * F.col("_rows"))).first()
    if copies <= COPIES * rows:
        return None
    sides = []
    for mine, other, a, b, less in ((left, right, ours, theirs, "_nr <= _nl"), (right, left, theirs, ours, "_nr > _nl")):
        keys = hot.filter(less)
        pairs = keys.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0]
        if pairs:
            few = other.join(F.broadcast(keys.select(*names)), same(b, names), "left_semi")
            sides.append((mine, few, keys, pairs, a, b, few.agg(F.sum(_row_bytes(few))).first()[0] or 0))
    if sum(size for *_, size in sides) > SENT_BYTES:
        return None
    parts = []
    for mine, few, keys, pairs, a, b, size in sides:
        chunks = max(1, math.ceil(size / SENT_AT_ONCE))
        if chunks > 1:
            few = write_table(few.withColumn("_chunk", F.pmod(F.monotonically_increasing_id(), F.lit(chunks))), "hot")
        many = mine.join(F.broadcast(keys.select(*names)), same(a, names), "left_semi")
        many = many.repartition(tasks or min(MOST_TASKS, math.ceil(pairs / TASK_ROWS / chunks)))
        for chunk in range(chunks):
            some = few.filter(F.col("_chunk") == chunk).drop("_chunk") if chunks > 1 else few
            parts.append(many.join(F.broadcast(some), same(a, b)))
    return parts


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    sizes = [F.coalesce(F.octet_length(as_column(c).cast("string")), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    return reduce(lambda x, y: x + y, sizes, F.lit(64 + 16 * len(df.columns)).cast("long"))
