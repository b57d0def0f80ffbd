"""Exact seeded sampling, shuffling and class balancing by hash order.

A row's place in the shuffled order is its hash, so the order is the same for any partitioning. Exact
sample sizes come from counting rows per hash prefix: whole prefixes are taken by a filter and only the
one prefix that holds the cut is sorted.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_column, validate_choice, validate_columns
from ..functions.hashing import SEED, hex_number, row_hash
from .joins import lookup_join

PREFIX_DIGITS = 4


def _hashed(df: DataFrame, key: Sequence[str], seed: int, digits: int = PREFIX_DIGITS) -> DataFrame:
    validate_columns(df, key)
    out = df.withColumn("_h", row_hash(*key, seed=seed))
    return out.withColumn("_p", hex_number(F.col("_h"), 1, digits).cast("int"))


PREFIX_ROWS = 1 << 20  # rows that share a hash prefix, about


def _digits(df: DataFrame) -> int:
    """Hex digits that cut the table into prefixes of at most about PREFIX_ROWS rows."""
    return max(3, math.ceil(math.log(max(1, df.count() / PREFIX_ROWS), 16)))


def shuffle_rows(df: DataFrame, key: Sequence[str], seed: int = SEED, digits: int | None = None) -> DataFrame:
    """Add ``pos``, each row's place (from 0) in a seeded permutation; ``key`` must identify rows.

    Places are counted inside a hash prefix and shifted by the sizes of the prefixes before it.
    """
    rows = _hashed(df, key, seed, digits or _digits(df))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy("_h", *key)) - 1
    return rows.withColumn("_i", inside).join(F.broadcast(_prefix_offsets(rows, [])), "_p").withColumn(
        "pos", F.col("_i") + F.col("_before")
    ).select(*df.columns, "pos")


def _prefix_offsets(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows before each prefix; at most 16^digits rows (per group in ``by``)."""
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_n"))
    line = (Window.partitionBy(*by) if by else Window).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(*by, "_p", "_n", (F.sum("_n").over(line) - F.col("_n")).alias("_before"))


def hash_head(df: DataFrame, key: Sequence[str], n: int, seed: int = SEED) -> DataFrame:
    """The first ``n`` rows of the seeded permutation."""
    rows = _hashed(df, key, seed)
    offsets = _prefix_offsets(rows, [])
    cut = offsets.filter((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n)).first()
    if n <= 0:
        return df.limit(0)
    if cut is None:
        return df
    whole = rows.filter(F.col("_p") < cut["_p"]).select(*df.columns)
    partly = rows.filter(F.col("_p") == cut["_p"]).orderBy("_h", *key).limit(n - cut["_before"]).select(*df.columns)
    return whole.unionByName(partly)


def sample_data(
    df: DataFrame, key: Sequence[str], max_samples: int = -1, max_percent: float = -1, seed: int = SEED
) -> DataFrame:
    """At most ``max_samples`` rows, or ``int(n * max_percent)`` rows; neither keeps all."""
    if max_samples > 0:
        return hash_head(df, key, max_samples, seed)
    if max_percent > 0:
        return hash_head(df, key, int(df.count() * max_percent), seed)
    return df


def balance_undersample(df: DataFrame, label: str, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Every class cut to the size of the smallest, without replacement; unlabelled rows are left out."""
    rows = _hashed(df.filter(as_column(label).isNotNull()), key, seed)
    offsets = _prefix_offsets(rows, [label])
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    smallest = sizes.agg(F.min("_size")).first()[0]
    if smallest is None:
        return df.limit(0)
    cuts = offsets.filter((F.col("_before") < smallest) & (F.col("_before") + F.col("_n") >= smallest)).select(
        label, F.col("_p").alias("_cut"), (F.lit(smallest) - F.col("_before")).alias("_rest")
    )
    placed = lookup_join(rows, cuts, [label], "inner")
    whole = placed.filter(F.col("_p") < F.col("_cut"))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h", *key))
    partly = placed.filter(F.col("_p") == F.col("_cut")).withColumn("_r", rank).filter(F.col("_r") <= F.col("_rest"))
    return whole.select(*df.columns).unionByName(partly.select(*df.columns))


def balance_oversample(df: DataFrame, label: str, key: Sequence[str], seed: int = SEED) -> DataFrame:
    """Smaller classes drawn with replacement to the size of the largest, which is kept as it is.

    Adds ``draw``, the number of the draw within the class (NULL for the kept class). Draw ``j`` of a
    class with ``n`` rows takes the row at the hashed place ``hash(class, j) mod n``.
    """
    rows = _hashed(df.filter(as_column(label).isNotNull()), key, seed, _digits(df))
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size"))
    largest = sizes.agg(F.max("_size")).first()[0]
    if largest is None:
        return df.limit(0).withColumn("draw", F.lit(None).cast("bigint"))
    kept = lookup_join(rows, sizes.filter(F.col("_size") == largest), [label], "inner")
    kept = kept.select(*df.columns, F.lit(None).cast("bigint").alias("draw"))
    small = sizes.filter(F.col("_size") < largest)
    # The draws are listed in blocks so that no single row expands into a whole class, nor lists very many blocks.
    block = max(10_000, math.isqrt(largest))
    blocks = small.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit((largest - 1) // block).cast("bigint"))))
    last = F.least((F.col("_b") + 1) * block, F.lit(largest)) - 1
    draws = blocks.repartition(label, "_b").select(label, "_size", F.explode(F.sequence(F.col("_b") * block, last)).alias("draw"))
    draws = draws.withColumn("_place", F.pmod(hex_number(row_hash(label, "draw", seed=seed)), F.col("_size")))
    members = lookup_join(rows, small, [label], "inner")
    inside = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", *key)) - 1
    offsets = _prefix_offsets(members, [label]).select(label, "_p", "_before")
    placed = members.withColumn("_i", inside).join(offsets, [label, "_p"]).withColumn("_place", F.col("_i") + F.col("_before"))
    drawn = draws.select(label, "_place", "draw").join(placed.select(*df.columns, "_place"), [label, "_place"])
    return kept.unionByName(drawn.select(*df.columns, "draw"))


def balance_classes(df: DataFrame, label: str, key: Sequence[str], method: str = "undersample", seed: int = SEED) -> DataFrame:
    validate_choice("balancing method", method, ["undersample", "oversample"])
    if method == "undersample":
        return balance_undersample(df, label, key, seed)
    return balance_oversample(df, label, key, seed).drop("draw")


def sample_ratio_groups(
    df: DataFrame, key: Sequence[str], groups: Sequence[Sequence[str]], ratio: float = 0.3, seed: int = SEED
) -> list[DataFrame]:
    """One table per attribute group: the key, the group's columns and an independent share of the rows."""
    out = []
    for i, group in enumerate(groups):
        validate_columns(df, [*key, *group])
        draw: Column = hex_number(row_hash(*key, seed=f"group{i}|{seed}"))
        columns = [*key, *[c for c in group if c not in key]]
        out.append(df.filter(draw < int(ratio * 2**32)).select(*[as_column(c) for c in columns]))
    return out
