"""Order statistics without putting a whole column into one task.

A global sort order is cut into consecutive value ranges (buckets). Windows run inside one bucket
at a time; what a row needs from the neighbouring buckets is added as an offset (counts below) or as
a few copied border rows (halo), so the result is the same for any number of buckets.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_column, number
from ..session import cut_lineage
from .joins import bounded

BUCKET_ROWS = 1_000_000
MAX_BUCKETS = 10_000
SKETCH_K = 4000
SKETCH_GROUPS = 256


def sketch(df: DataFrame, columns: dict[str, Column]) -> dict[str, tuple[int, bytes | None]]:
    """A quantile sketch and the non-null count per expression, merged in two levels."""
    names = list(columns)
    partial = (
        df.select(*[columns[c].alias(f"v{i}") for i, c in enumerate(names)])
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("_g"))
        .agg(
            *[F.kll_sketch_agg_double(f"v{i}", SKETCH_K).alias(f"s{i}") for i in range(len(names))],
            *[F.count(f"v{i}").alias(f"n{i}") for i in range(len(names))],
        )
    )
    row = partial.agg(
        *[F.kll_merge_agg_double(f"s{i}", SKETCH_K).alias(f"s{i}") for i in range(len(names))],
        *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(names))],
    ).first()
    return {c: (row[f"n{i}"] or 0, row[f"s{i}"]) for i, c in enumerate(names)}


def sketch_quantiles(df: DataFrame, sketched: dict[str, bytes], probs: dict[str, list[float]]) -> dict[str, list[float]]:
    """Read quantiles off the sketches."""
    names = [c for c in probs if probs[c]]
    if not names:
        return {}
    one = df.sparkSession.range(1)
    row = one.select(
        *[
            F.kll_sketch_get_quantile_double(
                F.lit(bytes(sketched[c])), F.array(*[F.lit(float(p)) for p in probs[c]])
            ).alias(f"q{i}")
            for i, c in enumerate(names)
        ]
    ).first()
    return {c: list(row[f"q{i}"]) for i, c in enumerate(names)}


def range_bounds(df: DataFrame, columns: dict[str, Column], bucket_rows: int | None = None) -> dict[str, list[float]]:
    """Inner bounds that cut each expression into ranges of about ``bucket_rows`` rows; none where one range will do."""
    bucket_rows = bucket_rows or BUCKET_ROWS
    counts = df.agg(*[F.count(col).alias(f"n{i}") for i, col in enumerate(columns.values())]).first()
    wanted = {c: min(MAX_BUCKETS, math.ceil(counts[i] / bucket_rows)) for i, c in enumerate(columns)}
    split = {c: columns[c].cast("double") for c in columns if wanted[c] > 1}
    bounds: dict[str, list[float]] = {}
    if split:
        sketched = sketch(df, split)
        probs = {c: [j / wanted[c] for j in range(1, wanted[c])] for c in split}
        bounds = sketch_quantiles(df, {c: sketched[c][1] for c in split}, probs)
    return {c: sorted(set(bounds.get(c, []))) for c in columns}


def in_range(df: DataFrame, value: Column, bounds: list[float], name: str) -> DataFrame:
    """Add ``name``: the index of the range that ``value`` falls in, as an int."""
    if not bounds:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=[-math.inf, *bounds, math.inf], inputCol="_v", outputCol="_d", handleInvalid="keep")
    out = cut.transform(df.withColumn("_v", value.cast("double")))
    return out.withColumn(name, F.col("_d").cast("int")).drop("_v", "_d")


def bucketed(df: DataFrame, columns: dict[str, Column], bucket_rows: int | None = None) -> DataFrame:
    """Add ``_b_<name>``: the index of the value range each expression falls in, as an int."""
    bounds = range_bounds(df, columns, bucket_rows)
    for c, col in columns.items():
        df = in_range(df, col, bounds[c], f"_b_{c}")
    return df


def sorted_counts(df: DataFrame, columns: list[str], bucket_rows: int | None = None) -> DataFrame:
    """``column, _bucket, value, n, below, total`` per distinct value of each numeric column.

    ``below`` is the number of smaller non-null values. Equal values are counted before the shuffle,
    so one hot value is one row.
    """
    exprs = {c: number(df, c) for c in columns}
    wide = bucketed(df.select(*[exprs[c].alias(c) for c in columns]), {c: as_column(c) for c in columns}, bucket_rows)
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.col(f"_b_{c}").alias("_bucket"), as_column(c).alias("value"))
                for c in columns
            ]
        )
    )
    long = wide.select(cells.alias("r")).select("r.*").filter(F.col("value").isNotNull())
    counted = long.groupBy("column", "_bucket", "value").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("column", "_bucket").orderBy("value")
    counted = counted.withColumn(
        "below", F.sum("n").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    )
    totals = long.groupBy("column", "_bucket").agg(F.count("*").alias("_n"))
    per_column = Window.partitionBy("column")
    before = per_column.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    offsets = totals.select(
        "column",
        "_bucket",
        (F.sum("_n").over(before) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(per_column).alias("total"),
    )
    return (
        counted.join(bounded(offsets, MAX_BUCKETS * max(1, len(columns))), ["column", "_bucket"])
        .withColumn("below", F.col("below") + F.col("_offset"))
        .drop("_offset")
    )


def with_halo(df: DataFrame, by: list[str], order: str, before: int, after: int) -> DataFrame:
    """Copy border rows between buckets: the last ``before`` rows of the preceding buckets and the first
    ``after`` rows of the following ones, marked by ``_halo``.

    Only buckets that hold rows exist in ``_bucket``, so reaching ``before`` buckets back is enough.
    """
    reach = max(before, after)
    keys = [*by, "_bucket"]
    fields = [c for c in df.columns if c not in keys]
    up = Window.partitionBy(*keys).orderBy(order)
    down = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    row = F.struct(F.col(order).alias("_o"), *[F.col(c) for c in fields])
    ranked = df.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down))
    edges = (
        ranked.filter((F.col("_up") <= after) | (F.col("_down") <= before))
        .groupBy(*keys)
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("_up") <= after, row))).alias("_first"),
            F.sort_array(F.collect_list(F.when(F.col("_down") <= before, row))).alias("_last"),
        )
    )
    line = Window.partitionBy(*by).orderBy("_bucket") if by else Window.orderBy("_bucket")
    prev = F.flatten(F.collect_list("_last").over(line.rowsBetween(-reach, -1)))
    nxt = F.flatten(F.collect_list("_first").over(line.rowsBetween(1, reach)))
    halo = edges.select(
        *keys,
        F.concat(
            F.slice(prev, F.greatest(F.lit(1), F.size(prev) - before + 1), F.lit(max(before, 1)))
            if before
            else F.slice(nxt, 1, 0),
            F.slice(nxt, 1, after),
        ).alias("_rows"),
    )
    halo = halo.select(*keys, F.explode("_rows").alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in fields])
    return df.withColumn("_halo", F.lit(False)).unionByName(halo.withColumn("_halo", F.lit(True)))


def dense_index(values: DataFrame, column: str, name: str) -> DataFrame:
    """Add the position (from 0) of each distinct value in sorted order.

    Few values are ranked in one window. Many are range-partitioned, written once so that the ranges
    stay fixed, ranked inside their range and shifted by the sizes of the ranges before.
    """
    small = bounded(values)
    if small is not None:
        return small.withColumn(name, F.row_number().over(Window.orderBy(column)) - 1)
    ranged = cut_lineage(values.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(column)) - 1
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    offsets = sizes.select("_part", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    ranked = ranged.withColumn("_i", inside).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_i") + F.col("_before")).drop("_part", "_i", "_before")
