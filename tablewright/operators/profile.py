"""Column profiles: one aggregate over all columns, reported one row per column."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import (
    as_column,
    data_type,
    is_numeric,
    long_rows,
    missing,
    number,
    numeric_columns,
    text_columns,
    validate_columns,
)
from ..functions.numbers import FORMATS, classify_numeric_format, dominant_format, parse_number
from ..functions.probability import correlation
from .quantiles import exact_quantiles

QUARTILES = [0.25, 0.5, 0.75]


def numeric_profile(
    df: DataFrame, columns: list[str] | None = None, min_ratio: float = 0.8, ignore_null: bool = True
) -> DataFrame:
    """Which columns hold numbers, natively or as text, and in which format.

    Columns that are neither numeric nor text stay ``unknown``.
    """
    names = validate_columns(df, columns or df.columns)
    # Each cell is classified once, in a projection below the counts.
    text = {i for i, c in enumerate(names) if isinstance(data_type(df, c), T.StringType)}
    cells = [missing(df, c).alias(f"m{i}") for i, c in enumerate(names)]
    cells += [classify_numeric_format(names[i]).alias(f"f{i}") for i in sorted(text)]
    aggs: list[Column] = [F.count("*").alias("n")]
    for i in range(len(names)):
        aggs.append(F.count_if(f"m{i}").alias(f"m{i}"))
        if i in text:
            aggs += [F.count_if(F.col(f"f{i}") == f).alias(f"f{i}_{f}") for f in FORMATS]
    row = df.select(*cells).agg(*aggs)
    records = []
    for i, c in enumerate(names):
        total, absent = F.col("n"), F.col(f"m{i}")
        present = total - absent
        if is_numeric(df, c):
            verdict, ratio, count, kind = F.lit(True), F.lit(1.0), present, F.lit("native_numeric")
        elif isinstance(data_type(df, c), T.StringType):
            counts = {f: F.col(f"f{i}_{f}") for f in FORMATS}
            count = sum(list(counts.values())[1:], counts["integer"])
            base = present if ignore_null else total
            ratio = F.coalesce(F.try_divide(count.cast("double"), base.cast("double")), F.lit(0.0))
            verdict, kind = ratio >= min_ratio, dominant_format(counts)
        else:
            verdict, ratio, count, kind = F.lit(False), F.lit(0.0), F.lit(0), F.lit("unknown")
        records.append(
            {
                "column": F.lit(c),
                "is_numeric": verdict,
                "numeric_ratio": ratio,
                "na_ratio": F.try_divide(absent.cast("double"), total.cast("double")),
                "total_rows": total,
                "numeric_rows": count.cast("long"),
                "na_rows": absent,
                "detected_format": kind,
            }
        )
    return long_rows(row, records)


def sample_values(df: DataFrame, column: str, order_col: str, n: int = 5) -> DataFrame:
    """The first ``n`` non-null values as text in the given order; a numeric column keeps its nulls."""
    rows = df if is_numeric(df, column) else df.filter(~missing(df, column))
    return rows.orderBy(order_col).limit(n).select(F.lit(column).alias("column"), as_column(column).cast("string").alias("value"))


def numeric_text_columns(
    df: DataFrame, columns: list[str] | None = None, sample: int | None = None, order_col: str | None = None
) -> DataFrame:
    """Per column whether all its non-null values read as numbers; a column without values does not.

    By default every row is read. ``sample=100`` looks at the first non-null values by ``order_col``.
    """
    names = validate_columns(df, columns or df.columns)
    if sample is not None:
        if order_col is None:
            raise ValueError("a sample of first values needs order_col")
        parts = None
        for c in names:
            first = df.filter(~missing(df, c)).orderBy(order_col).limit(sample)
            part = numeric_text_columns(first, [c])
            parts = part if parts is None else parts.unionByName(part)
        return parts
    aggs = []
    for i, c in enumerate(names):
        value = number(df, c) if is_numeric(df, c) else parse_number(c)
        aggs += [F.count_if(~missing(df, c)).alias(f"n{i}"), F.count(value).alias(f"v{i}")]
    return long_rows(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "values": F.col(f"n{i}"),
                "parsed": F.col(f"v{i}"),
                "is_numeric": (F.col(f"n{i}") > 0) & (F.col(f"n{i}") == F.col(f"v{i}")),
            }
            for i, c in enumerate(names)
        ],
    )


def table_overview(df: DataFrame) -> DataFrame:
    """Position, name and type of every column with the table's row and column counts."""
    fields = df.schema.fields
    return long_rows(
        df.agg(F.count("*").alias("n")),
        [
            {
                "position": F.lit(i),
                "column": F.lit(f.name),
                "type": F.lit(f.dataType.simpleString()),
                "n_rows": F.col("n"),
                "n_columns": F.lit(len(fields)),
            }
            for i, f in enumerate(fields)
        ],
    )


def column_profile(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """Type, share missing, numeric or not, and number of distinct values.

    Distinct values are counted exactly with one shuffle of pre-aggregated (column, value) pairs;
    ``approximate`` uses sketches and no such shuffle.
    """
    names = validate_columns(df, columns or df.columns)
    base = df.agg(
        F.count("*").alias("n"),
        *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)],
        *([F.approx_count_distinct(as_column(c)).alias(f"u{i}") for i, c in enumerate(names)] if approximate else []),
    )
    profile = long_rows(
        base,
        [
            {
                "column": F.lit(c),
                "dtype": F.lit(data_type(df, c).simpleString()),
                "missing_ratio": F.try_divide(F.col(f"m{i}").cast("double"), F.col("n").cast("double")),
                "is_numeric": F.lit(is_numeric(df, c)),
                **({"unique_count": F.col(f"u{i}")} if approximate else {}),
            }
            for i, c in enumerate(names)
        ],
    )
    if approximate:
        return profile
    return profile.join(F.broadcast(distinct_counts(df, names)), "column", "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0))
    )


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``column, unique_count``, one row per column: distinct pairs first, then a count of them."""
    cells = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.when(~missing(df, c), as_column(c).cast("string")).alias("v")) for c in columns])
    )
    pairs = df.select(cells.alias("r")).select("r.*").filter(F.col("v").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count("*").alias("unique_count"))


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max per numeric column."""
    names = validate_columns(df, columns or numeric_columns(df))
    quart = exact_quantiles(df, names, QUARTILES)
    cols = {c: number(df, c) for c in names}
    row = df.agg(
        *[
            agg(cols[c]).alias(f"{k}{i}")
            for i, c in enumerate(names)
            for k, agg in (("n", F.count), ("a", F.avg), ("s", F.stddev_samp), ("l", F.min), ("h", F.max))
        ]
    )
    return long_rows(
        row,
        [
            {
                "column": F.lit(c),
                "count": F.col(f"n{i}"),
                "mean": F.col(f"a{i}"),
                "std": F.col(f"s{i}"),
                "min": F.col(f"l{i}"),
                "q25": _lit(quart[c][0.25]),
                "q50": _lit(quart[c][0.5]),
                "q75": _lit(quart[c][0.75]),
                "max": F.col(f"h{i}"),
            }
            for i, c in enumerate(names)
        ],
    )


def _lit(value: float | None) -> Column:
    return F.lit(value).cast("double")


def value_counts(df: DataFrame, column: str, normalize: bool = False, top: int | None = None) -> DataFrame:
    """Rows per value, or shares of the non-null rows; ``top`` keeps the commonest, ties by value."""
    counts = df.filter(~missing(df, column)).groupBy(as_column(column).alias("value")).agg(F.count("*").alias("count"))
    if normalize:
        total = df.filter(~missing(df, column)).count()
        counts = counts.withColumn("share", F.col("count") / F.lit(float(max(total, 1))))
    return counts if top is None else counts.orderBy(F.col("count").desc(), "value").limit(top)


def category_pattern_strength(df: DataFrame, column: str) -> DataFrame:
    """1 - entropy / ln(number of categories); one category gives 0."""
    counts = df.filter(~missing(df, column)).groupBy(as_column(column)).agg(F.count("*").cast("double").alias("n"))
    row = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log("n")).alias("s"), F.count("*").alias("k"))
    entropy = F.log("t") - F.col("s") / F.col("t")
    return row.select(
        F.lit(column).alias("column"),
        F.col("k").alias("categories"),
        F.when(F.col("k") > 1, 1 - F.try_divide(entropy, F.log("k"))).otherwise(0.0).alias("pattern_strength"),
    )


def histogram(df: DataFrame, column: str, bins: int = 20, density: bool = False) -> DataFrame:
    """Counts in equal-width bins; the last bin includes the maximum. A constant column gets bins of width 1/bins."""
    col = number(df, column)
    row = df.agg(F.min(col), F.max(col), F.count(col)).first()
    if row[2] == 0:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, count bigint")
    low, high = (row[0], row[1]) if row[0] < row[1] else (row[0] - 0.5, row[0] + 0.5)
    width = (high - low) / bins
    index = F.least(F.lit(bins - 1), F.floor((col - low) / width)).cast("int")
    counts = df.select(index.alias("bin")).filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count("*").alias("count"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = frame.join(F.broadcast(counts), "bin", "left").select(
        "bin",
        (F.lit(low) + F.col("bin") * width).alias("lower"),
        (F.lit(low) + (F.col("bin") + 1) * width).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )
    return out.withColumn("density", F.col("count") / F.lit(row[2] * width)) if density else out


KDE_TERMS, KDE_REACH = 17, 9


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth on a grid three bandwidths beyond the data.

    Rows are summed in bins one bandwidth wide. With t the distance of a row from the centre of its bin and z that of a
    grid point, both in bandwidths, exp(-(z - t)^2 / 2) is exp(-z^2 / 2) times the sum over k of z^k / k! * t^k exp(-t^2 / 2),
    so a bin needs ``KDE_TERMS`` sums whatever its rows. As |t| is at most 1/2, the terms left out are below 2e-13 of the peak
    of a row's kernel, and a row more than ``KDE_REACH`` bandwidths from a point gives it less than 1e-17 of that peak. The
    density is exact to 3e-13 times the peak of a single kernel, 1 / (bandwidth * sqrt(2 pi)).
    """
    col = number(df, column)
    n, std, low, high = df.agg(F.count(col), F.stddev_samp(col), F.min(col), F.max(col)).first()
    if not n or not std:
        return df.sparkSession.createDataFrame([], "x double, density double")
    width = n ** (-0.2) * std
    start, step = low - 3 * width, (high - low + 6 * width) / (points - 1)
    values = df.select(col.alias("v")).filter(F.col("v").isNotNull()).withColumn("bin", F.floor((F.col("v") - low) / width))
    values = values.withColumn("t", (F.col("v") - low) / width - F.col("bin") - 0.5)
    terms = [F.sum(F.exp(-F.col("t") * F.col("t") / 2) * F.pow("t", F.lit(k))) / math.factorial(k) for k in range(KDE_TERMS)]
    bins = values.groupBy("bin").agg(*[term.alias(f"w{k}") for k, term in enumerate(terms)])
    # A bin meets the grid points within its reach only.
    centre = F.lit(low) + (F.col("bin") + 0.5) * width
    first = F.greatest(F.lit(0), F.ceil((centre - (KDE_REACH + 0.5) * width - start) / step))
    last = F.least(F.lit(points - 1), F.floor((centre + (KDE_REACH + 0.5) * width - start) / step))
    met = bins.withColumns({"centre": centre, "first": first, "last": last}).filter(F.col("first") <= F.col("last"))
    met = met.withColumn("i", F.explode(F.sequence("first", "last"))).withColumn("z", (F.lit(start) + F.col("i") * step - F.col("centre")) / width)
    series = F.col(f"w{KDE_TERMS - 1}")
    for k in range(KDE_TERMS - 2, -1, -1):
        series = series * F.col("z") + F.col(f"w{k}")
    sums = met.groupBy("i").agg(F.sum(F.exp(-F.col("z") * F.col("z") / 2) * series).alias("sum"))
    grid = df.sparkSession.range(points).select(F.col("id").alias("i"))
    density = F.coalesce("sum", F.lit(0.0)) / (n * width * math.sqrt(2 * math.pi))
    return grid.join(F.broadcast(sums), "i", "left").select((F.lit(start) + F.col("i") * step).alias("x"), density.alias("density"))


def boxplot_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Quartiles, the whiskers (furthest values within 1.5 IQR of the box) and the number of outliers."""
    names = validate_columns(df, columns or numeric_columns(df))
    quart = exact_quantiles(df, names, QUARTILES)
    aggs, records = [], []
    for i, c in enumerate(names):
        col, q = number(df, c), quart[c]
        if q[0.5] is None:
            low = high = None
        else:
            reach = 1.5 * (q[0.75] - q[0.25])
            low, high = q[0.25] - reach, q[0.75] + reach
        inside = col.between(_lit(low), _lit(high))
        aggs += [
            F.min(F.when(inside, col)).alias(f"l{i}"),
            F.max(F.when(inside, col)).alias(f"h{i}"),
            F.count_if(~inside).alias(f"o{i}"),
        ]
        records.append(
            {
                "column": F.lit(c),
                "whisker_low": F.col(f"l{i}"),
                "q25": _lit(q[0.25]),
                "q50": _lit(q[0.5]),
                "q75": _lit(q[0.75]),
                "whisker_high": F.col(f"h{i}"),
                "outliers": F.col(f"o{i}"),
            }
        )
    return long_rows(df.agg(*aggs), records)


def boxplot_comparison(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    parts = [boxplot_stats(t, columns).withColumn("stage", F.lit(s)) for s, t in (("original", before), ("processed", after))]
    return parts[0].unionByName(parts[1])


def correlation_matrix(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present, in one pass; null for a constant column."""
    names = validate_columns(df, columns or numeric_columns(df))
    cols = {c: number(df, c) for c in names}
    pairs = list(combinations(names, 2))
    row = df.agg(*[correlation(cols[a], cols[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)], F.count("*").alias("n"))
    records = [{"column_1": F.lit(c), "column_2": F.lit(c), "correlation": F.lit(1.0)} for c in names]
    for i, (a, b) in enumerate(pairs):
        for x, y in ((a, b), (b, a)):
            records.append({"column_1": F.lit(x), "column_2": F.lit(y), "correlation": F.col(f"r{i}")})
    return long_rows(row, records)


def compare_distributions(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Mean and sample std of numeric columns before and after; one row per (column, stage)."""
    out = None
    for stage, table in (("original", before), ("processed", after)):
        cols = {c: number(table, c) for c in columns}
        row = table.agg(
            *[a(cols[c]).alias(f"{k}{i}") for i, c in enumerate(columns) for k, a in (("a", F.avg), ("s", F.stddev_samp), ("n", F.count))]
        )
        part = long_rows(
            row,
            [
                {"column": F.lit(c), "stage": F.lit(stage), "mean": F.col(f"a{i}"), "std": F.col(f"s{i}"), "count": F.col(f"n{i}")}
                for i, c in enumerate(columns)
            ],
        )
        out = part if out is None else out.unionByName(part)
    return out


def compare_categories(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """Shares of each category before and after."""
    old = value_counts(before, column, normalize=True).select("value", F.col("share").alias("original_share"))
    new = value_counts(after, column, normalize=True).select("value", F.col("share").alias("processed_share"))
    return old.join(new, "value", "full_outer").na.fill(0.0, ["original_share", "processed_share"])


def length_variance(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Mean, sample variance, minimum and maximum text length per column, optionally per group."""
    names = validate_columns(df, columns or text_columns(df))
    by = validate_columns(df, by or [])
    aggs = [
        a(F.length(as_column(c))).alias(f"{k}{i}")
        for i, c in enumerate(names)
        for k, a in (("a", F.avg), ("v", F.var_samp), ("l", F.min), ("h", F.max))
    ]
    rows = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return long_rows(
        rows,
        [
            {
                **{b: as_column(b) for b in by},
                "column": F.lit(c),
                "mean_length": F.col(f"a{i}"),
                "length_variance": F.col(f"v{i}"),
                "min_length": F.col(f"l{i}"),
                "max_length": F.col(f"h{i}"),
            }
            for i, c in enumerate(names)
        ],
    )
