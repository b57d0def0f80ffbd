"""Missing values: counts, patterns, blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column, long_rows, missing, replace_columns, text_columns, validate_columns
from ..functions.hashing import hex_number, row_hash
from ..functions.text import blank_to_null


def columns_with_missing(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Names of the columns with at least one missing cell, found in one pass."""
    names = validate_columns(df, columns or df.columns)
    row = df.agg(*[F.max(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[i]]


def missing_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per column the missing count and percentage, plus the totals over all cells on every row."""
    names = validate_columns(df, columns or df.columns)
    row = df.agg(
        F.count("*").alias("n"), *[F.count_if(missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]
    )
    total = sum((F.col(f"m{i}") for i in range(1, len(names))), F.col("m0"))
    return long_rows(
        row,
        [
            {
                "column": F.lit(c),
                "missing_count": F.col(f"m{i}"),
                "missing_percentage": F.try_divide(F.col(f"m{i}") * 100.0, F.col("n")),
                "total_missing": total,
                "total_missing_percentage": F.try_divide(total * 100.0, F.col("n") * len(names)),
            }
            for i, c in enumerate(names)
        ],
    )


def missing_pattern(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows per combination of missing columns: the row-by-column matrix with equal rows counted."""
    names = validate_columns(df, columns or df.columns)
    flags = [missing(df, c).cast("int").alias(c) for c in names]
    return df.select(*flags).groupBy(*names).agg(F.count("*").alias("rows"))


def missing_notes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``name: count (percent%)`` per column that has missing cells."""
    stats = missing_stats(df, columns).filter(F.col("missing_count") > 0)
    return stats.select(
        "column",
        # Half to even before formatting, as C-style formatting rounds an exact half.
        F.format_string("%s: %d (%.1f%%)", "column", "missing_count", F.bround("missing_percentage", 1)).alias("note"),
    )


def blanks_to_null(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """Blank text cells become NULL; other columns are untouched."""
    names = text_columns(df) if columns is None else [c for c in validate_columns(df, columns) if c in text_columns(df)]
    return replace_columns(df, {c: blank_to_null(c, exact) for c in names})


def inject_missing(df: DataFrame, key: list[str], columns: list[str], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Make each cell of the given columns missing with probability ``share``, decided by the row's key."""
    validate_columns(df, [*key, *columns])

    def punched(c: str) -> Column:
        draw = hex_number(row_hash(*key, seed=f"{c}|{seed}"))
        return F.when(draw >= int(share * 2**32), as_column(c))

    return replace_columns(df, {c: punched(c) for c in columns})
