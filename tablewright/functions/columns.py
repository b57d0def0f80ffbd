"""Small helpers on column references."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_column(ref: str | Column) -> Column:
    return ref if isinstance(ref, Column) else F.col(f"`{ref}`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(data_type(df, name), (T.NumericType, T.BooleanType))


def number(df: DataFrame, name: str) -> Column:
    """The column as double with NaN turned into NULL, the only missing marker used here."""
    col = as_column(name)
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        col = col.cast("double")
        return F.when(~F.isnan(col), col)
    return col.cast("double")


def missing(df: DataFrame, name: str) -> Column:
    """True where the cell is NULL (or NaN in a floating-point column)."""
    col = as_column(name)
    if isinstance(data_type(df, name), (T.DoubleType, T.FloatType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def select_by_type(df: DataFrame, numeric: bool = True) -> DataFrame:
    """Keep the numeric columns, or with ``numeric=False`` the others."""
    wanted = set(numeric_columns(df))
    return df.select(*[as_column(c) for c in df.columns if (c in wanted) == numeric])


def validate_columns(df: DataFrame, columns: Iterable[str]) -> list[str]:
    columns = list(columns)
    unknown = [c for c in columns if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}; the table has {df.columns}")
    return columns


def validate_choice(kind: str, value: str, choices: Iterable[str]) -> str:
    choices = list(choices)
    if value not in choices:
        raise ValueError(f"{kind} {value!r} is not supported; use one of {choices}")
    return value


def common_columns(left: DataFrame, right: DataFrame, columns: Iterable[str] | None = None) -> list[str]:
    """The columns to match on, in the left table's order."""
    if not columns:
        shared = [c for c in left.columns if c in set(right.columns)]
        if not shared:
            raise ValueError("the tables have no column in common")
        return shared
    validate_columns(left, columns)
    return validate_columns(right, columns)


def drop_rename(df: DataFrame, drop: Iterable[str] = (), rename: dict[str, str] | None = None) -> DataFrame:
    """Drop the listed columns that exist, then rename by the mapping."""
    return df.drop(*[c for c in drop if c in df.columns]).withColumnsRenamed(rename or {})


def reorder_columns(df: DataFrame, targets_first: Iterable[str] = ()) -> DataFrame:
    first = validate_columns(df, targets_first)
    return df.select(*[as_column(c) for c in first + [c for c in df.columns if c not in first]])


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """Replace columns in place, keeping the column order."""
    return df.select(*[new[c].alias(c) if c in new else as_column(c) for c in df.columns])


def long_rows(one_row: DataFrame, records: list[dict[str, Column]]) -> DataFrame:
    """Turn a one-row aggregate into one row per record."""
    structs = [F.struct(*[col.alias(name) for name, col in record.items()]) for record in records]
    return one_row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")
