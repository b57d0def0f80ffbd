"""Column names, column types and cell values brought into a regular shape."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import as_column, data_type, is_numeric, missing, number, replace_columns, text_columns, validate_columns
from ..functions.numbers import clean_numeric, parse_number
from ..functions.text import (
    DATE_FORMATS,
    extract_embedded,
    normalize_dates,
    null_tokens_to_empty,
    parse_date,
    split_range,
    strip_special,
)
from .profile import distinct_counts

# Name patterns searched case-insensitively in the original column name, first hit wins.
NAME_PATTERNS = [
    (r"(^id$|^index$|^key$)", "id"),
    (r"(^number$|^num$|^count$)", "number"),
    (r"(price|cost|fee|amount)", "price"),
    (r"(percentage|ratio|rate)", "ratio"),
    (r"(date|time|datetime)", "date"),
    (r"(year|yr)", "year"),
    (r"(month|mon)", "month"),
    (r"(day|dy)", "day"),
    (r"(category|type|class|group)", "category"),
    (r"(status|state|condition)", "status"),
    (r"(name|title)", "name"),
    (r"(description|desc|comment)", "description"),
    (r"(address|addr|location)", "address"),
]

# The type a column name asks for, searched in the name in this order.
TYPE_HINTS = [
    ("id", "int64"), ("number", "float64"), ("price", "float64"), ("ratio", "float64"), ("date", "datetime"),
    ("year", "int64"), ("month", "int64"), ("day", "int64"), ("category", "category"), ("status", "category"),
    ("name", "string"), ("description", "string"), ("address", "string"),
]


def normalized_names(names: Sequence[str]) -> list[str]:
    """Canonical name by pattern, else lower case with underscores; repeated names get _1, _2, ..."""
    out: list[str] = []
    for name in names:
        hits = [canonical for pattern, canonical in NAME_PATTERNS if re.search(pattern, name, re.IGNORECASE)]
        plain = re.sub(r"[^a-z0-9_]", "", re.sub(r"[\s\-]+", "_", name.lower().strip()))
        base = hits[0] if hits else plain
        unique, n = base, 0
        while unique in out:
            n += 1
            unique = f"{base}_{n}"
        out.append(unique)
    return out


def normalize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_names(df.columns))


def type_hint(name: str) -> str | None:
    return next((kind for part, kind in TYPE_HINTS if part in name), None)


def inferred_types(df: DataFrame, sample: int | None = None, order_col: str | None = None) -> dict[str, str]:
    """Type per column by its name, else by its values; a column with neither is left out.

    One aggregate tests all columns over all rows. ``sample=100`` tests the first non-null values of each
    column by ``order_col`` instead.
    """
    if sample is not None and order_col is None:
        raise ValueError("a sample of first values needs order_col")
    open_columns = [c for c in df.columns if type_hint(c) is None]
    kinds = {c: type_hint(c) for c in df.columns if type_hint(c) is not None}
    if sample is None:
        kinds.update(_tested(df, open_columns))
    else:
        for c in open_columns:
            kinds.update(_tested(df.filter(~missing(df, c)).orderBy(order_col).limit(sample), [c]))
    return {c: kinds[c] for c in df.columns if c in kinds}


def _tested(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    if not columns:
        return {}
    cells, aggs = [], []
    for i, c in enumerate(columns):
        kind = data_type(df, c)
        if isinstance(kind, T.StringType):
            date = parse_date(c).isNotNull()
        else:
            date = F.lit(isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))) & ~missing(df, c)
        # Each cell is parsed once, in a projection below the counts.
        cells += [missing(df, c).alias(f"m{i}"), _numeric(df, c).alias(f"v{i}"), date.alias(f"d{i}")]
        whole = F.col(f"v{i}") == F.floor(f"v{i}")
        aggs += [
            F.count_if(~F.col(f"m{i}")).alias(f"n{i}"),
            F.count(f"v{i}").alias(f"v{i}"),
            F.count_if(whole).alias(f"w{i}"),
            F.count_if(f"d{i}").alias(f"d{i}"),
        ]
    row = df.select(*cells).agg(*aggs).first()
    out, rest = {}, []
    for i, c in enumerate(columns):
        n = row[f"n{i}"]
        if n == 0:
            continue
        if row[f"v{i}"] == n:
            out[c] = "int64" if row[f"w{i}"] == n else "float64"
        elif row[f"d{i}"] == n:
            out[c] = "datetime"
        else:
            rest.append((c, n))
    if rest:
        distinct = {r["column"]: r["unique_count"] for r in distinct_counts(df, [c for c, _ in rest]).collect()}
        out.update({c: "category" if distinct.get(c, 0) < n * 0.5 else "string" for c, n in rest})
    return out


def _numeric(df: DataFrame, column: str) -> Column:
    if is_numeric(df, column):
        return number(df, column)
    return parse_number(column) if isinstance(data_type(df, column), T.StringType) else F.lit(None).cast("double")


def convert_types(df: DataFrame, kinds: dict[str, str], formats: Sequence[str] = DATE_FORMATS) -> DataFrame:
    """Convert with coercion; what does not fit becomes NULL. An integer column with fractions becomes double."""
    whole = [c for c, k in kinds.items() if k == "int64"]
    fractions = {}
    if whole:
        values = {c: _numeric(df, c) for c in whole}
        row = df.agg(*[F.count_if(values[c] != F.floor(values[c])).alias(f"f{i}") for i, c in enumerate(whole)]).first()
        fractions = {c: row[f"f{i}"] > 0 for i, c in enumerate(whole)}

    def converted(c: str, kind: str) -> Column:
        if kind in ("int64", "float64"):
            value = _numeric(df, c)
            return value if kind == "float64" or fractions[c] else value.cast("long")
        if kind == "datetime":
            kind_now = data_type(df, c)
            return parse_date(c, formats) if isinstance(kind_now, T.StringType) else as_column(c).cast("timestamp_ntz")
        return as_column(c).cast("string")

    return replace_columns(df, {c: converted(c, k) for c, k in kinds.items()})


def infer_types(df: DataFrame, **options) -> tuple[DataFrame, dict[str, str]]:
    kinds = inferred_types(df, **options)
    return convert_types(df, kinds), kinds


def normalize_structure(
    df: DataFrame, normalize_names: bool = True, convert: bool = True, **options
) -> tuple[DataFrame, DataFrame]:
    """The table with regular names and types, and one row per column with old and new name and type."""
    out = normalize_column_names(df) if normalize_names else df
    kinds: dict[str, str] = {}
    if convert:
        out, kinds = infer_types(out, **options)
    rows = [
        (i, old.name, new.name, old.dataType.simpleString(), new.dataType.simpleString(), kinds.get(new.name))
        for i, (old, new) in enumerate(zip(df.schema.fields, out.schema.fields))
    ]
    schema = "position int, old_name string, new_name string, old_type string, new_type string, kind string"
    return out, df.sparkSession.createDataFrame(rows, schema)


@dataclass
class ValueRules:
    """Which value rules apply to which columns; rows and columns are never dropped."""

    embedded: dict[str, str] = field(default_factory=dict)
    dates: Sequence[str] = ()
    numbers: Sequence[str] = ()
    ranges: dict[str, tuple[str, str]] = field(default_factory=dict)
    nulls: Sequence[str] = ()
    special: Sequence[str] = ()

    def columns(self) -> list[str]:
        return [*self.embedded, *self.dates, *self.numbers, *self.ranges, *self.nulls, *self.special]


def normalize_table(df: DataFrame, rules: ValueRules) -> DataFrame:
    """Apply the value rules without a shuffle; new columns follow the old ones.

    Rules that later ones build on have projections of their own, so that they are evaluated once a value.
    """
    validate_columns(df, rules.columns())
    df = replace_columns(df, {c: strip_special(c) for c in rules.special})
    df = replace_columns(df, {c: null_tokens_to_empty(c) for c in rules.nulls})
    current: dict[str, Column] = {c: as_column(c) for c in df.columns}
    extra: dict[str, Column] = {}
    for c, new in rules.embedded.items():
        current[c], extra[new] = extract_embedded(current[c])
    for c in rules.dates:
        current[c] = normalize_dates(current[c])
    for c in rules.numbers:
        current[c] = clean_numeric(current[c])
    for c, (start, end) in rules.ranges.items():
        extra[start], extra[end] = split_range(current[c])
    return df.select(*[col.alias(c) for c, col in {**current, **extra}.items()])


def text_table(df: DataFrame) -> DataFrame:
    """Every column as text, as a table arrives before its types are known."""
    return replace_columns(df, {c: as_column(c).cast("string") for c in df.columns if c not in text_columns(df)})
