"""Column scaling: fit a few statistics, transform by a projection."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_numeric, number, numeric_columns, replace_columns, validate_choice, validate_columns
from ..functions.numbers import parse_number
from .profile import numeric_text_columns
from .quantiles import exact_quantiles

METHODS = ["zscore", "minmax", "decimal", "log10", "robust"]


@dataclass
class ScaleModel:
    """Per column ``(a, b)``: the value becomes (x - a) / b, or log10(x + a) for log10."""

    method: str
    stats: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.stats)

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: self.expression(c, numeric_value(df, c)) for c in self.columns})

    def expression(self, column: str, value: Column) -> Column:
        a, b = (F.lit(s).cast("double") for s in self.stats[column])
        if self.method == "log10":
            return F.when(value + a > 0, F.log10(value + a))
        scaled = F.try_divide(value - a, b)
        if self.method == "minmax":
            # A constant column maps to 0, a missing cell stays missing.
            scaled = F.when(value.isNotNull(), F.coalesce(scaled, F.lit(0.0)))
        return scaled

    def inverse(self, df: DataFrame) -> DataFrame:
        def back(c: str) -> Column:
            a, b = (F.lit(s).cast("double") for s in self.stats[c])
            x = number(df, c)
            return F.pow(F.lit(10.0), x) - a if self.method == "log10" else x * b + a

        return replace_columns(df, {c: back(c) for c in self.columns})


def numeric_value(df: DataFrame, column: str) -> Column:
    """The column as a number; text is parsed and what does not parse is missing."""
    return number(df, column) if is_numeric(df, column) else parse_number(column)


def to_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Parse the columns to doubles; unreadable text becomes NULL."""
    validate_columns(df, columns)
    return replace_columns(df, {c: numeric_value(df, c) for c in columns})


def fit_scale(df: DataFrame, method: str = "zscore", columns: list[str] | None = None) -> ScaleModel:
    """Fit over the given columns, or over all that hold numbers (natively or as text)."""
    method = {"standard": "zscore"}.get(method, method)
    validate_choice("method", method, METHODS)
    names = validate_columns(df, columns) if columns else auto_columns(df)
    if not names:
        raise ValueError("no numeric column found")
    if method == "robust":
        parsed = to_numeric(df, names)
        quart = exact_quantiles(parsed, names, [0.25, 0.5, 0.75])
        spread = {c: (q[0.75] - q[0.25] if q[0.5] is not None else None) for c, q in quart.items()}
        return ScaleModel(method, {c: (quart[c][0.5], spread[c]) for c in names})
    values = {c: numeric_value(df, c) for c in names}
    kinds = {"zscore": (F.avg, F.stddev_samp), "minmax": (F.min, F.max), "decimal": (F.min, F.max), "log10": (F.min, F.max)}
    row = df.agg(*[agg(values[c]).alias(f"s{j}_{i}") for i, c in enumerate(names) for j, agg in enumerate(kinds[method])]).first()
    stats = {}
    for i, c in enumerate(names):
        first, second = row[f"s0_{i}"], row[f"s1_{i}"]
        if first is None:
            stats[c] = (None, None)
        elif method == "zscore":
            stats[c] = (first, second)
        elif method == "minmax":
            stats[c] = (first, second - first)
        elif method == "decimal":
            largest = max(abs(first), abs(second))
            digits = int(math.log10(largest)) + 1 if largest > 0 else 1
            stats[c] = (0.0, 10.0**digits)
        else:
            stats[c] = (abs(first) + 1 if first <= 0 else 0.0, 1.0)
    return ScaleModel(method, stats)


def auto_columns(df: DataFrame) -> list[str]:
    """Native numeric columns and text columns whose every value reads as a number, in table order."""
    native = numeric_columns(df)
    text = [c for c, t in df.dtypes if t == "string"]
    found = set(native)
    if text:
        found |= {r["column"] for r in numeric_text_columns(df, text).filter("is_numeric").collect()}
    return [c for c in df.columns if c in found]


def normalize(df: DataFrame, method: str = "zscore", columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """Scale and report the columns used; the input table is left as it is."""
    model = fit_scale(df, method, columns)
    return model.transform(df), model.columns
