"""Numbers held as text: tests, format classes and parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_column

# The accepted spellings of a number, in their order of precedence, ASCII digits only.
INTEGER = r"^\s*[-+]?\d+\s*$"
DECIMAL = r"^\s*[-+]?\d*\.\d+\s*$"
SCIENTIFIC = r"^\s*[-+]?\d*\.?\d+[eE][-+]?\d+\s*$"
THOUSANDS = r"^\s*[-+]?\d{1,3}(,\d{3})*(\.\d+)?\s*$"
CURRENCY_BEFORE = r"^\s*[$€¥£]\s*[-+]?\d+(\.\d+)?\s*$"
CURRENCY_AFTER = r"^\s*[-+]?\d+(\.\d+)?\s*[$€¥£]\s*$"
PERCENTAGE = r"^\s*[-+]?\d+(\.\d+)?\s*%\s*$"
FORMATS = ["integer", "decimal", "percentage", "currency", "scientific"]

# Text that a float parser takes, used before try_cast because Spark also takes '1d' and '1f'.
FLOAT_TEXT = r"^\s*[-+]?(\d+\.?\d*([eE][-+]?\d+)?|\.\d+([eE][-+]?\d+)?|(?i:inf|infinity|nan))\s*$"
CURRENCY_MARKS = r"^[$€¥£%]+|[$€¥£%]+$"


def stripped_number(value: str | Column) -> Column:
    """The text without thousands commas and without leading or trailing currency and percent marks."""
    return F.regexp_replace(F.replace(as_column(value), F.lit(","), F.lit("")), CURRENCY_MARKS, "")


def classify_numeric_format(value: str | Column) -> Column:
    """integer, decimal, percentage, currency or scientific; NULL for text that is no number.

    Numbers of any other accepted spelling (thousands separators, mixed marks) count as decimal.
    """
    col = as_column(value)
    return (
        F.when(col.rlike(INTEGER), "integer")
        .when(col.rlike(DECIMAL), "decimal")
        .when(col.rlike(PERCENTAGE), "percentage")
        .when(col.rlike(CURRENCY_BEFORE) | col.rlike(CURRENCY_AFTER), "currency")
        .when(col.rlike(SCIENTIFIC), "scientific")
        .when(col.rlike(THOUSANDS) | stripped_number(col).rlike(FLOAT_TEXT), "decimal")
    )


def is_numeric_string(value: str | Column) -> Column:
    """True for text that reads as a number; false for other text and for NULL."""
    return classify_numeric_format(value).isNotNull()


def parse_number(value: str | Column) -> Column:
    """Text to double, NULL where it does not read as a plain number."""
    col = as_column(value).cast("string")
    parsed = F.when(col.rlike(FLOAT_TEXT), F.trim(F.regexp_replace(col, r"\s", "")).try_cast("double"))
    return F.when(~F.isnan(parsed), parsed)


def clean_numeric(value: str | Column) -> Column:
    """Strip currency marks, thousands separators and units; a percentage becomes a fraction."""
    col = as_column(value)
    amount = F.regexp_extract(F.replace(col, F.lit(","), F.lit("")), r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    return F.when(F.rtrim(col).endswith("%"), amount / 100.0).otherwise(amount)


def dominant_format(counts: dict[str, Column]) -> Column:
    """The commonest format of a column; ties go to the first declared, none at all is non_numeric."""
    ranked = F.greatest(*[F.struct(counts[f].alias("n"), F.lit(-i).alias("order")) for i, f in enumerate(FORMATS)])
    return F.when(ranked["n"] > 0, F.element_at(F.array(*[F.lit(f) for f in FORMATS]), 1 - ranked["order"])).otherwise(
        "non_numeric"
    )


def log_shift(value: str | Column, shift: float) -> Column:
    return F.log10(as_column(value) + F.lit(float(shift)))


def decimal_scale(value: str | Column, digits: int) -> Column:
    return as_column(value) / F.lit(float(10**digits))
