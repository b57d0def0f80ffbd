"""Value cleaning and text serialisation."""

from __future__ import annotations

import re
from collections.abc import Sequence
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, functions as F

from .columns import as_column

# Cell texts that stand for a missing value.
NULL_TOKENS = ["N/A", "n/a", "-", "null", "NULL", "None", "nan", "NaN"]
# Accepted date spellings, tried in this order.
DATE_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy.MM.dd", "dd.MM.yyyy", "MMM d, yyyy"]
EMBEDDED = r"^(.*?)\s*\(([^()]*)\)\s*$"
REFERENCE = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,7});"
RANGE = r"^\s*(\d{4})\s*[-/–]\s*(\d{4}|\d{2})\s*$"


def strip(value: str | Column) -> Column:
    """Without white space (line ends included) on either side."""
    return F.regexp_replace(as_column(value), r"^\s+|\s+$", "")


def blank_to_null(value: str | Column, exact: bool = False) -> Column:
    """NULL for text that is empty after stripping; ``exact`` only takes the empty string itself."""
    col = as_column(value)
    return F.when(col == "" if exact else col.rlike(r"^\s*$"), None).otherwise(col)


def extract_embedded(value: str | Column) -> tuple[Column, Column]:
    """``John Smith (USA)`` as ``John Smith`` and ``USA``; other text keeps its value and gets NULL."""
    col = as_column(value)
    inner = F.regexp_extract(col, EMBEDDED, 2)
    return (
        F.when(col.rlike(EMBEDDED), F.regexp_extract(col, EMBEDDED, 1)).otherwise(col),
        F.when(col.rlike(EMBEDDED), inner),
    )


# What each run of date pattern letters looks like.
DATE_SHAPES = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
    "HH": r"\d{2}", "hh": r"\d{2}", "mm": r"\d{2}", "ss": r"\d{2}", "a": "(?i:am|pm)",
}


def date_shape(fmt: str) -> str:
    """A regular expression for text of this date format."""
    runs = re.findall(r"([A-Za-z])(\1*)|([^A-Za-z]+)", fmt)
    return "^" + "".join(DATE_SHAPES[a + b] if a else re.escape(rest) for a, b, rest in runs) + "$"


def try_date(value: Column, fmt: str) -> Column:
    """The timestamp, or NULL. A failed parse is slow, so only text of the right shape is parsed."""
    return F.when(value.rlike(date_shape(fmt)), F.try_to_timestamp(value, F.lit(fmt)))


def parse_date(value: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    col = F.trim(as_column(value))
    any_shape = "|".join(date_shape(f) for f in formats)
    return F.when(col.rlike(any_shape), F.coalesce(*[try_date(col, f) for f in formats]))


def normalize_dates(value: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Any accepted date spelling as ``YYYY-MM-DD``; NULL where none fits."""
    return F.date_format(parse_date(value, formats), "yyyy-MM-dd")


def null_tokens_to_empty(value: str | Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    col = as_column(value)
    return F.when(col.isNull() | F.trim(col).isin(list(tokens)), "").otherwise(col)


def split_range(value: str | Column) -> tuple[Column, Column]:
    """``2010-2023``, ``2019/20``, ``2021-22`` as start and end year; a short end takes the start's century."""
    col = as_column(value)
    start = F.regexp_extract(col, RANGE, 1).try_cast("int")
    end = F.regexp_extract(col, RANGE, 2)
    century = (F.floor(start / 100) * 100).cast("int")
    full_end = F.when(F.length(end) == 2, century + end.try_cast("int")).otherwise(end.try_cast("int"))
    return start, full_end


def decode_references(value: str | Column) -> Column:
    """Text with its character references (``&#46;``, ``&#x2E;``, ``&eacute;``) as the characters they stand for.

    The ampersand's own reference is decoded last, so that what it escapes stays as it is written. Unknown references stay.
    """
    col = as_column(value)
    names = F.create_map(*[F.lit(x) for pair in sorted(name2codepoint.items()) for x in pair])

    def code(found: Column) -> Column:
        body = F.substring(found, 2, F.length(found) - 2)
        return (
            F.when(~body.startswith("#"), names[body])
            .when(body.rlike("^#[xX]"), F.conv(F.substring(body, 3, 8), 16, 10).try_cast("int"))
            .otherwise(F.substring(body, 2, 8).try_cast("int"))
        )

    def decoded(text: Column, x: Column) -> Column:
        valid = (x.code > 0) & (x.code < 0x110000) & ~x.code.between(0xD800, 0xDFFF)
        # Four bytes are the character in UTF-32.
        char = F.when(x.code < 128, F.char(x.code)).otherwise(F.decode(F.unhex(F.lpad(F.hex(x.code.cast("long")), 8, "0")), "UTF-32"))
        return F.when(valid, F.replace(text, x.found, char)).otherwise(text)

    last = lambda x: F.lower(x).isin("&amp;", "&#38;", "&#x26;")

    def replaced(found: Column) -> Column:
        ordered = F.concat(F.filter(found, lambda x: ~last(x)), F.filter(found, last))
        return F.aggregate(F.transform(ordered, lambda x: F.struct(x.alias("found"), code(x).alias("code"))), col, decoded)

    # Every step is an argument of the next one, so that it is evaluated once; values without an ampersand are spared the search.
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(REFERENCE), F.lit(0)))
    return F.when(col.contains("&"), F.element_at(F.transform(F.array(found), replaced), 1)).otherwise(col)


def strip_special(value: str | Column, keep: str = r"\p{L}\p{N}\s.,:;%$€£¥/()'&+-") -> Column:
    """Decode character references, drop characters outside ``keep``, collapse white space."""
    kept = F.regexp_replace(decode_references(value), f"[^{keep}]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def general_format(value: str | Column, digits: int = 6) -> Column:
    """C-style ``%g``: ``digits`` significant digits without trailing zeros, rounded from the binary value as C does."""
    return _formatted(f"%.{digits}g")(F.array(as_column(value).cast("double")))


def _formatted(one: str, sep: str = "", nan: str | None = None, add_index: bool = False):
    """A function of an array of doubles: each value by the C format ``one``, joined. Missing values as ``nan``, or no text at all."""

    def line(values) -> str | None:
        if values is None or nan is None and any(v is None for v in values):
            return None
        items = [nan if nan is not None and (v is None or v != v) else one % v for v in values]
        return sep.join(f"{i}: {x}" for i, x in enumerate(items)) if add_index else sep.join(items)

    def run(batch: pa.Array) -> pa.Array:
        # Lists keep a missing value apart from NaN, which an array of numbers does not.
        return pa.array([line(v) for v in batch.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def _separator(sep: str) -> str:
    return sep if sep == "." else f" {sep} "


def serialize_sequence(values: str | Column, sep: str = ".", nan: str = "nan", add_index: bool = False) -> Column:
    """A numeric array as text, six significant digits each, optionally with ``i: `` before a value."""
    return _formatted("%.6g", _separator(sep), nan, add_index)(as_column(values).cast("array<double>"))


def serialize_row(columns: dict[str, str | Column], sep: str = ".", nan: str = "nan") -> Column:
    """``name: value`` for every column, joined; values are stripped and missing ones written as ``nan``."""
    parts = [
        F.concat(F.lit(f"{name}: "), F.coalesce(strip(as_column(ref).cast("string")), F.lit(nan)))
        for name, ref in columns.items()
    ]
    return F.concat_ws(_separator(sep), *parts)


def serialize_pair(text_a: Column, text_b: Column, noun: str = "Product", suffix: str = "", instruction: str | None = None) -> Column:
    """One sentence per side, with an optional instruction before them."""
    text = F.concat(
        F.lit(f"{noun} A is "), text_a, F.lit(f". {noun} B is "), text_b, F.lit(f".{suffix} ")
    )
    return text if instruction is None else F.concat(F.lit(f"{instruction} "), text)


def label_to_text(label: str | Column) -> Column:
    col = as_column(label)
    return F.when(col == 1, "Yes\n").when(col == 0, "No\n")
