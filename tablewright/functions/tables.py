"""Tables written as text: ``normalized_table = [["header", ...], ["cell", ...], ...]``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import as_column

MARKER = r"(?s)^.*?normalized_table ?=\s*"


def table_cells(response: str | Column) -> Column:
    """The outermost list of lists as ``array<array<string>>``, NULL where the text holds none.

    Valid JSON is taken as it is, so apostrophes inside double quotes survive; single-quoted lists
    and trailing commas are repaired only when the text does not parse without it.
    """
    col = as_column(response)
    body = F.when(col.rlike(r"normalized_table ?="), F.regexp_replace(col, MARKER, "")).otherwise(col)
    body = F.regexp_extract(F.regexp_replace(body, r"[\r\n]", ""), r"(\[.*\])", 1)
    requoted = F.replace(body, F.lit("'"), F.lit('"'))
    attempts = [body, _without_trailing_commas(body), requoted, _without_trailing_commas(requoted)]
    cells = F.coalesce(*[F.from_json(text, "array<array<string>>") for text in attempts])
    complete = (F.size(cells) > 0) & F.forall(cells, lambda row: row.isNotNull())
    return F.when(complete, cells)


def _without_trailing_commas(text: Column) -> Column:
    return F.regexp_replace(text, r",(\s*\])", "$1")


def parse_table_response(df: DataFrame, key: list[str], response: str) -> DataFrame:
    """One row per table row of every response: the keys, ``row_no`` (0 is the header) and ``cells``."""
    parsed = df.select(*[as_column(k) for k in key], table_cells(response).alias("_cells"))
    return parsed.select(*[as_column(k) for k in key], F.posexplode("_cells").alias("row_no", "cells"))


def rows_to_table(df: DataFrame, key: list[str], response: str, columns: list[str]) -> DataFrame:
    """The data rows of every response under the given header names.

    A response needs a header and at least one more row; a name missing from its header gives NULL.
    """
    cells = table_cells(response)
    parsed = df.select(*[as_column(k) for k in key], cells.alias("_cells")).filter(F.size("_cells") >= 2)
    rows = parsed.select(
        *[as_column(k) for k in key],
        F.element_at("_cells", 1).alias("_header"),
        F.posexplode(F.slice("_cells", F.lit(2), F.size("_cells"))).alias("_pos", "_row"),
    )

    def cell(name: str) -> Column:
        position = F.array_position("_header", F.lit(name)).cast("int")
        return F.when(position > 0, F.get("_row", position - 1))

    return rows.select(
        *[as_column(k) for k in key], (F.col("_pos") + 1).alias("row_no"), *[cell(c).alias(c) for c in columns]
    )
