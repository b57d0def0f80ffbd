"""Composed jobs: preparing a whole table, and running one request given as a dict."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import validate_choice
from ..operators.impute import impute
from ..operators.matching import METHODS, exact_match
from ..operators.missing import blanks_to_null, missing_stats
from ..operators.power import fit_transform
from ..operators.profile import numeric_profile
from ..operators.scale import normalize
from ..operators.smart import impute_smart
from ..operators.strings import fuzzy_match, tfidf_match_tables
from ..operators.structure import ValueRules, infer_types, normalize_table
from ..session import write_table

OPERATIONS = ["normalizer", "transformer", "entity_matcher", "imputer", "all"]


@dataclass
class Prepared:
    """The prepared table, the numeric profile, the chosen methods and the missing cells before and after."""

    table: DataFrame
    profile: DataFrame
    methods: dict[str, str]
    missing: DataFrame


def prepare_table(
    df: DataFrame,
    order_col: str,
    key: list[str],
    rules: ValueRules | None = None,
    min_ratio: float = 0.8,
    typed: bool = True,
    **options,
) -> Prepared:
    """Clean values, type columns, find the numeric ones, then fill what is missing column by column.

    Text tables would see only modes, so the types are inferred before imputing unless ``typed`` is off.
    """
    work = blanks_to_null(normalize_table(df, rules) if rules else df)
    profile = numeric_profile(work, min_ratio=min_ratio)
    if typed:
        work, _ = infer_types(work)
    # The profile reads the table many times; cleaning and parsing are not repeated for each pass.
    work = write_table(work, "prepared")
    if profile.filter("is_numeric").isEmpty():
        raise ValueError("no numeric column found")
    done, methods = impute_smart(work, order_col, key, **options)
    before, after = missing_stats(work), missing_stats(done)
    counts = before.select("column", F.col("missing_count").alias("missing_before")).join(
        F.broadcast(after.select("column", F.col("missing_count").alias("missing_after"))), "column"
    )
    return Prepared(done, profile, methods, counts)


def run_request(request: dict, df: DataFrame, other: DataFrame | None = None, **options) -> DataFrame:
    """Run ``{"operation": ..., "method": ..., "columns": ...}`` and return the resulting table.

    Matching with one table matches it with itself.
    """
    operation = validate_choice("operation", request.get("operation"), OPERATIONS)
    method, columns = request.get("method"), request.get("columns") or None
    if operation == "normalizer":
        return normalize(df, method or "zscore", columns)[0]
    if operation == "transformer":
        return fit_transform(df, method or "yeo-johnson", columns)[0]
    if operation == "imputer":
        return impute(df, method or "mean", columns)[0]
    if operation == "entity_matcher":
        validate_choice("method", method or "exact", METHODS)
        right = df if other is None else other
        if method == "fuzzy":
            return fuzzy_match(df, right, columns, request.get("threshold", 0.8))
        if method == "tfidf":
            return tfidf_match_tables(df, right, columns, request.get("threshold", 0.8))
        return exact_match(df, right, columns)
    return prepare_table(df, **options).table
