"""Recommended imputation per column from its profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import is_numeric, numeric_columns, replace_columns, validate_choice, validate_columns
from ..functions.probability import normality_p
from .clusters import cluster_tendency
from .distribution import (
    FAMILIES,
    autocorr_lag1,
    identify_distribution,
    iqr_fences,
    moments,
    outliers_isoforest,
    spatial_correlation,
)
from .impute import fit_simple, impute_iterative, impute_knn
from .missing import columns_with_missing
from .ordering import sorted_counts
from .profile import column_profile

SKEWED = ["exponential", "lognormal", "gamma"]


def imputation_profile(
    df: DataFrame,
    columns: Sequence[str],
    order_col: str,
    key: list[str],
    outlier_methods: Sequence[str] = ("z", "iqr", "forest"),
    families: Sequence[str] = FAMILIES,
    clusters: bool = False,
) -> DataFrame:
    """One row per column with everything the recommendation looks at; shape fields are NULL for text.

    The forest rule marks a tenth of almost any column, so with it nearly every numeric column has
    outliers. Cluster tendency counts as 0 unless ``clusters`` is set.
    """
    names = validate_columns(df, columns)
    numeric = [c for c in names if c in numeric_columns(df)]
    profile = column_profile(df, names)
    if not numeric:
        return _without_shape(profile)
    # Moments, fences and the sorted values are computed once and shared by all shape measures.
    known = moments(df, numeric)
    shared = {"known": known, "ranked": sorted_counts(df, numeric)}
    marked = _outlier_marks(df, key, known, outlier_methods)
    facts = [(c, m["n"], m["skew"], m["kurt"], marked[c]) for c, m in known.items() if m["n"] >= 2]
    shape = df.sparkSession.createDataFrame(
        facts, "column string, n bigint, skewness double, kurtosis double, has_outliers boolean"
    )
    p = normality_p(F.col("n").cast("double"), F.col("skewness"), F.col("kurtosis"))
    shape = shape.withColumn("is_normal", F.coalesce(p > 0.05, F.lit(False))).drop("n")
    parts = [
        identify_distribution(df, numeric, families, **shared),
        spatial_correlation(df, numeric, **shared),
        autocorr_lag1(df, order_col, numeric).withColumnRenamed("autocorrelation", "pattern_strength"),
    ]
    for part in parts:
        shape = shape.join(F.broadcast(part), "column")
    if clusters:
        shape = shape.join(F.broadcast(cluster_tendency(df, numeric)), "column")
    else:
        shape = shape.withColumn("cluster_tendency", F.lit(0.0))
    return profile.join(F.broadcast(shape), "column", "left")


def _outlier_marks(df: DataFrame, key: list[str], known: dict[str, dict], methods: Sequence[str]) -> dict[str, bool]:
    """Whether any chosen rule fires; the forest is only grown for columns the cheaper rules leave open."""
    marked = {c: False for c in known}
    usable = [c for c, m in known.items() if m["n"] >= 2]
    if "z" in methods:
        for c in usable:
            m = known[c]
            marked[c] = max(m["max"] - m["mean"], m["mean"] - m["min"]) > 3 * m["std"]
    left = [c for c in usable if not marked[c]]
    if "iqr" in methods and left:
        for c, (low, high) in iqr_fences(df, left).items():
            marked[c] = known[c]["min"] < low or known[c]["max"] > high
    left = [c for c in usable if not marked[c]]
    if "forest" in methods and left:
        for r in outliers_isoforest(df, key, left).collect():
            marked[r["column"]] = r["has_outliers"]
    return marked


def _without_shape(profile: DataFrame) -> DataFrame:
    none = {c: "double" for c in ("skewness", "kurtosis", "spatial_correlation", "pattern_strength", "cluster_tendency")}
    none |= {"is_normal": "boolean", "has_outliers": "boolean", "distribution_type": "string"}
    return profile.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})


def recommended_method() -> tuple[Column, Column]:
    """Method and reason over the columns of :func:`imputation_profile`; the first rule that holds decides."""
    col = F.col
    sparse, outliers = col("missing_ratio") > 0.5, col("has_outliers")
    skewed = outliers | (F.abs("skewness") > 1)
    calm = col("is_normal") & ~outliers
    rules = [
        (~col("is_numeric") & (F.try_divide("unique_count", 1 - col("missing_ratio")) < 10), "most_frequent", "text with few categories"),
        (~col("is_numeric"), "knn", "text with many categories"),
        (col("skewness").isNull() & col("spatial_correlation").isNull(), "most_frequent", "too few values to profile"),
        (sparse & (col("spatial_correlation") > 0.7), "knn", "mostly missing, values close together"),
        (sparse & (col("pattern_strength") > 0.6), "iterative", "mostly missing, clear pattern"),
        (sparse, "median", "mostly missing, no pattern"),
        (calm & (col("cluster_tendency") > 0.5), "knn", "normal and clustered"),
        (calm, "mean", "normal without outliers"),
        (skewed & (col("pattern_strength") > 0.7), "iterative", "outliers or skew, strong pattern"),
        (skewed, "median", "outliers or skew"),
        (col("distribution_type").isin(SKEWED), "median", "skewed family"),
        (col("spatial_correlation") > 0.6, "knn", "values close together"),
        (col("cluster_tendency") > 0.4, "knn", "clustered"),
        (col("pattern_strength") > 0.5, "iterative", "medium pattern"),
    ]
    method, reason = F.when(rules[0][0], rules[0][1]), F.when(rules[0][0], rules[0][2])
    for test, name, why in rules[1:]:
        method, reason = method.when(test, name), reason.when(test, why)
    return method.otherwise("iterative"), reason.otherwise("no marked feature")


def suggest_imputer(df: DataFrame, columns: Sequence[str], order_col: str, key: list[str], **options) -> DataFrame:
    """The profile with ``method`` and ``reason``, one row per column."""
    method, reason = recommended_method()
    return imputation_profile(df, columns, order_col, key, **options).withColumns({"method": method, "reason": reason})


def impute_smart(
    df: DataFrame,
    order_col: str,
    key: list[str],
    columns: Sequence[str] | None = None,
    context: str = "column",
    **options,
) -> tuple[DataFrame, dict[str, str]]:
    """Fill every column by its recommended method and report the methods.

    ``context="column"`` sees one column at a time, where nearest rows and regressions come down to the
    column mean; ``context="table"`` gives them the other numeric columns.
    """
    validate_choice("context", context, ["column", "table"])
    names = list(columns) if columns is not None else columns_with_missing(df)
    if not names:
        return df, {}
    chosen = {r["column"]: r["method"] for r in suggest_imputer(df, names, order_col, key, **options).select("column", "method").collect()}
    by_method: dict[str, list[str]] = {}
    for c in names:
        joint = chosen[c] in ("knn", "iterative") and is_numeric(df, c)
        by_method.setdefault(chosen[c] if not joint or context == "table" else "mean", []).append(c)
    out = df
    for method, group in by_method.items():
        if method in ("knn", "iterative"):
            numeric = [c for c in numeric_columns(df) if c != order_col and c not in key]
            text = [c for c in group if not is_numeric(df, c)]
            joint = [c for c in group if c not in text]
            if joint:
                # Only the group's own columns are taken over; the others just lend their values.
                others = [c for c in numeric if c not in joint]
                keep = {c: f"_keep_{i}" for i, c in enumerate(others)}
                filled = (impute_knn if method == "knn" else impute_iterative)(
                    out.select("*", *[F.col(c).alias(k) for c, k in keep.items()]), numeric
                )
                out = replace_columns(filled, {c: F.col(k) for c, k in keep.items()}).drop(*keep.values())
            if text:
                out = fit_simple(df, "most_frequent", text).transform(out)
        else:
            out = fit_simple(df, method, group).transform(out)
    return out, chosen
