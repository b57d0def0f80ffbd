"""Power and quantile transforms: fit, transform, inverse."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import number, numeric_columns, replace_columns, validate_choice, validate_columns
from .ordering import sorted_counts

METHODS = ["yeo-johnson", "box-cox", "quantile_normal", "quantile_uniform"]
GRID = 11
PASSES = 5
FIRST_RANGE = (-5.0, 5.0)  # where the search begins; it moves on while the best lambda is at an end
QUANTILES = 1000
CLIP = 1e-7


def yeo_johnson(x: Column, lam: float) -> Column:
    right = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    other = 2 - lam
    left = -F.log1p(-x) if abs(other) < 1e-12 else -(F.pow(1 - x, F.lit(other)) - 1) / other
    return F.when(x >= 0, right).when(x < 0, left)


def yeo_johnson_inverse(y: Column, lam: float) -> Column:
    right = F.expm1(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam)) - 1
    other = 2 - lam
    left = -F.expm1(-y) if abs(other) < 1e-12 else 1 - F.pow(1 - y * other, F.lit(1 / other))
    return F.when(y >= 0, right).when(y < 0, left)


def box_cox(x: Column, lam: float) -> Column:
    return F.log(x) if abs(lam) < 1e-12 else (F.pow(x, F.lit(lam)) - 1) / lam


def box_cox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if abs(lam) < 1e-12 else F.pow(y * lam + 1, F.lit(1 / lam))


FORWARD: dict[str, Callable[[Column, float], Column]] = {"yeo-johnson": yeo_johnson, "box-cox": box_cox}
#: For the variance: constants that do not change it would drown the powers of far lambdas.
SPREAD: dict[str, Callable[[Column, float], Column]] = {
    "yeo-johnson": yeo_johnson,
    "box-cox": lambda x, lam: F.log(x) if abs(lam) < 1e-12 else F.pow(x, F.lit(lam)) / lam,
}
BACKWARD: dict[str, Callable[[Column, float], Column]] = {"yeo-johnson": yeo_johnson_inverse, "box-cox": box_cox_inverse}


@dataclass
class PowerModel:
    """Per column lambda, mean and population std of the transformed values."""

    method: str
    params: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        def one(c: str) -> Column:
            lam, mean, std = self.params[c]
            return (FORWARD[self.method](number(df, c), lam) - mean) / std

        return replace_columns(df, {c: one(c) for c in self.params})

    def inverse(self, df: DataFrame) -> DataFrame:
        def one(c: str) -> Column:
            lam, mean, std = self.params[c]
            return BACKWARD[self.method](number(df, c) * std + mean, lam)

        return replace_columns(df, {c: one(c) for c in self.params})


def fit_power(df: DataFrame, method: str = "yeo-johnson", columns: Sequence[str] | None = None) -> PowerModel:
    """Lambda by maximum likelihood, then standardisation.

    Each pass evaluates a grid of lambdas for all columns in one aggregate and the next grid spans the
    neighbours of the best one; a parabola through the last three points gives the final digits. While the
    best one is an end of the grid, the next grid lies beyond it.
    """
    validate_choice("method", method, list(FORWARD))
    names = validate_columns(df, columns or numeric_columns(df))
    values = {c: number(df, c) for c in names}
    base = df.agg(
        *[
            agg.alias(f"{k}{i}")
            for i, c in enumerate(names)
            for k, agg in (
                ("n", F.count(values[c])),
                ("lo", F.min(values[c])),
                ("hi", F.max(values[c])),
                ("s", F.sum(_log_term(values[c], method))),
            )
        ]
    ).first()
    wrong = [c for i, c in enumerate(names) if method == "box-cox" and base[f"n{i}"] and base[f"lo{i}"] <= 0]
    if wrong:
        raise ValueError(f"box-cox needs positive values; {wrong} have others")
    usable = [(i, c) for i, c in enumerate(names) if base[f"n{i}"] and base[f"lo{i}"] < base[f"hi{i}"]]
    ranges = {c: FIRST_RANGE for _, c in usable}
    left = {c: PASSES for _, c in usable}
    best = {c: 1.0 for c in names}
    while open_ := [(i, c) for i, c in usable if left[c]]:
        grids = {c: np.linspace(*ranges[c], GRID) for _, c in open_}
        row = df.agg(
            *[F.var_pop(SPREAD[method](values[c], float(lam))).alias(f"v{i}_{j}") for i, c in open_ for j, lam in enumerate(grids[c])]
        ).first()
        for i, c in open_:
            var = np.array([row[f"v{i}_{j}"] if row[f"v{i}_{j}"] else np.nan for j in range(GRID)], dtype=float)
            n = base[f"n{i}"]
            with np.errstate(all="ignore"):
                loglik = -n / 2 * np.log(var) + (grids[c] - 1) * base[f"s{i}"]
            loglik = np.where(np.isfinite(loglik), loglik, -np.inf)
            j = int(np.argmax(loglik))
            low, high = max(0, j - 1), min(GRID - 1, j + 1)
            best[c] = float(grids[c][j])
            inner = 1 if j == 0 else GRID - 2
            if j in (0, GRID - 1) and loglik[j] > loglik[inner]:
                # Far out the powers overflow and the likelihood is no number, so this ends.
                away = 3 * (grids[c][j] - grids[c][inner]) * (GRID - 1)
                ranges[c] = tuple(sorted((grids[c][inner], grids[c][j] + away)))
                continue
            ranges[c] = (grids[c][low], grids[c][high])
            left[c] -= 1
            if not left[c] and low < j < high and np.all(np.isfinite(loglik[low : high + 1])):
                a, b, d = loglik[low : high + 1]
                bend = a - 2 * b + d
                if bend < 0:
                    best[c] += float((a - d) / (2 * bend) * (grids[c][1] - grids[c][0]))
    row = df.agg(
        *[agg(FORWARD[method](values[c], best[c])).alias(f"{k}{i}") for i, c in enumerate(names) for k, agg in (("m", F.avg), ("d", F.stddev_pop))]
    ).first()
    return PowerModel(method, {c: (best[c], row[f"m{i}"] or 0.0, row[f"d{i}"] or 1.0) for i, c in enumerate(names)})


def _log_term(x: Column, method: str) -> Column:
    return F.log(F.when(x > 0, x)) if method == "box-cox" else F.signum(x) * F.log1p(F.abs(x))


@dataclass
class QuantileModel:
    """Per column the reference quantiles at evenly spaced probabilities."""

    method: str
    references: dict[str, list[float]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: self._map(c, False)(number(df, c)) for c in self.references})

    def inverse(self, df: DataFrame) -> DataFrame:
        return replace_columns(df, {c: self._map(c, True)(number(df, c)) for c in self.references})

    def _map(self, column: str, back: bool):
        refs = np.array(self.references[column])
        probs = np.linspace(0, 1, len(refs))
        normal = self.method == "quantile_normal"
        bell = NormalDist()
        ends = (bell.inv_cdf(CLIP), bell.inv_cdf(1 - CLIP))

        @F.pandas_udf(T.DoubleType())
        def forward(x: pd.Series) -> pd.Series:
            v = x.to_numpy(dtype=float)
            # The mean of both directions puts a run of equal references at its middle.
            up = np.interp(v, refs, probs)
            down = -np.interp(-v, -refs[::-1], -probs[::-1])
            p = (up + down) / 2
            p = np.where(v == refs[-1], 1.0, np.where(v == refs[0], 0.0, p))
            if normal:
                known = ~np.isnan(v)
                out = np.full(len(v), np.nan)
                out[known] = [
                    ends[0] if q <= CLIP else ends[1] if q >= 1 - CLIP else bell.inv_cdf(q) for q in p[known]
                ]
                p = out
            return pd.Series(np.where(np.isnan(v), np.nan, p)).astype(object).where(~np.isnan(v), None).astype("Float64")

        @F.pandas_udf(T.DoubleType())
        def backward(y: pd.Series) -> pd.Series:
            v = y.to_numpy(dtype=float)
            p = np.array([bell.cdf(q) if q == q else np.nan for q in v]) if normal else v
            if normal:
                p = np.where(v <= ends[0], 0.0, np.where(v >= ends[1], 1.0, p))
            return pd.Series(np.interp(p, probs, refs)).where(~np.isnan(v))

        return backward if back else forward


def fit_quantile(
    df: DataFrame, method: str = "quantile_uniform", columns: Sequence[str] | None = None, n_quantiles: int = QUANTILES, bucket_rows: int | None = None
) -> QuantileModel:
    """Exact evenly spaced quantiles of every column, read off the sorted distinct values."""
    validate_choice("method", method, METHODS[2:])
    names = validate_columns(df, columns or numeric_columns(df))
    return QuantileModel(method, even_quantiles(df, names, n_quantiles, bucket_rows))


def even_quantiles(df: DataFrame, columns: Sequence[str], wanted: int, bucket_rows: int | None = None) -> dict[str, list[float]]:
    """``min(wanted, n)`` quantiles per column at evenly spaced probabilities, linear interpolation."""
    ranked = sorted_counts(df, list(columns), bucket_rows)
    steps = F.greatest(F.least(F.lit(wanted), F.col("total")) - 1, F.lit(1))
    # Quantile i lies between ranks floor and ceil of i * (total - 1) / steps; each distinct value
    # holds the ranks below .. below + n - 1 and lists the quantiles that touch one of them.
    scale = (F.col("total") - 1) / steps
    first = F.greatest(F.floor((F.col("below") - 1) / scale).cast("long"), F.lit(0))
    last = F.least(F.ceil((F.col("below") + F.col("n")) / scale).cast("long"), steps.cast("long"))
    rows = ranked.select(
        "column", "value", "n", "below", scale.alias("scale"), steps.alias("steps"),
        F.explode(F.when(F.col("total") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(first, last))).alias("i"),
    )
    # i * (total - 1) / steps in this order keeps whole ranks exact.
    place = F.when(F.col("scale") == 0, 0.0).otherwise(F.col("i") * (F.col("scale") * F.col("steps")) / F.col("steps"))
    rows = rows.withColumn("place", F.round(place, 9))
    floor, ceil = F.floor("place"), F.ceil("place")
    holds = lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("n"))
    picked = (
        rows.withColumn("low", F.when(holds(floor), F.col("value")))
        .withColumn("high", F.when(holds(ceil), F.col("value")))
        .filter(F.col("low").isNotNull() | F.col("high").isNotNull())
        .groupBy("column", "i")
        .agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max(F.col("place") - F.floor("place")).alias("part"))
    )
    out: dict[str, list[float]] = {c: [] for c in columns}
    found = {c: {} for c in columns}
    for r in picked.collect():
        found[r["column"]][r["i"]] = r["low"] + r["part"] * (r["high"] - r["low"])
    for c, values in found.items():
        out[c] = list(np.maximum.accumulate([values[i] for i in sorted(values)])) if values else [0.0]
    return {c: [float(x) for x in v] for c, v in out.items()}


def fit_transform(df: DataFrame, method: str = "yeo-johnson", columns: Sequence[str] | None = None):
    """Fit the named transform and return the transformed table with the model, which can invert it."""
    validate_choice("method", method, METHODS)
    model = fit_power(df, method, columns) if method in FORWARD else fit_quantile(df, method, columns)
    return model.transform(df), model


def inverse_transform(df: DataFrame, model: PowerModel | QuantileModel | None) -> DataFrame:
    if model is None:
        raise ValueError("no transform has been fitted yet")
    return model.inverse(df)
