"""Imputation: simple fills, nearest rows, chained regressions, and the column-wise recommendation."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import (
    as_column,
    is_numeric,
    missing,
    number,
    replace_columns,
    validate_choice,
    validate_columns,
)
from ..session import write_table
from .joins import lookup_join
from .missing import blanks_to_null, columns_with_missing
from .quantiles import exact_quantiles
from .vectors import nearest_incomplete

METHODS = ["mean", "median", "most_frequent", "constant", "knn", "iterative"]
SCALERS = ["standard", "minmax"]
NEIGHBOURS = 5
ROUNDS = 10
MAX_PATTERNS = 2_000  # combinations of missing columns up to which their moments are worked on by the driver


@dataclass
class FillModel:
    """One fill value per column; None leaves the column's missing cells as they are."""

    fills: dict[str, float | str | None]

    def transform(self, df: DataFrame) -> DataFrame:
        new = {}
        for c, fill in self.fills.items():
            if fill is None:
                continue
            kept = number(df, c) if is_numeric(df, c) else as_column(c)
            new[c] = F.coalesce(kept, F.lit(fill))
        return replace_columns(df, new)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, float | str | None]:
    """The commonest value per column, the smallest of equally common ones."""
    out: dict[str, float | str | None] = {c: None for c in columns}
    groups = {
        "double": [c for c in columns if is_numeric(df, c)],
        "string": [c for c in columns if not is_numeric(df, c)],
    }
    for kind, names in groups.items():
        if not names:
            continue
        values = [number(df, c) if kind == "double" else as_column(c).cast("string") for c in names]
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in zip(names, values)]))
        counts = (
            df.select(cells.alias("r")).select("r.*").filter(F.col("value").isNotNull())
            .groupBy("column", "value").agg(F.count("*").alias("n"))
        )
        best = counts.groupBy("column").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("value"))).alias("best"))
        out.update({r["column"]: r["best"]["value"] for r in best.collect()})
    return out


def fit_simple(df: DataFrame, method: str, columns: Sequence[str], scale: str | None = None) -> FillModel:
    """Mean, median, mode or constant (0) for numeric columns, always the mode for others.

    Scaling before and undoing it after changes only the constant: 0 is then the mean (standard) or the
    minimum (minmax) of the column.
    """
    numeric = [c for c in columns if is_numeric(df, c)]
    fills: dict[str, float | str | None] = {}
    if method == "median":
        fills = {c: q[0.5] for c, q in exact_quantiles(df, numeric, [0.5]).items()} if numeric else {}
    elif method == "most_frequent":
        fills = modes(df, numeric)
    elif numeric and (method == "mean" or scale):
        agg = F.min if method == "constant" and scale == "minmax" else F.avg
        row = df.agg(*[agg(number(df, c)).cast("double").alias(f"s{i}") for i, c in enumerate(numeric)]).first()
        fills = {c: row[f"s{i}"] for i, c in enumerate(numeric)}
    if method == "constant":
        fills = {c: 0.0 if fills.get(c) is None else fills[c] for c in numeric}
    return FillModel({**fills, **modes(df, [c for c in columns if c not in numeric])})


def _pattern(df: DataFrame, columns: Sequence[str]) -> Column:
    """One character per column: 1 where it is present, else 0."""
    return F.concat(*[F.when(missing(df, c), "0").otherwise("1") for c in columns])


def _present(pattern: str) -> list[int]:
    return [i for i, mark in enumerate(pattern) if mark == "1"]


def impute_knn(df: DataFrame, columns: Sequence[str], k: int = NEIGHBOURS, **sizes) -> DataFrame:
    """Mean of the k nearest rows that have the column, by the distance over the columns both rows have.

    Squared distances are scaled up by (columns / columns in common); equal distances prefer the smaller
    value, and a cell without any comparable row gets the column mean. Equal rows are searched once, and one search answers for all
    combinations of missing columns (:func:`.vectors.nearest_incomplete`).
    """
    names = validate_columns(df, columns)
    size = len(names)
    if size == 1:
        return fit_simple(df, "mean", names).transform(df)
    means = fit_simple(df, "mean", names)
    # Grouping turns -0.0 into 0.0, so the search keys must not tell them apart either.
    vector = F.array(*[F.when(number(df, c) == 0, 0.0).otherwise(number(df, c).cast("double")) for c in names])
    rows = df.select(vector.alias("v")).groupBy("v").agg(F.count("*").alias("n")).withColumn("id", F.monotonically_increasing_id())
    rows = write_table(rows, "different_rows")
    used = nearest_incomplete(rows, size, k, **sizes)
    take = F.least(F.col("n"), F.lit(k) - F.col("before"))
    fills = used.groupBy("id", "target").agg((F.sum(F.col("item") * take) / F.sum(take)).alias("fill"))
    # One row per incomplete combination with the fills of all its missing columns.
    table = fills.groupBy("id").agg(*[F.max(F.when(F.col("target") == i, F.col("fill"))).alias(f"_f{i}") for i in range(size)])
    table = table.join(rows.select("id", F.to_json("v").alias("_q")), "id").drop("id")
    keyed = df.withColumn("_q", F.to_json(vector))
    joined = lookup_join(keyed, table, ["_q"])
    new = {
        c: F.coalesce(number(df, c), F.col(f"_f{i}"), F.lit(means.fills[c]).cast("double")) for i, c in enumerate(names)
    }
    return joined.select(*[new[c].alias(c) if c in new else as_column(c) for c in df.columns])


@dataclass
class ChainModel:
    """Column means and the regressions in the order they were made: (column, intercept, coefficients), all on deviations
    from the means. A missing cell starts at its mean and takes the value of each regression of its column."""

    columns: list[str]
    means: list[float]
    steps: list[tuple[int, float, list[float]]]

    def deviations(self, df: DataFrame) -> Column:
        return F.array(*[F.coalesce(number(df, c) - m, F.lit(0.0)) for c, m in zip(self.columns, self.means)])

    def transform(self, df: DataFrame) -> DataFrame:
        state = df.withColumn("_m", F.array(*[missing(df, c) for c in self.columns])).withColumn("_x", self.deviations(df))
        done = state.withColumn("_x", apply_steps(F.col("_x"), F.col("_m"), self.steps))
        new = {c: F.coalesce(number(df, c), F.col("_x")[i] + self.means[i]) for i, c in enumerate(self.columns)}
        return done.select(*[new[c].alias(c) if c in new else as_column(c) for c in df.columns])


def apply_steps(x: Column, gone: Column, steps: list[tuple[int, float, list[float]]]) -> Column:
    """The deviations ``x`` after the regressions ``steps`` have filled the cells marked in ``gone`` one after the other."""
    if not steps:
        return x
    text = json.dumps([{"c": c, "b": b, "w": w} for c, b, w in steps])
    listed = F.from_json(F.lit(text), "array<struct<c:int,b:double,w:array<double>>>")  # folded into one literal

    def step(now: Column, s: Column) -> Column:
        value = F.aggregate(F.zip_with(s.w, now, lambda w, v: w * v), s.b, lambda a, v: a + v)
        return F.transform(now, lambda v, i: F.when((i == s.c) & F.get(gone, i), value).otherwise(v))

    return F.aggregate(listed, x, step)


def _bayesian_ridge(n: float, gram: np.ndarray, cross: np.ndarray, target: float) -> np.ndarray:
    """Coefficients of a Bayesian ridge regression from centred moment sums, by evidence maximisation."""
    prior = 1e-6
    values, vectors = np.linalg.eigh(gram)
    values = np.maximum(values, 0.0)
    rotated = vectors.T @ cross
    alpha, lam = 1.0 / (target / n + np.finfo(float).eps), 1.0
    coef = np.zeros(len(cross))
    for _ in range(300):
        new = vectors @ (rotated / (values + lam / alpha))
        residual = max(target - 2 * new @ cross + new @ gram @ new, 0.0)
        gamma = float(np.sum(alpha * values / (lam + alpha * values)))
        lam = (gamma + 2 * prior) / (float(new @ new) + 2 * prior)
        alpha = (n - gamma + 2 * prior) / (residual + 2 * prior)
        done = np.sum(np.abs(new - coef)) < 1e-3
        coef = new
        if done:
            break
    return vectors @ (rotated / (values + lam / alpha))


def fit_iterative(
    df: DataFrame, columns: Sequence[str], rounds: int = ROUNDS, tol: float = 1e-3, max_patterns: int = MAX_PATTERNS
) -> ChainModel:
    """Round-robin Bayesian ridge regressions, from one pass over the table as long as few combinations of columns are missing.

    Whatever the round, an imputed cell is an affine function of the row's present values, the same for all
    rows that miss the same columns. So counts, sums and cross products per such group are all the
    regressions need; the rounds run on those few numbers. It stops when the mean squared change of the
    imputed cells falls below ``tol`` times the largest present value.
    """
    names = validate_columns(df, columns)
    size = len(names)
    row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(names)], *[F.max(F.abs(number(df, c))).alias(f"x{i}") for i, c in enumerate(names)]).first()
    means = np.array([row[f"m{i}"] if row[f"m{i}"] is not None else np.nan for i in range(size)])
    largest = max([row[f"x{i}"] or 0.0 for i in range(size)], default=0.0)
    # Deviations from the column mean keep the cross products well conditioned.
    devs = [F.coalesce(number(df, c) - (means[i] if means[i] == means[i] else 0.0), F.lit(0.0)) for i, c in enumerate(names)]
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    grouped = df.select(_pattern(df, names).alias("p"), *[d.alias(f"d{i}") for i, d in enumerate(devs)]).groupBy("p").agg(
        F.count("*").alias("n"),
        *[F.sum(f"d{i}").alias(f"s{i}") for i in range(size)],
        *[F.sum(F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}_{j}") for i, j in upper],
    )
    stats = grouped.limit(max_patterns + 1).collect()
    shift = [float(m) if m == m else float("nan") for m in means]
    usable = [i for i in range(size) if means[i] == means[i]]
    if len(usable) < 2:
        return ChainModel(names, shift, [])
    if len(stats) > max_patterns:
        return _fit_by_passes(df, names, shift, usable, largest, rounds, tol)
    groups = {}
    for r in stats:
        cross = np.zeros((size + 1, size + 1))
        cross[0, 0] = r["n"]
        cross[0, 1:] = cross[1:, 0] = [r[f"s{i}"] for i in range(size)]
        for i, j in upper:
            cross[i + 1, j + 1] = cross[j + 1, i + 1] = r[f"c{i}_{j}"]
        # Rows of the map: (1, x1, ..., xp) as a function of (1, present deviations); missing starts at the mean.
        groups[r["p"]] = [np.diag([1.0] + [float(mark) for mark in r["p"]]), cross]
    gaps = [sum(r["n"] for r in stats if r["p"][i] == "0") for i in range(size)]
    order = sorted([i for i in usable if gaps[i]], key=lambda i: (gaps[i], i))
    steps: list[tuple[int, float, list[float]]] = []
    for _ in range(rounds):
        change = 0.0
        for c in order:
            total = np.zeros((size + 1, size + 1))
            for p, (m, s) in groups.items():
                if p[c] == "1":
                    total += m @ s @ m.T
            step = _regression(total, c, usable)
            steps.append((c, float(step[0]), [float(v) for v in step[1:]]))
            for p, (m, s) in groups.items():
                if p[c] == "0":
                    old, new = m[c + 1].copy(), step @ m
                    diff = new - old
                    change = max(change, float(diff @ s @ diff) / max(s[0, 0], 1.0))
                    m[c + 1] = new
        if change**0.5 < tol * largest:
            break
    return ChainModel(names, shift, steps)


def _regression(total: np.ndarray, c: int, usable: list[int]) -> np.ndarray:
    """Intercept and coefficients of column ``c`` on the other usable ones, from sums and cross products of (1, x1, ..., xp)."""
    others = [i for i in usable if i != c]
    n = total[0, 0]
    centre = total[0, 1:] / n
    cov = total[1:, 1:] - n * np.outer(centre, centre)
    coef = _bayesian_ridge(n, cov[np.ix_(others, others)], cov[others, c], cov[c, c])
    step = np.zeros(len(total))
    step[0] = centre[c] - coef @ centre[others]
    step[[i + 1 for i in others]] = coef
    return step


def _fit_by_passes(
    df: DataFrame, names: list[str], means: list[float], usable: list[int], largest: float, rounds: int, tol: float
) -> ChainModel:
    """The same regressions by passes over the table, whatever the number of combinations of missing columns.

    Each regression aggregates the cross products of the rows that have its column; the filled table is written after each round.
    """
    size, model = len(names), ChainModel(names, [m if m == m else 0.0 for m in means], [])
    rows = write_table(
        df.select(_pattern(df, names).alias("p"), F.array(*[missing(df, c) for c in names]).alias("m"), model.deviations(df).alias("x")), "chain"
    )
    row = rows.agg(*[F.count_if(F.col("m")[i]).alias(f"g{i}") for i in range(size)]).first()
    order = sorted([i for i in usable if row[f"g{i}"]], key=lambda i: (row[f"g{i}"], i))
    upper = [(i, j) for i in range(size) for j in range(i, size)]
    for _ in range(rounds):
        change, made = 0.0, []
        for c in order:
            now = rows.withColumn("x", apply_steps(F.col("x"), F.col("m"), made))
            sums = now.filter(~F.col("m")[c]).agg(
                F.count("*").alias("n"),
                *[F.sum(F.col("x")[i]).alias(f"s{i}") for i in range(size)],
                *[F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"c{i}_{j}") for i, j in upper],
            ).first()
            total = np.zeros((size + 1, size + 1))
            total[0, 0] = sums["n"]
            total[0, 1:] = total[1:, 0] = [sums[f"s{i}"] for i in range(size)]
            for i, j in upper:
                total[i + 1, j + 1] = total[j + 1, i + 1] = sums[f"c{i}_{j}"]
            step = _regression(total, c, usable)
            made.append((c, float(step[0]), [float(v) for v in step[1:]]))
            after = now.filter(F.col("m")[c]).withColumn("y", apply_steps(F.col("x"), F.col("m"), made[-1:]))
            moved = after.groupBy("p").agg(F.avg(F.pow(F.col("y")[c] - F.col("x")[c], 2)).alias("d")).agg(F.max("d")).first()[0]
            change = max(change, moved or 0.0)
        rows = write_table(rows.withColumn("x", apply_steps(F.col("x"), F.col("m"), made)), "chain")
        model.steps += made
        if change**0.5 < tol * largest:
            break
    return ChainModel(names, means, model.steps)


def impute_iterative(df: DataFrame, columns: Sequence[str], rounds: int = ROUNDS) -> DataFrame:
    done = fit_iterative(df, columns, rounds).transform(df)
    return replace_columns(done, {c: number(done, c) for c in columns})


def _affine(df: DataFrame, columns: Sequence[str], scale: str) -> dict[str, tuple[float, float]]:
    kinds = (F.avg, F.stddev_pop) if scale == "standard" else (F.min, F.max)
    row = df.agg(*[a(number(df, c)).alias(f"s{j}_{i}") for i, c in enumerate(columns) for j, a in enumerate(kinds)]).first()
    out = {}
    for i, c in enumerate(columns):
        a, b = row[f"s0_{i}"], row[f"s1_{i}"]
        if a is None:
            out[c] = (0.0, 1.0)
        else:
            width = b if scale == "standard" else b - a
            out[c] = (float(a), float(width) or 1.0)
    return out


def impute(
    df: DataFrame, method: str = "mean", columns: Sequence[str] | None = None, scale: str | None = None, **sizes
) -> tuple[DataFrame, list[str]]:
    """Fill missing cells and report the columns used; all columns with missing cells by default.

    Blank text counts as missing. Text columns get their mode whatever the method, a column without any
    value stays missing (constant: 0), and the column order is kept.
    """
    validate_choice("method", method, METHODS)
    if scale is not None:
        validate_choice("scale", scale, SCALERS)
    df = blanks_to_null(df, None if columns is None else list(columns))
    names = validate_columns(df, columns) if columns is not None else columns_with_missing(df)
    if not names:
        return df, []
    numeric = [c for c in names if is_numeric(df, c)]
    if method in ("knn", "iterative") and numeric:
        text = [c for c in names if c not in numeric]
        units = _affine(df, numeric, scale) if scale else {}
        work = replace_columns(df, {c: (number(df, c) - a) / b for c, (a, b) in units.items()})
        work = impute_knn(work, numeric, **sizes) if method == "knn" else impute_iterative(work, numeric)
        work = replace_columns(work, {c: as_column(c) * b + a for c, (a, b) in units.items()})
        return FillModel(modes(df, text)).transform(work), list(names)
    return fit_simple(df, method, names, scale).transform(df), list(names)


def impute_array(df: DataFrame, array_col: str, width: int, method: str = "mean", scale: str | None = None) -> DataFrame:
    """Impute an array column position by position; the positions are named ``Feature_i`` meanwhile."""
    names = [f"Feature_{i}" for i in range(width)]
    item = lambda i: F.try_element_at(as_column(array_col), F.lit(i + 1)).cast("double")
    wide = df.select("*", *[F.when(~F.isnan(item(i)), item(i)).alias(c) for i, c in enumerate(names)])
    done, _ = impute(wide, method, names, scale)
    return done.withColumn(array_col, F.array(*names)).select(*df.columns)

