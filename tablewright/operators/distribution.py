"""Shape of numeric columns: moments, normality, outliers, best-fitting family, neighbour distances."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import as_column, long_rows, number, numeric_columns, validate_columns
from ..functions.hashing import SEED, row_hash
from ..functions.probability import correlation, gamma_p, gamma_shape, normal_cdf, normality_p
from .ordering import bucketed, sorted_counts, with_halo
from .quantiles import exact_quantiles

FAMILIES = ["normal", "uniform", "exponential", "lognormal", "gamma"]
#: Where lognormal and gamma fits may start: shares of the range below the minimum.
LOCATIONS = [0.00125 * 2**i for i in range(9)]
NEIGHBOURS = 3
TREES, TREE_ROWS, CONTAMINATION = 100, 256, 0.1


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One wide row with every moment of every column; column i has suffix i."""
    kinds = {
        "n": F.count, "mean": F.avg, "std": F.stddev_pop, "ssd": F.stddev_samp,
        "skew": F.skewness, "kurt": F.kurtosis, "min": F.min, "max": F.max,
    }
    return df.agg(
        F.count("*").alias("rows"),
        *[agg(number(df, c)).alias(f"{k}{i}") for i, c in enumerate(columns) for k, agg in kinds.items()],
    )


def moments(df: DataFrame, columns: Sequence[str]) -> dict[str, dict[str, float | None]]:
    row = _moments(df, columns).first()
    return {
        c: {"rows": row["rows"], **{k: row[f"{k}{i}"] for k in ("n", "mean", "std", "ssd", "skew", "kurt", "min", "max")}}
        for i, c in enumerate(columns)
    }


def distribution_stats(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Mean, median, population std, biased skewness and excess kurtosis, unique and missing ratio, range.

    Columns with fewer than two values have no row.
    """
    names = validate_columns(df, columns or numeric_columns(df))
    medians = exact_quantiles(df, names, [0.5])
    records = [
        {
            "column": F.lit(c),
            "n": F.col(f"n{i}"),
            "mean": F.col(f"mean{i}"),
            "median": F.lit(medians[c][0.5]).cast("double"),
            "std": F.col(f"std{i}"),
            "skewness": F.col(f"skew{i}"),
            "kurtosis": F.col(f"kurt{i}"),
            "missing_ratio": 1 - F.col(f"n{i}") / F.col("rows"),
            "value_range": F.col(f"max{i}") - F.col(f"min{i}"),
        }
        for i, c in enumerate(names)
    ]
    unique = sorted_distinct(df, names)
    stats = long_rows(_moments(df, names), records).filter(F.col("n") >= 2)
    return stats.join(F.broadcast(unique), "column").withColumn("unique_ratio", F.col("unique") / F.col("n")).drop("unique")


def sorted_distinct(df: DataFrame, columns: list[str]) -> DataFrame:
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), number(df, c).alias("v")) for c in columns]))
    pairs = df.select(cells.alias("r")).select("r.*").filter(F.col("v").isNotNull()).distinct()
    return pairs.groupBy("column").agg(F.count("*").alias("unique"))


def skew_adjusted(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Bias-corrected skewness; NULL below three values."""
    names = validate_columns(df, columns or numeric_columns(df))

    def corrected(i: int) -> Column:
        n = F.col(f"n{i}").cast("double")
        return F.when(n > 2, F.col(f"skew{i}") * F.sqrt(n * (n - 1)) / (n - 2))

    return long_rows(
        _moments(df, names), [{"column": F.lit(c), "skewness": corrected(i)} for i, c in enumerate(names)]
    )


def normality_test(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """p value of the skewness-kurtosis test and whether it exceeds 0.05; too few values are not normal."""
    names = validate_columns(df, columns or numeric_columns(df))

    rows = long_rows(
        _moments(df, names),
        [
            {"column": F.lit(c), "n": F.col(f"n{i}").cast("double"), "skew": F.col(f"skew{i}"), "kurt": F.col(f"kurt{i}")}
            for i, c in enumerate(names)
        ],
    )
    p = normality_p(F.col("n"), F.col("skew"), F.col("kurt"))
    return rows.select("column", p.alias("p_value")).withColumn("is_normal", F.coalesce(F.col("p_value") > 0.05, F.lit(False)))


def _farthest(i: int) -> Column:
    return F.greatest(F.col(f"max{i}") - F.col(f"mean{i}"), F.col(f"mean{i}") - F.col(f"min{i}"))


def outlier_3sigma(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whether any value lies more than three sample standard deviations from the mean."""
    return _sigma_rule(df, columns, "ssd")


def outliers_zscore(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Whether any population z score exceeds three."""
    return _sigma_rule(df, columns, "std")


def _sigma_rule(df: DataFrame, columns: list[str] | None, spread: str) -> DataFrame:
    names = validate_columns(df, columns or numeric_columns(df))
    return long_rows(
        _moments(df, names),
        [
            {
                "column": F.lit(c),
                "max_z": F.try_divide(_farthest(i), F.col(f"{spread}{i}")),
                "has_outliers": F.coalesce(_farthest(i) > 3 * F.col(f"{spread}{i}"), F.lit(False)),
            }
            for i, c in enumerate(names)
        ],
    )


def outliers_iqr(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The fences 1.5 IQR outside the quartiles and the number of values beyond them."""
    names = validate_columns(df, columns or numeric_columns(df))
    fences = {c: [F.lit(x).cast("double") for x in f] for c, f in iqr_fences(df, names).items()}
    aggs = [F.count_if(~number(df, c).between(*fences[c])).alias(f"o{i}") for i, c in enumerate(names)]
    return long_rows(
        df.agg(*aggs),
        [
            {
                "column": F.lit(c),
                "lower_fence": fences[c][0],
                "upper_fence": fences[c][1],
                "n_outliers": F.col(f"o{i}"),
                "has_outliers": F.col(f"o{i}") > 0,
            }
            for i, c in enumerate(names)
        ],
    )


def iqr_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float | None, float | None]]:
    quart = exact_quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = quart[c][0.25], quart[c][0.75]
        out[c] = (None, None) if q1 is None else (q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def _average_path(n):
    """Mean depth of an unsuccessful search in a binary tree of n values."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, 2 * (np.log(safe - 1) + np.euler_gamma) - 2 * (safe - 1) / safe))


def _grow(values: np.ndarray, depth: int, limit: int, rng, cuts: list[float], paths: list[float]) -> None:
    if depth >= limit or len(values) <= 1 or values[0] == values[-1]:
        paths.append(depth + float(_average_path(len(values))))
        return
    cut = rng.uniform(values[0], values[-1])
    at = int(np.searchsorted(values, cut, side="left"))
    _grow(values[:at], depth + 1, limit, rng, cuts, paths)
    cuts.append(cut)
    _grow(values[at:], depth + 1, limit, rng, cuts, paths)


def outliers_isoforest(df: DataFrame, key: list[str], columns: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Isolation forest per column: 100 trees of at most 256 values, contamination 0.1.

    The trees' values are a fixed-size sample (it is part of the method) drawn by hash order; each
    tree is a step function, grown in its own task. Their mean is again a step function, so scoring
    all rows is one count per step. Fewer than ten values report no outliers.
    """
    names = validate_columns(df, columns or numeric_columns(df))
    spark, parts = df.sparkSession, []
    for c in names:
        values = df.select(number(df, c).alias("v"), row_hash(*key, seed=f"{c}|{seed}").alias("h")).filter(F.col("v").isNotNull())
        sample = np.array([r["v"] for r in values.orderBy("h").limit(TREES * TREE_ROWS).select("v").collect()])
        if len(sample) < 10:
            parts.append((c, 0.0, 0, False))
            continue
        parts.append((c, *_forest_verdict(spark, values, sample, seed)))
    return spark.createDataFrame(parts, "column string, threshold double, n_outliers bigint, has_outliers boolean")


def _forest_verdict(spark, values: DataFrame, sample: np.ndarray, seed: int) -> tuple[float, int, bool]:
    size = min(TREE_ROWS, len(sample))
    limit = math.ceil(math.log2(max(size, 2)))

    def grow(frames):
        for frame in frames:
            for tree in frame["id"]:
                rng = np.random.default_rng([seed, int(tree)])
                cuts: list[float] = []
                paths: list[float] = []
                _grow(np.sort(rng.choice(sample, size, replace=False)), 0, limit, rng, cuts, paths)
                yield pd.DataFrame({"cuts": [cuts], "paths": [paths]})

    trees = spark.range(TREES).mapInPandas(grow, "cuts array<double>, paths array<double>").collect()
    edges = np.unique(np.concatenate([t["cuts"] for t in trees]))
    if not len(edges):
        return 0.0, 0, False
    inside = np.concatenate([[edges[0] - 1], edges])
    path = np.zeros(len(inside))
    for t in trees:
        path += np.asarray(t["paths"])[np.searchsorted(np.asarray(t["cuts"]), inside, side="right")]
    normality = -(2.0 ** (-(path / TREES) / float(_average_path(size))))
    steps = Bucketizer(splits=[-math.inf, *edges.tolist(), math.inf], inputCol="v", outputCol="step")
    counts = {int(r["step"]): r["n"] for r in steps.transform(values).groupBy("step").agg(F.count("*").alias("n")).collect()}
    filled = sorted((normality[s], n) for s, n in counts.items())
    scores, weights = np.array([s for s, _ in filled]), np.array([n for _, n in filled])
    upto = np.cumsum(weights)
    rank = (upto[-1] - 1) * CONTAMINATION
    low, high = (scores[np.searchsorted(upto, r, side="right")] for r in (math.floor(rank), math.ceil(rank)))
    threshold = float(low + (rank - math.floor(rank)) * (high - low))
    beyond = int(weights[scores < threshold].sum())
    return threshold, beyond, beyond > 0


def has_outliers(
    df: DataFrame, key: list[str], columns: list[str] | None = None, methods: Sequence[str] = ("z", "iqr", "forest")
) -> DataFrame:
    """Whether any of the chosen outlier rules fires."""
    names = validate_columns(df, columns or numeric_columns(df))
    checks = {
        "z": lambda: outliers_zscore(df, names),
        "iqr": lambda: outliers_iqr(df, names),
        "forest": lambda: outliers_isoforest(df, key, names),
    }
    out = None
    for m in methods:
        part = checks[m]().select("column", F.col("has_outliers").alias(m))
        out = part if out is None else out.join(F.broadcast(part), "column")
    verdict = F.greatest(*[F.col(m) for m in methods]) if len(methods) > 1 else F.col(methods[0])
    return out.withColumn("has_outliers", verdict)


class Fit(NamedTuple):
    """A fitted family: where it starts or is centred, its scale, its shape if it has one, the mean log-likelihood of a row."""

    location: float
    scale: float
    shape: float | None
    likelihood: float


def _likeliest(df: DataFrame, known: dict[str, dict]) -> dict[str, dict[str, Fit]]:
    """Fits to each standardised column, from its moments and one pass of log moments at all ``LOCATIONS``."""
    ends = {c: ((m["min"] - m["mean"]) / m["std"], (m["max"] - m["mean"]) / m["std"]) for c, m in known.items()}
    starts = {c: [low - share * (high - low) for share in LOCATIONS] for c, (low, high) in ends.items()}

    def log_of(c: str, start: float) -> Column:
        return F.log((number(df, c) - known[c]["mean"]) / known[c]["std"] - start)

    logs = df.agg(
        *[
            agg(log_of(c, start)).alias(f"{k}{i}_{j}")
            for i, c in enumerate(known)
            for j, start in enumerate(starts[c])
            for k, agg in (("m", F.avg), ("s", F.stddev_pop))
        ]
    ).first()
    fits = {}
    for i, (c, (low, high)) in enumerate(ends.items()):
        lognormal, gamma = [], []
        for j, start in enumerate(starts[c]):
            m, s = logs[f"m{i}_{j}"], logs[f"s{i}_{j}"]
            lognormal.append(Fit(start, math.exp(m), s, -m - math.log(s) - math.log(2 * math.pi) / 2 - 0.5))
            # The mean after standardising is 0, so the mean above the start is -start.
            k = gamma_shape(math.log(-start) - m)
            scale = -start / k
            gamma.append(Fit(start, scale, k, (k - 1) * m - k - k * math.log(scale) - math.lgamma(k)))
        fits[c] = {
            "normal": Fit(0.0, 1.0, None, -math.log(2 * math.pi) / 2 - 0.5),
            "uniform": Fit(low, high - low, None, -math.log(high - low)),
            "exponential": Fit(low, -low, None, -math.log(-low) - 1),
            "lognormal": max(lognormal, key=lambda f: f.likelihood),
            "gamma": max(gamma, key=lambda f: f.likelihood),
        }
    return fits


def fit_families(df: DataFrame, columns: list[str] | None = None, known: dict[str, dict] | None = None) -> DataFrame:
    """``column, family, location, scale, shape, likelihood`` of the likeliest normal, uniform, exponential, lognormal and gamma.

    Lognormal (``scale``: the median above ``location``) and gamma start at the likeliest of ``LOCATIONS`` below the minimum; nearer
    to it the likelihood would grow without bound. ``likelihood`` is the mean logarithm per row. Columns of fewer
    than two values or of a single one have no rows. All columns share two passes.
    """
    names = validate_columns(df, columns or numeric_columns(df))
    known = {c: m for c, m in (known or moments(df, names)).items() if c in names and m["n"] >= 2 and m["std"]}
    rows = []
    for c, fits in (_likeliest(df, known) if known else {}).items():
        mean, std = known[c]["mean"], known[c]["std"]
        rows += [(c, k, mean + f.location * std, f.scale * std, f.shape, f.likelihood - math.log(std)) for k, f in fits.items()]
    return df.sparkSession.createDataFrame(
        rows, "column string, family string, location double, scale double, shape double, likelihood double"
    )


def ks_statistics(
    df: DataFrame,
    columns: list[str] | None = None,
    bucket_rows: int | None = None,
    known: dict[str, dict] | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """Kolmogorov-Smirnov distance of each standardised column to five fitted families.

    The families are those of :func:`fit_families`. ``known`` and ``ranked`` take
    :func:`moments` and ``sorted_counts`` of the same columns if they are at hand.
    """
    names = validate_columns(df, columns or numeric_columns(df))
    ranked = sorted_counts(df, names, bucket_rows) if ranked is None else ranked
    known = {c: m for c, m in (known or moments(df, names)).items() if m["n"] >= 2 and m["std"]}
    names = [c for c in names if c in known]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, " + ", ".join(f"ks_{f} double" for f in FAMILIES))
    fits = _likeliest(df, known)
    params = {
        c: (known[c]["mean"], known[c]["std"], f["uniform"].location, f["exponential"].scale, f["uniform"].scale,
            f["lognormal"].location, math.log(f["lognormal"].scale), f["lognormal"].shape)
        for c, f in fits.items()
    }

    def param(k: int) -> Column:
        out = F.lit(None).cast("double")
        for c in names:
            out = F.when(F.col("column") == c, F.lit(float(params[c][k]))).otherwise(out)
        return out

    @F.pandas_udf(T.DoubleType())
    def gamma_cdf(column: pd.Series, z: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=z.index)
        for c in column.unique():
            at, f = column == c, fits[c]["gamma"]
            out[at] = gamma_p(f.shape, (z[at].to_numpy() - f.location) / f.scale)
        return out

    ranked = ranked.filter(F.col("column").isin(names)).withColumn("z", (F.col("value") - param(0)) / param(1))
    low, zc = param(2), F.col("z")
    cdf = {
        "normal": normal_cdf(zc),
        "uniform": (zc - low) / param(4),
        "exponential": 1 - F.exp(-(zc - low) / param(3)),
        "lognormal": normal_cdf((F.log(zc - param(5)) - param(6)) / param(7)),
        "gamma": gamma_cdf("column", "z"),
    }
    above = (F.col("below") + F.col("n")) / F.col("total")
    under = F.col("below") / F.col("total")
    rows = ranked.select("column", above.alias("above"), under.alias("under"), *[cdf[f].alias(f) for f in FAMILIES])
    return rows.groupBy("column").agg(
        *[F.max(F.greatest(F.col("above") - F.col(f), F.col(f) - F.col("under"))).alias(f"ks_{f}") for f in FAMILIES]
    )


def identify_distribution(
    df: DataFrame, columns: list[str] | None = None, families: Sequence[str] = FAMILIES, **shared
) -> DataFrame:
    """The family with the smallest KS distance; text columns are categorical, others without a fit unknown."""
    names = validate_columns(df, columns or df.columns)
    numeric = [c for c in names if c in numeric_columns(df)]
    ks = ks_statistics(df, numeric, **shared) if numeric else None
    kinds = long_rows(
        df.sparkSession.range(1),
        [{"column": F.lit(c), "kind": F.lit("unknown" if c in numeric else "categorical")} for c in names],
    )
    if ks is None:
        return kinds.withColumnRenamed("kind", "distribution_type")
    best = F.least(*[F.struct(F.col(f"ks_{f}").alias("d"), F.lit(i).alias("i"), F.lit(f).alias("name")) for i, f in enumerate(families)])
    return kinds.join(ks, "column", "left").select(
        "column", F.coalesce(F.when(F.col(f"ks_{families[0]}").isNotNull(), best["name"]), "kind").alias("distribution_type")
    )


def spatial_correlation(
    df: DataFrame,
    columns: list[str] | None = None,
    bucket_rows: int | None = None,
    known: dict[str, dict] | None = None,
    ranked: DataFrame | None = None,
) -> DataFrame:
    """1 - mean distance to the nearest min(3, n - 1) other values / population std; 0 below three values.

    In one dimension the three nearest lie within three places in sorted order, so equal values are
    counted once and each distinct value looks at three distinct values on either side.
    """
    names = validate_columns(df, columns or numeric_columns(df))
    ranked = sorted_counts(df, names, bucket_rows) if ranked is None else ranked
    ranked = ranked.select("column", "_bucket", "value", "n", "total")
    ranked = with_halo(ranked, ["column"], "value", NEIGHBOURS, NEIGHBOURS)
    line = Window.partitionBy("column", "_bucket").orderBy("value")
    k = F.least(F.lit(NEIGHBOURS), F.col("total") - 1).cast("int")
    near = []
    for step in range(1, NEIGHBOURS + 1):
        for move in (F.lag, F.lead):
            value, copies = move("value", step).over(line), move("n", step).over(line)
            gap = F.when(value.isNotNull(), F.abs(F.col("value") - value))
            times = F.least(F.coalesce(copies, F.lit(0)), F.lit(NEIGHBOURS)).cast("int")
            near.append(F.array_repeat(gap, times))
    own = F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(NEIGHBOURS)).cast("int"))
    rows = ranked.withColumn("near", F.slice(F.array_sort(F.concat(own, *near)), F.lit(1), k)).filter(~F.col("_halo"))
    mean = F.aggregate("near", F.lit(0.0), lambda a, x: a + x) / k
    rows = rows.filter(F.col("total") >= 3).select("column", "value", "n", mean.alias("mean"))
    weighted = rows.groupBy("column").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("distance"))
    known = known or moments(df, names)
    spread = df.sparkSession.createDataFrame([(c, known[c]["std"]) for c in names], "column string, std double")
    score = F.when(F.col("std") > 0, 1 - F.col("distance") / F.col("std"))
    return spread.join(F.broadcast(weighted), "column", "left").select("column", F.coalesce(score, F.lit(0.0)).alias("spatial_correlation"))


def autocorr_lag1(
    df: DataFrame, order_col: str, columns: list[str] | None = None, bucket_rows: int | None = None, ties: Sequence[str] = ()
) -> DataFrame:
    """Absolute correlation of each column with itself one non-null row earlier; undefined gives 0.

    All columns share one pass over ranges of the order: each range starts with the last value of every column in the
    ranges before it. ``ties`` decide among rows of equal order; rows without an order come first.
    """
    names = validate_columns(df, columns or [c for c in numeric_columns(df) if c != order_col])
    validate_columns(df, [order_col, *ties])
    xs = [f"_x{i}" for i in range(len(names))]
    rows = df.select(
        as_column(order_col).alias("_order"),
        *[as_column(c).alias(f"_t{i}") for i, c in enumerate(ties)],
        *[number(df, c).alias(x) for c, x in zip(names, xs)],
    )
    rows = bucketed(rows, {"order": F.col("_order")}, bucket_rows)
    rows = rows.withColumn("_bucket", F.when(F.col("_order").isNull(), -1).otherwise(F.col("_b_order"))).drop("_b_order")
    place = F.struct("_order", *[f"_t{i}" for i in range(len(ties))])
    ends = rows.groupBy("_bucket").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), place)).alias(x) for x in xs])
    # One row a range, as many as there are ranges of the order.
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select("_bucket", *[F.last(x, ignorenulls=True).over(earlier).alias(x) for x in xs], F.lit(True).alias("_head"))
    line = Window.partitionBy("_bucket").orderBy(F.desc("_head"), place).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    pairs = both.select("_head", *xs, *[F.last(x, ignorenulls=True).over(line).alias(f"{x}_before") for x in xs]).filter(~F.col("_head"))
    corrs = [F.abs(correlation(F.col(x), F.col(f"{x}_before"))).alias(x) for x in xs]
    records = [{"column": F.lit(c), "autocorrelation": F.coalesce(x, F.lit(0.0))} for c, x in zip(names, xs)]
    return long_rows(pairs.agg(*corrs), records)
