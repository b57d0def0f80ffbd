"""Feature scores and selection."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_column, long_rows, number, numeric_columns, validate_choice, validate_columns
from ..functions.hashing import SEED
from ..functions.probability import digamma
from ..session import write_table
from .joins import lookup_join
from .ordering import dense_index, in_range, range_bounds, with_halo

METHODS = ["kbest", "mutual_info", "random_forest"]
TREES = 100
NEIGHBOURS = 3
# Rows of a task of the forest, which keeps some 500 bytes for each: how often every tree draws it.
FOREST_ROWS = 100_000


@dataclass
class FeatureModel:
    """The selected feature names; applies the same selection to other tables."""

    selected: list[str]

    def transform(self, df: DataFrame) -> DataFrame:
        validate_columns(df, self.selected)
        return df.select(*[as_column(c) for c in self.selected])


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Add ``<column>_index``: the position of the value among the sorted distinct values."""
    values = df.select(as_column(column)).distinct().filter(as_column(column).isNotNull())
    return lookup_join(df, dense_index(values, column, f"{column}_index"), [column])


def anova_f(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One-way F statistic per feature from class counts, means and variances."""
    names = validate_columns(df, features)
    classes = df.filter(as_column(target).isNotNull()).groupBy(as_column(target)).agg(
        *[
            agg(number(df, c)).alias(f"{k}{i}")
            for i, c in enumerate(names)
            for k, agg in (("n", F.count), ("m", F.avg), ("v", F.var_pop))
        ]
    )
    row = classes.agg(
        *[
            expr.alias(f"{k}{i}")
            for i in range(len(names))
            for k, expr in (
                ("g", F.count_if(F.col(f"n{i}") > 0)),
                ("n", F.sum(f"n{i}")),
                ("w", F.sum(F.col(f"n{i}") * F.col(f"v{i}"))),
                ("s", F.sum(F.col(f"n{i}") * F.col(f"m{i}"))),
                ("q", F.sum(F.col(f"n{i}") * F.col(f"m{i}") * F.col(f"m{i}"))),
            )
        ]
    )

    def score(i: int) -> Column:
        n, groups = F.col(f"n{i}").cast("double"), F.col(f"g{i}")
        between = F.col(f"q{i}") - F.col(f"s{i}") * F.col(f"s{i}") / n
        return F.try_divide(F.try_divide(between, groups - 1), F.try_divide(F.col(f"w{i}"), n - groups))

    return long_rows(row, [{"feature": F.lit(c), "importance": score(i)} for i, c in enumerate(names)])


def mutual_information(df: DataFrame, features: Sequence[str], target: str, k: int = NEIGHBOURS, bucket_rows: int | None = None) -> DataFrame:
    """Mutual information of each feature with the class by nearest neighbours (natural log), not below 0.

    Of a point in a class of N_y points, r is the distance to its k-th neighbour within the class (k at most N_y - 1) and m the number of points
    of all classes nearer than r, itself included; where r is 0, the points of the same value. The estimate is
    psi(N) + mean psi(k) - mean psi(N_y) - mean psi(m) over the points of classes of two or more. NULL features and classes are left out.

    Equal values of a class are counted first. Neighbours are looked up on sorted value ranges with k border rows of the ranges beside; the points
    within r are the difference of two ranks, found by sorting the interval ends among the values.
    """
    names = validate_columns(df, features)
    rows = df.filter(as_column(target).isNotNull()).select(as_column(target).alias("y"), *[number(df, c).cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"x{i}").alias("v")) for i in range(len(names))]))
    counts = rows.select("y", cells.alias("r")).select("y", "r.*").filter(F.col("v").isNotNull()).groupBy("f", "y", "v").agg(F.count("*").alias("n"))
    # The only pass over the rows; all that follows reads the counted values.
    counts = write_table(counts, "counted_values")
    sizes = counts.groupBy("f", "y").agg(F.sum("n").alias("ny")).filter("ny > 1")
    counts = write_table(lookup_join(counts, sizes, ["f", "y"], "inner").withColumn("k", F.least(F.lit(k), F.col("ny") - 1)), "class_values")
    bounds = range_bounds(counts, {f"x{i}": F.when(F.col("f") == i, F.col("v")) for i in range(len(names))}, bucket_rows)
    terms = None
    for i in range(len(names)):
        part = _within(counts.filter(F.col("f") == i), bounds[f"x{i}"], k)
        terms = part if terms is None else terms.unionByName(part)
    n = F.col("n")
    sums = terms.groupBy("f").agg(F.sum("n").alias("total"), F.sum(n * (digamma(F.col("k")) - digamma(F.col("ny")) - digamma(F.col("m")))).alias("s"))
    scored = sums.select("f", F.greatest(F.lit(0.0), digamma(F.col("total")) + F.col("s") / F.col("total")).alias("importance"))
    feature = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("f") + 1)
    return scored.select(feature.alias("feature"), "importance")


def _within(counts: DataFrame, bounds: list[float], k: int) -> DataFrame:
    """``f, n, ny, k, m`` of each value and class of one feature: the number of points within the distance to the k-th neighbour of the class."""
    placed = in_range(counts, F.col("v"), bounds, "_bucket")
    haloed = with_halo(placed, ["f", "y"], "v", k, k)
    line = Window.partitionBy("f", "y", "_bucket").orderBy("v")
    beside = [F.struct((F.abs(F.col("v") - step("v", i).over(line))).alias("d"), step("v", i).over(line).alias("to"), step("n", i).over(line).alias("n")) for i in range(1, k + 1) for step in (F.lag, F.lead)]
    near = F.filter(F.array(F.struct(F.lit(0.0).alias("d"), F.col("v").alias("to"), (F.col("n") - 1).alias("n")), *beside), lambda x: x.d.isNotNull())

    def reached(x: Column) -> Column:
        return F.aggregate("near", F.lit(0).cast("bigint"), lambda total, other: total + F.when(other.d <= x.d, other.n).otherwise(0)) >= F.col("k")

    last = F.array_min(F.transform(F.filter("near", reached), lambda x: F.struct(x.d.alias("d"), x.to.alias("to"))))
    own = haloed.withColumn("near", near).filter(~F.col("_halo")).withColumn("last", last)
    v, d, to = F.col("v"), F.col("last.d"), F.col("last.to")
    # The neighbour's own value is one end of the interval, so that rounding does not count it.
    own = own.select("f", "y", "v", "n", "ny", "k", F.when(to < v, to).otherwise(v - d).alias("low"), F.when(to > v, to).otherwise(v + d).alias("high"), (d == 0).alias("tied"))
    none = F.lit(None)
    ends = F.array(
        F.struct(F.col("low").alias("at"), F.when(F.col("tied"), 0).otherwise(2).alias("kind")), F.struct(F.col("high").alias("at"), F.when(F.col("tied"), 3).otherwise(1).alias("kind"))
    )
    # Values have kind 1.5 of their own: an end of kind 0 or 1 is ranked before equal values, one of kind 2 or 3 after them.
    asked = own.select("*", F.explode(ends).alias("e")).select("f", "y", "v", "n", "ny", "k", "e.at", F.col("e.kind").cast("double").alias("kind"), F.lit(0).cast("bigint").alias("here"))
    values = counts.groupBy("f", "v").agg(F.sum("n").alias("here"))
    values = values.select("f", none.cast(counts.schema["y"].dataType).alias("y"), none.cast("double").alias("v"), none.cast("bigint").alias("n"), none.cast("bigint").alias("ny"), none.cast("bigint").alias("k"), F.col("v").alias("at"), F.lit(1.5).alias("kind"), "here")
    merged = in_range(asked.unionByName(values), F.col("at"), bounds, "_bucket")
    sums = merged.groupBy("_bucket").agg(F.sum("here").alias("_n"))
    offsets = sums.select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    running = F.sum("here").over(Window.partitionBy("_bucket").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumn("rank", running).filter(F.col("n").isNotNull()).join(F.broadcast(offsets), "_bucket").withColumn("rank", F.col("rank") + F.col("_before"))
    m = F.max(F.when(F.col("kind").isin(1.0, 3.0), F.col("rank"))) - F.max(F.when(F.col("kind").isin(0.0, 2.0), F.col("rank")))
    return ranked.groupBy("f", "y", "v").agg(F.first("n").alias("n"), F.first("ny").alias("ny"), F.first("k").alias("k"), m.alias("m")).select("f", "n", "ny", "k", "m")


def forest_importance(df: DataFrame, features: Sequence[str], target: str, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Impurity importances of a random forest over the complete rows, dealt over tasks of at most about ``FOREST_ROWS`` rows."""
    names = validate_columns(df, features)
    labelled = label_encode(df.filter(as_column(target).isNotNull()), target)
    plain = labelled.select(F.col(f"{target}_index").cast("double").alias("label"), *[number(df, c).alias(f"x{i}") for i, c in enumerate(names)])
    vectors = VectorAssembler(inputCols=[f"x{i}" for i in range(len(names))], outputCol="features", handleInvalid="skip")
    rows = vectors.transform(plain).select("label", "features")
    parts = math.ceil(df.count() / FOREST_ROWS)
    model = RandomForestClassifier(numTrees=trees, seed=seed).fit(rows.repartition(parts) if parts > 1 else rows)
    scores = [(c, float(model.featureImportances[i])) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(scores, "feature string, importance double")


def sort_importance(scores: DataFrame) -> DataFrame:
    return scores.orderBy(F.col("importance").desc_nulls_last(), "feature")


def select_features(
    df: DataFrame, target: str, features: Sequence[str] | None = None, method: str = "kbest", n_features: int = 10
) -> tuple[DataFrame, FeatureModel]:
    """``feature, importance, selected`` in falling order, and the selection as a model.

    The first two methods keep the best ``n_features``; the forest also needs at least the mean importance.
    """
    validate_choice("method", method, METHODS)
    names = list(features) if features is not None else [c for c in numeric_columns(df) if c != target]
    score = {"kbest": anova_f, "mutual_info": mutual_information, "random_forest": forest_importance}[method]
    # One row per feature: the table's width, not its length.
    rows = [(r["feature"], r["importance"]) for r in sort_importance(score(df, names, target)).collect()]
    known = [s for _, s in rows if s is not None and not math.isnan(s)]
    floor = sum(known) / len(known) if method == "random_forest" and known else -math.inf
    chosen = [f for f, s in rows if s is not None and s >= floor][:n_features]
    report = df.sparkSession.createDataFrame(
        [(f, s, f in chosen) for f, s in rows], "feature string, importance double, selected boolean"
    )
    return report, FeatureModel([c for c in names if c in chosen])


def feature_transform(df: DataFrame, model: FeatureModel | None) -> DataFrame:
    if model is None:
        raise ValueError("no feature selection has been fitted yet")
    return model.transform(df)
