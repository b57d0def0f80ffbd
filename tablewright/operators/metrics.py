"""Evaluation of predictions. F1 divides by at least 1, so it is below the harmonic mean when P + R < 1;
``f1_standard`` is the usual one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column, validate_choice
from ..functions.text import strip

EQUAL_TASKS = ["data_imputation", "entity_matching"]
PREFIX_TASKS = ["schema_matching", "error_detection_spelling"]
SUFFIX_TASKS = ["error_detection"]


def _floor_one(x: Column) -> Column:
    return F.greatest(F.lit(1.0), x.cast("double"))


def _scores(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    precision, recall = tp / _floor_one(tp + fp), tp / _floor_one(tp + fn)
    both = precision + recall
    return {
        "precision": precision,
        "recall": recall,
        "f1": 2 * precision * recall / _floor_one(both),
        "f1_standard": F.coalesce(F.try_divide(2 * precision * recall, both), F.lit(0.0)),
    }


def task_metrics(df: DataFrame, pred: str, gold: str, task: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of text answers; only the labels yes and no enter the last three."""
    validate_choice("task", task, EQUAL_TASKS + PREFIX_TASKS + SUFFIX_TASKS)
    label = F.lower(strip(gold))
    said = F.lower(strip(pred))
    if task in EQUAL_TASKS:
        right = said == label
    elif task in PREFIX_TASKS:
        right = said.startswith(label)
    else:
        right = F.element_at(F.split(said, "\n\n"), -1).endswith(label)
    rows = df.select(label.alias("l"), right.alias("r"))
    row = rows.agg(
        F.count("*").alias("total"),
        F.count_if("r").alias("correct"),
        F.count_if((F.col("l") == "yes") & F.col("r")).alias("tp"),
        F.count_if((F.col("l") == "yes") & ~F.col("r")).alias("fn"),
        F.count_if((F.col("l") == "no") & F.col("r")).alias("tn"),
        F.count_if((F.col("l") == "no") & ~F.col("r")).alias("fp"),
    )
    scores = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    accuracy = F.try_divide(F.col("correct").cast("double"), F.col("total"))
    return row.select(*[s.alias(k) for k, s in scores.items()], accuracy.alias("accuracy"), "total", "tp", "tn", "fp", "fn")


def binary_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy on the labels as given; the rest on the labels as booleans (anything but 0 is true)."""
    y, p = as_column(gold).cast("boolean"), as_column(pred).cast("boolean")
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(as_column(gold).eqNullSafe(as_column(pred))).alias("same"),
        F.count_if(y & p).alias("true_positives"),
        F.count_if(~y & p).alias("false_positives"),
        F.count_if(~y & ~p).alias("true_negatives"),
        F.count_if(y & ~p).alias("false_negatives"),
    )
    scores = _scores(F.col("true_positives"), F.col("false_positives"), F.col("false_negatives"))
    return row.select(
        F.try_divide(F.col("same").cast("double"), F.col("n")).alias("accuracy"),
        *[s.alias(k) for k, s in scores.items()],
        "true_positives", "false_positives", "true_negatives", "false_negatives",
    )


def confusion(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """``true_class, pred_class, n`` for the combinations that occur; one small row each."""
    return df.groupBy(as_column(gold).alias("true_class"), as_column(pred).alias("pred_class")).agg(F.count("*").alias("n"))


def class_union(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """The distinct classes of both columns."""
    cells = confusion(df, gold, pred)
    return cells.select(F.col("true_class").alias("class")).unionByName(cells.select(F.col("pred_class").alias("class"))).distinct()


def class_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Precision, recall and F1 per class."""
    cells = confusion(df, gold, pred)
    sides = cells.select(
        F.explode(
            F.array(
                F.struct(F.col("true_class").alias("class"), F.lit(True).alias("truth"), "n", (F.col("true_class") == F.col("pred_class")).alias("hit")),
                F.struct(F.col("pred_class").alias("class"), F.lit(False).alias("truth"), "n", (F.col("true_class") == F.col("pred_class")).alias("hit")),
            )
        ).alias("r")
    ).select("r.*")
    row = sides.groupBy("class").agg(
        F.sum(F.when(F.col("truth") & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(~F.col("truth") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("truth") & ~F.col("hit"), F.col("n")).otherwise(0)).alias("fn"),
    )
    scores = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return row.select("class", "tp", "fp", "fn", *[s.alias(k) for k, s in scores.items()])


def multiclass_metrics(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Accuracy and the unweighted means of the class scores."""
    return class_metrics(df, gold, pred).agg(
        # Every row counts once under its true class, so the hits over all classes give the accuracy.
        F.try_divide(F.sum("tp").cast("double"), F.sum(F.col("tp") + F.col("fn"))).alias("accuracy"),
        F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"),
        F.count("*").alias("n_classes"),
    )


def error_examples(df: DataFrame, gold: str, pred: str) -> DataFrame:
    return df.filter(as_column(gold) != as_column(pred))


def error_analysis(df: DataFrame, gold: str, pred: str) -> DataFrame:
    """Errors per kind ``true->pred`` with their total and their rate over all rows."""
    cells = confusion(df, gold, pred)
    wrong = F.col("true_class") != F.col("pred_class")
    errors, rows = cells.agg(F.sum(F.when(wrong, F.col("n")).otherwise(0)), F.sum("n")).first()
    kind = F.concat(F.col("true_class").cast("string"), F.lit("->"), F.col("pred_class").cast("string"))
    return cells.filter(wrong).select(
        kind.alias("error_type"),
        F.col("n").alias("count"),
        F.lit(errors).cast("bigint").alias("total_errors"),
        F.lit((errors or 0) / (rows or 1)).alias("error_rate"),
    )
