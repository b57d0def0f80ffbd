"""Choosing labelled examples and writing them as text. ``text`` and ``label_str`` are fixed column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_column, validate_choice
from ..functions.hashing import SEED, row_hash
from ..functions.text import strip
from .sample import sample_data
from .vectors import similar_pairs


def filter_mispredicted(df: DataFrame, label: str = "label_str", pred: str = "preds") -> DataFrame:
    """Rows whose prediction differs from the label, ignoring case and outer white space."""
    return df.filter(F.lower(strip(label)) != F.lower(strip(pred)))


def random_examples(df: DataFrame, key: str, n: int = 10, seed: int = SEED) -> DataFrame:
    return sample_data(df, [key], max_samples=n, seed=seed)


def hard_samples(
    df: DataFrame, key: str, vector: str, n: int = 10, label: str = "label_str", pred: str = "preds", **sizes
) -> DataFrame:
    """The first ``n`` members (by key) of close pairs with different labels, one of them mispredicted.

    Close means one is among the other's ``n`` most similar later rows.
    """
    return distinct_members(hard_pairs(df, key, vector, n, label, pred, **sizes), df, key, n)


def hard_pairs(df: DataFrame, key: str, vector: str, n: int, label: str, pred: str, **sizes) -> DataFrame:
    wrong = F.lower(strip(label)) != F.lower(strip(pred))
    facts = df.select(as_column(key).alias("i"), as_column(label).alias("l1"), wrong.alias("w1"))
    pairs = similar_pairs(df, key, vector, n, **sizes).join(facts, "i")
    pairs = pairs.join(facts.withColumnsRenamed({"i": "j", "l1": "l2", "w1": "w2"}), "j")
    return pairs.filter((F.col("l1") != F.col("l2")) & (F.col("w1") | F.col("w2"))).select("i", "j")


def distinct_members(pairs: DataFrame, df: DataFrame, key: str, n: int) -> DataFrame:
    """The rows of ``df`` that occur in the pairs, each once, the first ``n`` by key."""
    members = pairs.select(F.explode(F.array("i", "j")).alias(key)).distinct().orderBy(key).limit(n)
    return df.join(members, key, "left_semi")


def balance_yes_no(samples: DataFrame, full: DataFrame, key: str, label: str = "label_str", seed: int = SEED) -> DataFrame:
    """If a few chosen examples lack Yes or No, replace the last one (by key) with one of that class."""
    said = F.lower(strip(label))
    has = samples.agg(F.max(said == "yes").alias("yes"), F.max(said == "no").alias("no"), F.max(key).alias("last")).first()
    lacking = "yes" if not has["yes"] else "no" if not has["no"] else None
    if lacking is None:
        return samples
    pick = full.filter(said == lacking).orderBy(row_hash(key, seed=seed), key).limit(1)
    kept = samples if has["last"] is None else samples.filter(F.col(key) != F.lit(has["last"]))
    return kept.unionByName(pick.select(*samples.columns))


def format_examples(examples: DataFrame, order_col: str, n: int, text: str = "text", label: str = "label_str") -> DataFrame:
    """One row: ``text label`` for the first ``n`` examples in the given order, blank lines between, a newline at the end.

    A prompt is for a chosen few; :func:`example_text` gives the lines of a whole table.
    """
    examples = examples.orderBy(order_col).limit(n)
    line = F.concat(strip(text), F.lit(" "), strip(label))
    lines = F.sort_array(F.collect_list(F.struct(as_column(order_col).alias("o"), line.alias("t"))))
    joined = F.array_join(F.transform(lines, lambda r: r["t"]), "\n\n")
    return examples.agg(F.concat(joined, F.lit("\n")).alias("prompt"))


def example_text(df: DataFrame, text: str = "text", label: str = "label_str") -> DataFrame:
    """One line per row; the row-wise part of :func:`format_examples`."""
    return df.withColumn("example", F.concat(strip(text), F.lit(" "), strip(label)))


def generate_prompt(
    df: DataFrame,
    key: str,
    method: str = "random",
    n: int = 10,
    task: str = "entity_matching",
    vector: str | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Example text by ``random`` choice, or by ``validation`` errors among close pairs when vectors are given."""
    validate_choice("method", method, ["random", "validation"])
    if method == "random" or vector is None:
        return format_examples(random_examples(df, key, n, seed), key, n)
    chosen = hard_samples(df, key, vector, n)
    if task in ("entity_matching", "error_detection"):
        chosen = balance_yes_no(chosen, df, key, seed=seed)
    return format_examples(chosen, key, n)
