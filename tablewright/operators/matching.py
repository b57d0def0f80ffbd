"""Entity matching by equality and rules, and the joins around labelled pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column, common_columns, drop_rename, long_rows, validate_columns
from ..functions.text import label_to_text, serialize_pair, serialize_row
from ..session import write_table
from .joins import dealt_join, lookup_join
from .strings import fuzzy_match, ratio

METHODS = ["exact", "fuzzy", "tfidf"]


def exact_match(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Inner match on equal columns (all common ones by default); a NULL key equals a NULL key.

    Key columns appear once; other columns present on both sides get ``_1`` and ``_2``. Keys with many rows on both sides, NULL ones
    among them, are dealt over many tasks.
    """
    keys = common_columns(left, right, columns)
    shared = {c for c in left.columns if c in right.columns and c not in keys}
    a = left.select(*[as_column(c).alias(f"{c}_x") for c in left.columns])
    b = right.select(*[as_column(c).alias(f"{c}_y") for c in right.columns])
    out = [as_column(f"{c}_x").alias(f"{c}_1" if c in shared else c) for c in left.columns]
    out += [as_column(f"{c}_y").alias(f"{c}_2" if c in shared else c) for c in right.columns if c not in keys]
    return dealt_join(a, b, {f"{c}_x": f"{c}_y" for c in keys}, null_equal=True).select(*out)


def self_match(
    df: DataFrame, columns: list[str] | None = None, key: list[str] | None = None, drop_identity: bool = False
) -> DataFrame:
    """Match a table with itself, each row with itself included unless ``drop_identity`` (which needs the row key)."""
    matches = exact_match(df, df, columns)
    if not drop_identity:
        return matches
    twins = [c for c in validate_columns(df, key or []) if f"{c}_1" in matches.columns]
    if not twins:
        raise ValueError("drop_identity needs a row key outside the match columns")
    same = reduce(lambda x, y: x & y, [F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2")) for c in twins])
    return matches.filter(~same)


def match_summary(matches: DataFrame, columns: list[str]) -> DataFrame:
    """Number of matches, the match columns and the result's width."""
    return _summary(matches.agg(F.count("*").alias("matches")), columns, len(matches.columns))


def exact_match_summary(left: DataFrame, right: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """:func:`match_summary` of :func:`exact_match`, from the number of rows of each key on either side; no match is made."""
    keys = common_columns(left, right, columns)

    def counted(df: DataFrame, side: str) -> DataFrame:
        return df.groupBy(*[as_column(c).alias(f"{side}{i}") for i, c in enumerate(keys)]).agg(F.count("*").alias(f"{side}_n"))

    same = reduce(lambda x, y: x & y, [F.col(f"l{i}").eqNullSafe(F.col(f"r{i}")) for i in range(len(keys))])
    pairs = counted(left, "l").join(counted(right, "r"), same)
    matches = pairs.agg(F.coalesce(F.sum(F.col("l_n") * F.col("r_n")), F.lit(0)).alias("matches"))
    return _summary(matches, keys, len(left.columns) + len(right.columns) - len(keys))


def _summary(matches: DataFrame, columns: list[str], width: int) -> DataFrame:
    return matches.select("matches", F.lit(",".join(columns)).alias("match_columns"), F.lit(width).alias("n_columns"))


def rule_match(left: DataFrame, right: DataFrame, equal: list[str], within: dict[str, float] | None = None) -> DataFrame:
    """Match where the ``equal`` columns agree and each ``within`` column differs by at most its tolerance.

    The first tolerance column is cut into ranges one tolerance wide and each right row is offered to its
    own range and the two next to it, so the tolerance is part of the equi-join key.
    """
    within = within or {}
    validate_columns(left, [*equal, *within])
    validate_columns(right, [*equal, *within])
    a = left.select(*[as_column(c).alias(f"{c}_1") for c in left.columns])
    b = right.select(*[as_column(c).alias(f"{c}_2") for c in right.columns])
    on = {f"{c}_1": f"{c}_2" for c in equal}
    if within:
        name, width = next(iter(within.items()))
        step = width or 1.0
        a = a.withColumn("_cell", F.floor(F.col(f"{name}_1") / step))
        near = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col(f"{name}_2") / step) + d)
        b = b.withColumn("_near", F.explode(near))
        on["_cell"] = "_near"
    test = [F.abs(F.col(f"{c}_1") - F.col(f"{c}_2")) <= tol for c, tol in within.items()]
    return dealt_join(a, b, on).filter(reduce(lambda x, y: x & y, test, F.lit(True))).drop("_cell", "_near")


def hybrid_match(left: DataFrame, right: DataFrame, columns: list[str], threshold: float = 0.8) -> DataFrame:
    """Exact matches first; rows of either side left without one are matched approximately."""
    keys = common_columns(left, right, columns)

    def suffixed(df: DataFrame, n: int) -> DataFrame:
        return df.select(*[as_column(c).alias(f"{c}_{n}") for c in df.columns])

    def same(x: DataFrame, y: DataFrame) -> Column:
        return reduce(lambda p, q: p & q, [x[f"{c}_1"].eqNullSafe(y[f"{c}_2"]) for c in keys])

    a, b = suffixed(left, 1), suffixed(right, 2)
    exact = a.join(b, same(a, b)).withColumns({"similarity": F.lit(1.0), "method": F.lit("exact")})
    rest_a = a.join(b, same(a, b), "left_anti").select(*[F.col(f"{c}_1").alias(c) for c in left.columns])
    rest_b = b.join(a, same(a, b), "left_anti").select(*[F.col(f"{c}_2").alias(c) for c in right.columns])
    fuzzy = fuzzy_match(rest_a, rest_b, keys, threshold).withColumn("method", F.lit("fuzzy"))
    return exact.unionByName(fuzzy)


def three_way_match(
    first: DataFrame, second: DataFrame, third: DataFrame, columns: list[str], key: str, threshold: float = 0.8
) -> DataFrame:
    """``entity1, entity2, entity3, score``: rows of the first table matched in both others, scored by the mean."""
    need = [key, *columns]

    def pairs(other: DataFrame, n: int) -> DataFrame:
        found = fuzzy_match(first.select(*need), other.select(*need), columns, threshold)
        return found.select(F.col(f"{key}_1").alias("entity1"), F.col(f"{key}_2").alias(f"entity{n}"), F.col("similarity").alias(f"s{n}"))

    both = pairs(second, 2).join(pairs(third, 3), "entity1")
    return both.select("entity1", "entity2", "entity3", ((F.col("s2") + F.col("s3")) / 2).alias("score"))


def match_edges(matches: DataFrame, label: str, n: int = 10) -> DataFrame:
    """The ``n`` most similar matches as edges between the label column's two sides."""
    top = topk_matches(matches, [f"{label}_1", f"{label}_2"], n)
    return top.select(
        as_column(f"{label}_1").cast("string").alias("source"),
        as_column(f"{label}_2").cast("string").alias("target"),
        F.col("similarity").alias("weight"),
    )


def topk_matches(matches: DataFrame, ties: list[str], n: int = 10) -> DataFrame:
    return matches.orderBy(F.col("similarity").desc(), *ties).limit(n)


def column_similarity_matrix(matches: DataFrame, columns: list[str]) -> DataFrame:
    """Mean text similarity of every left column with every right column over all matches, in one pass.

    Text pairs are counted before they are compared, so each distinct pair is scored once.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("column_1"),
                    F.lit(b).alias("column_2"),
                    F.coalesce(as_column(f"{a}_1").cast("string"), F.lit("nan")).alias("a"),
                    F.coalesce(as_column(f"{b}_2").cast("string"), F.lit("nan")).alias("b"),
                )
                for a in columns
                for b in columns
            ]
        )
    )
    pairs = matches.select(cells.alias("r")).select("r.*").groupBy("column_1", "column_2", "a", "b").agg(F.count("*").alias("n"))
    scored = pairs.withColumn("s", ratio("a", "b"))
    return scored.groupBy("column_1", "column_2").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("similarity"))


def pair_join(
    pairs: DataFrame,
    table_a: DataFrame,
    table_b: DataFrame,
    drop: list[str] | None = None,
    rename: dict[str, str] | None = None,
    instruction: str | None = None,
    suffix: str = "",
    noun: str = "Product",
) -> DataFrame:
    """Labelled pairs ``(ltable_id, rtable_id, label)`` with both sides' columns, ``text`` and ``label_str``.

    Every column of a side gets ``_A`` or ``_B``; the tables have one row per ``id``. The pairs are written once, as their keys are
    counted before they are joined.
    """
    pairs = write_table(pairs, "pairs")
    sides, texts = [], []
    for table, mark, ref in ((table_a, "A", "ltable_id"), (table_b, "B", "rtable_id")):
        table = drop_rename(table, drop or [], rename)
        shown = [c for c in table.columns if c != "id"]
        sides.append(table.select(F.col("id").alias(ref), *[as_column(c).alias(f"{c}_{mark}") for c in shown]))
        texts.append(serialize_row({c: f"{c}_{mark}" for c in shown}))
    joined = lookup_join(pairs, sides[0], ["ltable_id"], "inner")
    joined = lookup_join(joined, sides[1], ["rtable_id"], "inner", counted=pairs)
    return joined.withColumns(
        {"text": serialize_pair(texts[0], texts[1], noun, suffix, instruction), "label_str": label_to_text("label")}
    )


def table_diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """Per column of either table: kept, new or removed, and for kept ones the number of changed cells."""
    validate_columns(before, key)
    validate_columns(after, key)
    kept = [c for c in before.columns if c in after.columns and c not in key]
    a = before.select(*key, *[as_column(c).alias(f"{c}_1") for c in kept], F.lit(1).alias("_a"))
    b = after.select(*key, *[as_column(c).alias(f"{c}_2") for c in kept], F.lit(1).alias("_b"))
    joined = a.join(b, key, "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    row = joined.agg(
        *[
            F.count_if(both & ~as_column(f"{c}_1").cast("string").eqNullSafe(as_column(f"{c}_2").cast("string"))).alias(f"d{i}")
            for i, c in enumerate(kept)
        ],
        F.count("_a").alias("n1"),
        F.count("_b").alias("n2"),
    )
    records = []
    for c in [*before.columns, *[c for c in after.columns if c not in before.columns]]:
        changed = F.col(f"d{kept.index(c)}") if c in kept else F.lit(None).cast("long")
        status = "key" if c in key else "kept" if c in kept else "removed" if c in before.columns else "new"
        records.append(
            {"column": F.lit(c), "status": F.lit(status), "changed_cells": changed, "rows_before": F.col("n1"), "rows_after": F.col("n2")}
        )
    return long_rows(row, records)
