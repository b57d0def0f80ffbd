"""Rule-based cleaning: date and pattern rules, functional dependencies, repairs with a log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import as_column, validate_columns
from ..functions.text import try_date
from ..session import cut_lineage
from .joins import lookup_join

# C-style date codes and their Spark date pattern letters.
DATE_CODES = {
    "%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%p": "a", "%P": "a",
}


@dataclass(frozen=True)
class Rule:
    """``Date`` and ``Pattern`` check one attribute against a format; ``AttrRelation`` lets source decide target."""

    name: str
    kind: str
    attr: str
    format: str = ""
    source: str = ""


def expand_rules(spec: dict[str, dict]) -> list[Rule]:
    """One rule per attribute, or per pair of source and target attribute."""
    rules = []
    for key, info in spec.items():
        name, kind = info.get("name", key), info["type"]
        if "attr" in info:
            rules += [Rule(name, kind, attr, info["format"]) for attr in info["attr"]]
        else:
            rules += [Rule(name, kind, target, source=source) for source in info["source"] for target in info["target"]]
    return rules


def rule_catalog(spark: SparkSession, spec: dict[str, dict], catalogue: dict[str, str]) -> DataFrame:
    """``name, category, params`` per rule; a type missing from the catalogue is unknown."""
    rows = []
    for key, info in spec.items():
        if "attr" in info:
            params = f"attr:{','.join(info['attr'])}\nformat:{info['format']}"
        else:
            params = f"source:{','.join(info['source'])}\ntarget:{','.join(info['target'])}"
        rows.append((f"{info['type']}_{key}", catalogue.get(info["type"], "unknown"), params))
    return spark.createDataFrame(rows, "name string, category string, params string")


def spark_date_pattern(fmt: str) -> str:
    for code, letters in DATE_CODES.items():
        fmt = fmt.replace(code, letters)
    return fmt


def violates_date(column: str, fmt: str) -> Column:
    value = F.upper(F.trim(as_column(column))) if "%P" in fmt or "%p" in fmt else F.trim(as_column(column))
    return as_column(column).isNotNull() & try_date(value, spark_date_pattern(fmt)).isNull()


def violates_pattern(column: str, pattern: str) -> Column:
    return as_column(column).isNotNull() & ~as_column(column).rlike(f"^(?:{pattern})$")


def clean_date(df: DataFrame, column: str, fmt: str) -> DataFrame:
    """Add ``violation``; violating values become NULL."""
    return _cleared(df, column, violates_date(column, fmt))


def clean_pattern(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Add ``violation``; values that do not match the whole pattern become NULL."""
    return _cleared(df, column, violates_pattern(column, pattern))


def _cleared(df: DataFrame, column: str, bad: Column) -> DataFrame:
    validate_columns(df, [column])
    flagged = df.withColumn("violation", bad)
    return flagged.withColumn(column, F.when(~F.col("violation"), as_column(column)))


def dependency_violations(df: DataFrame, source: str, target: str) -> DataFrame:
    """``source, fix, variants``: the source values with several targets and the commonest target (ties: smallest)."""
    validate_columns(df, [source, target])
    known = df.filter(as_column(source).isNotNull() & as_column(target).isNotNull())
    counts = known.groupBy(as_column(source).alias("source"), as_column(target).alias("target")).agg(F.count("*").alias("n"))
    return (
        counts.groupBy("source")
        .agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("target"))).alias("best"), F.count("*").alias("variants"))
        .filter(F.col("variants") > 1)
        .select("source", F.col("best.target").alias("fix"), "variants")
    )


def clean_fd(df: DataFrame, source: str, target: str) -> DataFrame:
    """Repair the target to the commonest one of its source value; adds ``violation``."""
    fixes = dependency_violations(df, source, target).select(F.col("source").alias(source), F.col("fix").alias("_fix"))
    joined = lookup_join(df, fixes, [source])
    bad = as_column(target).isNotNull() & F.col("_fix").isNotNull() & (as_column(target) != F.col("_fix"))
    flagged = joined.withColumn("violation", bad)
    fixed = F.when(F.col("violation"), F.col("_fix")).otherwise(as_column(target))
    return flagged.select(*[fixed.alias(c) if c == target else as_column(c) for c in df.columns], "violation")


def _apply(df: DataFrame, rule: Rule) -> DataFrame:
    """One rule on a tracked table; changed cells take the rule's name."""
    if rule.kind == "Date":
        done = clean_date(df, rule.attr, rule.format)
    elif rule.kind == "Pattern":
        done = clean_pattern(df, rule.attr, rule.format)
    elif rule.kind == "AttrRelation":
        done = clean_fd(df, rule.source, rule.attr)
    else:
        raise ValueError(f"unknown rule type {rule.kind!r}")
    by = as_column(f"_by_{rule.attr}")
    return done.withColumn(f"_by_{rule.attr}", F.when(F.col("violation"), F.lit(rule.name)).otherwise(by)).drop("violation")


def ordered_rules(rules: Sequence[Rule]) -> tuple[list[Rule], bool]:
    """Single-column rules first, then dependencies so that a source is repaired before it decides; True on a cycle."""
    singles = [r for r in rules if not r.source]
    relations = [r for r in rules if r.source]
    graph: dict[str, set[str]] = {}
    for r in relations:
        graph.setdefault(r.attr, set()).add(r.source)
    try:
        place = {a: i for i, a in enumerate(TopologicalSorter(graph).static_order())}
    except CycleError:
        return singles + relations, True
    return singles + sorted(relations, key=lambda r: place[r.attr]), False


def track(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add ``_old_<c>`` and ``_by_<c>`` for every column a rule can change."""
    columns = validate_columns(df, dict.fromkeys(r.attr for r in rules))
    return df.select(
        "*",
        *[as_column(c).alias(f"_old_{c}") for c in columns],
        *[F.lit(None).cast("string").alias(f"_by_{c}") for c in columns],
    )


def clean_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Apply all rules in dependency order to a tracked table.

    A dependency reads the table twice, so the table is written to the checkpoint folder after each. Rules that depend on
    each other in a circle run in rounds until none changes a cell. Rounds that come back to an earlier state of the
    table would go on for ever; they raise an error.
    """
    order, cyclic = ordered_rules(rules)
    out = track(df, order)
    if not cyclic:
        for rule in order:
            out = cut_lineage(_apply(out, rule)) if rule.source else _apply(out, rule)
        return out
    touched = list(dict.fromkeys(r.attr for r in order))
    seen = {_state(out)}
    while True:
        before = {c: f"_before_{c}" for c in touched}
        step = out.select("*", *[as_column(c).alias(b) for c, b in before.items()])
        for rule in order:
            step = cut_lineage(_apply(step, rule)) if rule.source else _apply(step, rule)
        step = cut_lineage(step)
        changed = step.agg(F.count_if(F.greatest(*[~as_column(c).eqNullSafe(as_column(b)) for c, b in before.items()], F.lit(False))))
        out = step.drop(*before.values())
        if changed.first()[0] == 0:
            return out
        state = _state(out)
        if state in seen:
            raise ValueError("the rules undo each other: no round leaves the table unchanged")
        seen.add(state)


def _state(df: DataFrame) -> tuple:
    """Two sums over the rows that tell states of the table apart."""
    plain = [c for c in df.columns if not c.startswith("_by_")]
    rows = F.struct(*[as_column(c) for c in plain])
    return tuple(df.agg(*[F.sum(F.xxhash64(rows, F.lit(k)).cast("decimal(20,0)")) for k in (1, 2)]).first())


def repaired_table(cleaned: DataFrame) -> DataFrame:
    return cleaned.select(*[as_column(c) for c in cleaned.columns if not c.startswith(("_old_", "_by_"))])


def repair_log(cleaned: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, column, old, new, cleaner`` per changed cell; cells of one row sit together, so nothing is joined."""
    columns = [c[len("_old_") :] for c in cleaned.columns if c.startswith("_old_")]
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                as_column(f"_old_{c}").cast("string").alias("old"),
                as_column(c).cast("string").alias("new"),
                as_column(f"_by_{c}").alias("cleaner"),
            )
            for c in columns
        ]
    )
    rows = cleaned.select(*[as_column(k) for k in key], F.explode(cells).alias("r")).select(*[as_column(k) for k in key], "r.*")
    return rows.filter(~F.col("old").eqNullSafe(F.col("new")))


def repair_provenance(log: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The log with the rule's type and the source attributes it used; rules are a short list."""
    facts: dict[tuple[str, str], tuple[str, list[str]]] = {}
    for r in rules:
        kind, sources = facts.setdefault((r.name, r.attr), (r.kind, []))
        sources.append(r.source or r.attr)
    rows = [(name, attr, kind, ",".join(sources)) for (name, attr), (kind, sources) in facts.items()]
    table = log.sparkSession.createDataFrame(rows, "cleaner string, column string, kind string, sources string")
    return log.join(F.broadcast(table), ["cleaner", "column"], "left").select(*log.columns, "kind", "sources")


def rule_groups(rules: Sequence[Rule]) -> dict[str, int]:
    """Group number per rule name: rules that share attributes, directly or through others, belong together."""
    attrs: dict[str, set[str]] = {}
    for r in rules:
        attrs.setdefault(r.name, set()).update(a for a in (r.attr, r.source) if a)
    group = {name: i for i, name in enumerate(attrs)}
    for a in attrs:
        for b in attrs:
            if attrs[a] & attrs[b] and group[a] != group[b]:
                low, high = sorted((group[a], group[b]))
                group = {n: low if g == high else g for n, g in group.items()}
    numbers = {g: i + 1 for i, g in enumerate(sorted(set(group.values())))}
    return {n: numbers[g] for n, g in group.items()}


def group_contribution(log: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``group, cleaner, repaired, weight``: each rule's share of its group's repaired cells."""
    groups = rule_groups(rules)
    names = log.sparkSession.createDataFrame([(g, n) for n, g in groups.items()], "group int, cleaner string")
    counts = log.groupBy("cleaner").agg(F.count("*").alias("repaired"))
    rows = names.join(F.broadcast(counts), "cleaner", "left").withColumn("repaired", F.coalesce("repaired", F.lit(0)))
    total = F.sum("repaired").over(Window.partitionBy("group"))
    return rows.select("group", "cleaner", "repaired", F.coalesce(F.try_divide("repaired", total), F.lit(0.0)).alias("weight"))


def rank_rules(contribution: DataFrame) -> DataFrame:
    """Rules of a group in falling order of weight, equal ones by name."""
    order = Window.partitionBy("group").orderBy(F.col("weight").desc(), "cleaner")
    return contribution.withColumn("rank", F.row_number().over(order))


def repair_quality(dirty: DataFrame, repaired: DataFrame, truth: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Precision (right changes / changes), recall (right changes / errors) and their F1 over the given columns."""
    sides = []
    for mark, table in (("d", dirty), ("r", repaired), ("t", truth)):
        validate_columns(table, [*key, *columns])
        sides.append(table.select(*key, *[as_column(c).cast("string").alias(f"{mark}_{c}") for c in columns]))
    joined = sides[0].join(sides[1], list(key)).join(sides[2], list(key))
    cells = F.explode(F.array(*[F.struct(F.col(f"d_{c}").alias("d"), F.col(f"r_{c}").alias("r"), F.col(f"t_{c}").alias("t")) for c in columns]))
    changed, right, error = (
        ~F.col("d").eqNullSafe(F.col("r")),
        F.col("r").eqNullSafe(F.col("t")),
        ~F.col("d").eqNullSafe(F.col("t")),
    )
    row = joined.select(cells.alias("c")).select("c.*").agg(
        F.count_if(error).alias("errors"), F.count_if(changed).alias("changed"), F.count_if(changed & right).alias("repaired")
    )
    precision = F.coalesce(F.try_divide("repaired", "changed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("repaired", "errors"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return row.select("errors", "changed", "repaired", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))
