"""Exact quantiles with linear interpolation by narrowing, without sorting the column.

A quantile sketch brackets each wanted rank, one pass counts what lies below and between, and only
the values inside the brackets are grouped. A bracket that would still hold too many distinct values
is sketched again inside its bounds. The ranks are checked, so a sketch can only cost time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import number
from .ordering import SKETCH_K, sketch, sketch_quantiles

SETTLE_ROWS = 2_000_000
SLACK = 0.004


@dataclass
class _Target:
    column: str
    prob: float
    rank: float
    low: float
    high: float


def exact_quantiles(
    df: DataFrame, columns: list[str], probs: list[float], settle_rows: int = SETTLE_ROWS
) -> dict[str, dict[float, float | None]]:
    """``{column: {p: value}}``; a column without values gives None."""
    cols = {c: number(df, c) for c in columns}
    found: dict[str, dict[float, float | None]] = {c: {p: None for p in probs} for c in columns}
    sketched = sketch(df, cols)
    sizes = {c: n for c, (n, _) in sketched.items() if n}
    slack = SLACK
    targets = _bracket(df, sketched, sizes, probs, slack)
    while targets:
        wide = [t for t in targets if sizes[t.column] * 2.5 * slack > settle_rows]
        if wide:
            _narrow(df, cols, wide, slack)
        rows = _inside(df, cols, targets)
        missed = []
        for t in targets:
            lower, upper = rows.get((t.column, math.floor(t.rank))), rows.get((t.column, math.ceil(t.rank)))
            if lower is None or upper is None:
                missed.append(t)
            else:
                found[t.column][t.prob] = lower + (t.rank - math.floor(t.rank)) * (upper - lower)
        slack *= 4
        targets = _bracket(df, sketched, sizes, probs, slack, {(t.column, t.prob) for t in missed}) if missed else []
    return found


def _bracket(df, sketched, sizes, probs, slack, only=None) -> list[_Target]:
    asked = {c: [p for p in probs if only is None or (c, p) in only] for c in sizes}
    edges = {
        c: [q for p in ps for q in (max(0.0, p - slack), min(1.0, p + slack))] if sizes[c] > SKETCH_K else []
        for c, ps in asked.items()
    }
    values = sketch_quantiles(df, {c: sketched[c][1] for c in sizes}, edges)
    out = []
    for c, ps in asked.items():
        for i, p in enumerate(ps):
            low, high = (-math.inf, math.inf) if not edges[c] else values[c][2 * i : 2 * i + 2]
            # The sketch may miss the extremes, so brackets that touch them stay open.
            low = -math.inf if p - slack <= 0 else low
            high = math.inf if p + slack >= 1 else high
            out.append(_Target(c, p, (sizes[c] - 1) * p, low, high))
    return out


def _narrow(df: DataFrame, cols: dict[str, Column], targets: list[_Target], slack: float) -> None:
    """Sketch again inside the brackets and tighten them around the wanted ranks."""
    inside = {str(i): F.when(cols[t.column].between(t.low, t.high), cols[t.column]) for i, t in enumerate(targets)}
    below = df.agg(*[F.count_if(cols[t.column] < t.low).alias(f"b{i}") for i, t in enumerate(targets)]).first()
    sketched = sketch(df, inside)
    probs = {}
    for i, t in enumerate(targets):
        n = sketched[str(i)][0]
        centre = (t.rank - below[f"b{i}"]) / max(1, n - 1)
        probs[str(i)] = [min(1.0, max(0.0, centre - slack)), min(1.0, max(0.0, centre + slack))]
    values = sketch_quantiles(df, {k: s for k, (_, s) in sketched.items()}, probs)
    for i, t in enumerate(targets):
        (p_low, p_high), (low, high) = probs[str(i)], values[str(i)]
        t.low = max(t.low, low) if p_low > 0 else t.low
        t.high = min(t.high, high) if p_high < 1 else t.high


def _inside(df: DataFrame, cols: dict[str, Column], targets: list[_Target]) -> dict[tuple[str, int], float]:
    """The values at the targets' two neighbouring ranks, for ranks that fall inside their brackets."""
    by_column: dict[str, list[tuple[float, float]]] = {}
    for t in targets:
        by_column.setdefault(t.column, []).append((t.low, t.high))
    names = list(by_column)
    wide = df.select(*[cols[c].alias(f"v{k}") for k, c in enumerate(names)])
    cells = []
    for k, c in enumerate(names):
        merged: list[list[float]] = []
        for low, high in sorted(by_column[c]):
            if merged and low <= math.nextafter(merged[-1][1], math.inf):
                merged[-1][1] = max(merged[-1][1], high)
            else:
                merged.append([low, high])
        # Ranges alternate between gaps (even slots) and brackets (odd slots, both ends inside).
        edges = [e for low, high in merged for e in (low, math.nextafter(high, math.inf))]
        inner = [e for e in edges if math.isfinite(e)]
        slot = F.lit(1)
        if inner:
            cut = Bucketizer(
                splits=[-math.inf, *inner, math.inf], inputCol=f"v{k}", outputCol=f"s{k}", handleInvalid="keep"
            )
            wide = cut.transform(wide)
            slot = F.col(f"s{k}").cast("int") + (0 if math.isfinite(edges[0]) else 1)
        cells.append(F.struct(F.lit(k).alias("c"), slot.alias("slot"), F.col(f"v{k}").alias("v")))
    rows = wide.select(F.explode(F.array(*cells)).alias("r")).select("r.*").filter(F.col("v").isNotNull())
    value = F.when(F.col("slot") % 2 == 1, F.col("v"))
    counts = rows.groupBy("c", "slot", value.alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("c").orderBy("slot", "v").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("upto", upto).filter(F.col("v").isNotNull())
    ranks = {k: sorted({r for t in targets if t.column == c for r in (math.floor(t.rank), math.ceil(t.rank))}) for k, c in enumerate(names)}
    hits = F.lit(None).cast("array<bigint>")
    for k in ranks:
        wanted = F.array(*[F.lit(r).cast("bigint") for r in ranks[k]])
        hits = F.when(F.col("c") == k, wanted).otherwise(hits)
    picked = placed.withColumn(
        "hits", F.filter(hits, lambda r: (r >= F.col("upto") - F.col("n")) & (r < F.col("upto")))
    ).filter(F.size("hits") > 0)
    return {(names[row["c"]], r): row["v"] for row in picked.select("c", "v", "hits").collect() for r in row["hits"]}
