"""Least-squares split of single columns into three clusters, and how well the clusters stand apart.

In one dimension clusters are ranges of sorted values, so a split is two cuts. The best pair of cuts is searched over
blocks of distinct values: block sums bound what any cut inside the blocks can reach, pairs of blocks that cannot hold
the best cuts are dropped, and only the blocks that are left are summed again in finer pieces, down to single values.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import numeric_columns, validate_columns
from ..session import cut_lineage
from .joins import bounded
from .ordering import MAX_BUCKETS, sorted_counts

FEWEST = 10  # values; fewer have no tendency
CELLS = 1 << 20  # pairs of blocks looked at in a round
SLACK = 1e-9  # share of all squared error, or of the range, within which two are equal


def prefix_sums(df: DataFrame, columns: list[str], bucket_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Each distinct finite value with its position and the sums up to it; and one row of totals per column.

    ``column, x, n, i, count, total``: ``x`` is the value less the column's mean, ``i`` its position among the distinct
    values from 0, ``count`` and ``total`` the number and sum of all ``x`` up to it, copies included.
    """
    ranked = sorted_counts(df, columns, bucket_rows).filter(F.abs("value") < float("inf"))
    ranked = cut_lineage(ranked.select("column", "_bucket", "value", "n"))
    totals = ranked.groupBy("column").agg(
        F.sum("n").alias("rows"), F.count("*").alias("distinct"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean")
    )
    centred = ranked.join(F.broadcast(totals.select("column", "mean")), "column").withColumn("x", F.col("value") - F.col("mean"))
    sums = {"i": F.lit(1), "count": F.col("n"), "total": F.col("x") * F.col("n")}
    upto = Window.partitionBy("column", "_bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    inside = centred.select("column", "_bucket", "x", "n", *[F.sum(s).over(upto).alias(k) for k, s in sums.items()])
    # One row a bucket: what the buckets before it hold.
    per_bucket = centred.groupBy("column", "_bucket").agg(*[F.sum(s).alias(f"_{k}") for k, s in sums.items()])
    earlier = Window.partitionBy("column").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("column", "_bucket", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    placed = inside.join(bounded(before, MAX_BUCKETS * max(1, len(columns))), ["column", "_bucket"])
    shifted = {k: F.col(k) + F.col(f"_{k}") for k in sums} | {"i": F.col("i") + F.col("_i") - 1}
    return cut_lineage(placed.select("column", "x", "n", *[c.alias(k) for k, c in shifted.items()])), totals


@dataclass
class _Search:
    """Where the best cuts of one column may lie: pairs of blocks of ``size`` distinct values.

    ``blocks`` holds per block in sorted order: first position, rows, sum, sum of squares, least and largest value. A pair
    ``(first[k], second[k])`` names the first positions of the blocks that hold the last value of cluster 1 and of cluster 2.
    """

    distinct: int
    size: int
    blocks: np.ndarray = field(default_factory=lambda: np.empty((0, 6)))
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))
    second: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int64))

    def open_blocks(self) -> np.ndarray:
        return np.unique(np.concatenate([self.first, self.second]))

    def finer(self, cells: int) -> int:
        """Size of the next blocks: a power of two, so that the pairs of pieces stay near ``cells``, at least halved."""
        pieces = 2
        while pieces < self.size and len(self.first) * (2 * pieces) ** 2 <= cells:
            pieces *= 2
        return max(1, self.size // pieces)

    def refine(self, size: int, pieces: np.ndarray) -> None:
        """Replace the open blocks by their pieces and keep the pairs of pieces that may hold the best cuts."""
        closed = self.blocks[~np.isin(self.blocks[:, 0].astype(np.int64), self.open_blocks())]
        blocks = np.concatenate([closed, pieces])
        self.blocks = blocks[np.argsort(blocks[:, 0])]
        starts = self.blocks[:, 0].astype(np.int64)
        steps = np.arange(0, self.size, size)
        a = np.repeat(self.first, len(steps) ** 2) + np.tile(np.repeat(steps, len(steps)), len(self.first))
        b = np.repeat(self.second, len(steps) ** 2) + np.tile(steps, len(self.first) * len(steps))
        known = (a <= b) & (b < self.distinct)
        a, b, self.size = a[known], b[known], size
        in_order = np.lexsort((b, a))
        left, right = np.searchsorted(starts, a[in_order]), np.searchsorted(starts, b[in_order])
        keep = self._may_be_best(left, right)
        self.first, self.second = starts[left[keep]], starts[right[keep]]

    def _error(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Squared error of the blocks ``low`` to ``high - 1`` around their mean."""
        n, s, q = (p[high] - p[low] for p in self._sums())
        return np.where(n > 0, np.maximum(q - s * s / np.maximum(n, 1), 0), 0.0)

    def _sums(self) -> list[np.ndarray]:
        return [np.concatenate([[0.0], np.cumsum(self.blocks[:, k])]) for k in (1, 2, 3)]

    def _mean(self, low: np.ndarray, high: np.ndarray, empty: np.ndarray) -> np.ndarray:
        n, s, _ = (p[high] - p[low] for p in self._sums())
        return np.where(n > 0, s / np.maximum(n, 1), empty)

    def _may_be_best(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Two tests that the best cuts pass: the error is not above a known one, and each value is nearest to its own mean.

        A cluster's mean grows with both of its ends, so the ends of the blocks bound it.
        """
        last = len(self.blocks)
        zero, end = np.zeros_like(i), np.full_like(i, last)
        least, largest = self.blocks[:, 4], self.blocks[:, 5]
        following = np.append(least[1:], largest[-1])  # least value that may come after a cut inside the block
        first = self._mean(zero, i, least[i]), self._mean(zero, i + 1, largest[i])
        second = self._mean(i, j, least[i]), self._mean(i + 1, j + 1, largest[j])
        third = self._mean(j, end, least[j]), self._mean(j + 1, end, largest[j])
        slack = SLACK * max(abs(least[0]), abs(largest[-1]))
        near = (least[i] <= (first[1] + second[1]) / 2 + slack) & ((first[0] + second[0]) / 2 - slack <= following[i])
        near &= (least[j] <= (second[1] + third[1]) / 2 + slack) & ((second[0] + third[0]) / 2 - slack <= following[j])
        bound = self._error(zero, i) + self._error(np.minimum(i + 1, j), j) + self._error(j + 1, end)
        proper = (i < j) & (j < last - 1)
        reached = np.where(proper, self._error(zero, i + 1) + self._error(i + 1, j + 1) + self._error(j + 1, end), np.inf)
        best = reached.min(initial=np.inf)
        whole = self._error(np.zeros(1, dtype=np.int64), np.full(1, last))[0]
        if self.size == 1:
            return np.arange(len(i)) == np.argmax(reached <= best + SLACK * whole)
        return near & (bound <= best + SLACK * whole)


def best_cuts(values: DataFrame, distinct: dict[str, int], cells: int = CELLS) -> dict[str, tuple[int, int]]:
    """Positions of the last values of cluster 1 and cluster 2 per column, by least squared error.

    Of pairs within ``SLACK`` of the least the first is taken. ``values`` are those of :func:`prefix_sums`, three distinct ones a column at least. All columns share a pass over the
    values each round, and a round cuts the blocks that are left into hundreds of pieces. The driver holds block sums and
    pairs of blocks, about ``cells`` of them: as the tests leave few pairs, more rows do not make more of them.
    """
    spark = values.sparkSession
    searches = {c: _Search(n, 1 << (n - 1).bit_length()) for c, n in distinct.items()}
    while left := {c: s for c, s in searches.items() if s.size > 1}:
        sizes = {c: s.finer(cells) for c, s in left.items()}
        wanted = [(c, int(p) // s.size, sizes[c]) for c, s in left.items() for p in s.open_blocks()]
        coarse = spark.createDataFrame([(c, s.size) for c, s in left.items()], "column string, coarse bigint")
        blocks = spark.createDataFrame(wanted, "column string, part bigint, size bigint")
        held = values.join(F.broadcast(coarse), "column").withColumn("part", F.expr("i div coarse"))
        held = held.join(F.broadcast(blocks), ["column", "part"])
        x, n = F.col("x"), F.col("n")
        summed = held.groupBy("column", F.expr("(i div size) * size").alias("start")).agg(
            F.sum("n").alias("n"), F.sum(x * n).alias("s"), F.sum(x * x * n).alias("q"), F.min("x").alias("low"), F.max("x").alias("high")
        )
        found = summed.toPandas()
        for c, s in left.items():
            s.refine(sizes[c], found.loc[found["column"] == c, ["start", "n", "s", "q", "low", "high"]].to_numpy(dtype=float))
    return {c: (int(s.first[0]), int(s.second[0])) for c, s in searches.items()}


def _silhouette(x: Column, n: Column) -> Column:
    """Silhouette of a value from the sums of its own cluster and the means of the others (NULL: no such cluster)."""
    own, upto_n, upto_s = F.col("own_n"), F.col("count") - F.col("count_before"), F.col("total") - F.col("total_before")
    apart = (x * upto_n - upto_s) + ((F.col("own_s") - upto_s) - x * (own - upto_n))
    inside = apart / (own - 1)
    other = F.least(F.abs(x - F.col("mean_left")), F.abs(x - F.col("mean_right")))
    return F.when(own > 1, F.coalesce(F.try_divide(other - inside, F.greatest(other, inside)), F.lit(0.0))).otherwise(0.0) * n


def cluster_tendency(
    df: DataFrame, columns: list[str] | None = None, k: int = 3, bucket_rows: int | None = None, cells: int = CELLS
) -> DataFrame:
    """Mean silhouette (absolute distances) of the split of each column into three clusters of least squared error.

    Not below 0. Missing and infinite values take no part; fewer than ten values, or a single one, give 0, and two
    different values are two clusters. A value that is a cluster of its own counts 0. ``k`` can only be 3.
    """
    if k != 3:
        raise ValueError("columns are split into 3 clusters")
    names = validate_columns(df, columns or numeric_columns(df))
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "column string, cluster_tendency double")
    values, totals = prefix_sums(df, names, bucket_rows)
    distinct = {r["column"]: r["distinct"] for r in totals.collect() if r["rows"] >= FEWEST and r["distinct"] > 1}
    cuts = best_cuts(values, {c: n for c, n in distinct.items() if n > 2}, cells)
    cuts |= {c: (0, 1) for c, n in distinct.items() if n == 2}
    bounds = [(c, a, b) for c, (a, b) in cuts.items()]
    limits = F.broadcast(spark.createDataFrame(bounds, "column string, a bigint, b bigint"))
    placed = values.join(limits, "column").withColumn("cluster", F.when(F.col("i") <= F.col("a"), 1).when(F.col("i") <= F.col("b"), 2).otherwise(3))
    # One row a cluster: three a column.
    clusters = placed.groupBy("column", "cluster").agg(F.sum("n").alias("own_n"), F.sum(F.col("x") * F.col("n")).alias("own_s"))
    line = Window.partitionBy("column").orderBy("cluster")
    mean = F.col("own_s") / F.col("own_n")
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    facts = clusters.select(
        "*",
        F.lag(mean).over(line).alias("mean_left"),
        F.lead(mean).over(line).alias("mean_right"),
        F.coalesce(F.sum("own_n").over(upto), F.lit(0)).alias("count_before"),
        F.coalesce(F.sum("own_s").over(upto), F.lit(0.0)).alias("total_before"),
    )
    scored = placed.join(F.broadcast(facts), ["column", "cluster"])
    scores = scored.groupBy("column").agg((F.sum(_silhouette(F.col("x"), F.col("n"))) / F.sum("n")).alias("score"))
    listed = spark.createDataFrame([(c,) for c in names], "column string")
    score = F.greatest(F.coalesce("score", F.lit(0.0)), F.lit(0.0)).alias("cluster_tendency")
    return listed.join(F.broadcast(scores), "column", "left").select("column", score)
