"""Connected components of links by alternating star contraction, with every round written to the shared folder.

Each round is two grouped minima and two joins on pairs of numbers. A node with very many links is summed where its rows are
read, and its join is split by adaptive execution. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import write_table


def components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) of longs. Gives (node, root) for every linked node, root being the smallest node it reaches."""
    u, v = F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    edges, seen = write_table(links.where("a <> b").select(u, v).distinct(), "links"), None
    while True:
        total = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if total[0] == 0 or total == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        seen = total
        edges = write_table(_small_star(_large_star(edges)).distinct(), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the least node around it."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).union(edges.select("v", "u"))
    least = both.groupBy("n").agg(F.min("o").alias("least")).select(F.col("n").alias("of"), F.least("n", "least").alias("least"))
    joined = both.where("o > n").join(least, F.col("n") == F.col("of"))
    return joined.select(F.col("o").alias("u"), F.col("least").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumnRenamed("u", "of")
    joined = edges.join(least, F.col("u") == F.col("of")).where("v <> least")
    return joined.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.select("of", "least"))
