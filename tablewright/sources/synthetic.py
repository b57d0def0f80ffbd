"""Derived columns for demos and tests. Every value is a function of the row's key and a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_column
from ..functions.hashing import SEED, normal_draw, unit_draw

# The words company names and domains are drawn from.
COMPANIES = ["Alpha", "Beta", "Gamma", "Delta", "Omega"]
DOMAINS = ["technology", "finance", "health", "education", "retail"]


def _pick(words: Sequence[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (F.floor(draw * len(words)) + 1).cast("int"))


def synth_rows(ids: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """One company per key: name, revenue in [1e6, 1e7), 50 to 1000 employees, founding date, domain."""

    def draw(name: str) -> Column:
        return unit_draw(key, seed=f"{name}|{seed}")

    number = (F.floor(draw("number") * 1000) + 1).cast("string")
    founded = F.date_add(F.lit("1990-01-01").cast("date"), F.floor(draw("founded") * 11000).cast("int"))
    return ids.select(
        as_column(key),
        F.concat(_pick(COMPANIES, draw("name")), F.lit("_"), number).alias("company_name"),
        (F.lit(1e6) + draw("revenue") * 9e6).alias("revenue"),
        (F.lit(50) + F.floor(draw("employees") * 951)).cast("int").alias("employees"),
        F.date_format(founded, "yyyy-MM-dd").alias("founded_date"),
        _pick(DOMAINS, draw("domain")).alias("domain"),
    )


def synth_distributions(ids: DataFrame, key: str, seed: int = SEED, outlier_share: float = 0.05) -> DataFrame:
    """Normal, lognormal, exponential and uniform columns, one with a share of cells times five, one of categories."""

    def draw(name: str) -> Column:
        return unit_draw(key, seed=f"{name}|{seed}")

    def normal(name: str) -> Column:
        return normal_draw(key, seed=f"{name}|{seed}")

    plain = 50 + 10 * normal("outlier")
    category = draw("category")
    return ids.select(
        as_column(key),
        (100 + 15 * normal("normal")).alias("normal_column"),
        F.exp(10 + 0.5 * normal("lognormal")).alias("lognormal_column"),
        (-2 * F.log(1 - draw("exponential"))).alias("exponential_column"),
        (100 * draw("uniform")).alias("uniform_column"),
        F.when(draw("where") < outlier_share, plain * 5).otherwise(plain).alias("outlier_column"),
        F.when(category < 0.4, "A").when(category < 0.7, "B").when(category < 0.9, "C").otherwise("D").alias("category_column"),
    )
