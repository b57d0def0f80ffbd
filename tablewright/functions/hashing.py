"""Hash-derived order and draws.

Everything random in the library is a function of the row's key and a seed, so a result does not
depend on how the rows are partitioned and any engine with md5 can recompute it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import as_column

SEED = 42


def row_hash(*keys: str | Column, seed: int | str = SEED) -> Column:
    """32 hex digits, uniform over the keys."""
    parts = [as_column(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hex_number(hashed: Column, start: int = 1, digits: int = 8) -> Column:
    """An unsigned number from ``digits`` hex digits of a hash."""
    return F.conv(F.substring(hashed, start, digits), 16, 10).cast("long")


def unit_draw(*keys: str | Column, seed: int | str = SEED) -> Column:
    """A uniform draw in (0, 1) per row; eight hex digits of the row's hash."""
    return (hex_number(row_hash(*keys, seed=seed)) + F.lit(0.5)) / F.lit(4294967296.0)


def normal_draw(*keys: str | Column, seed: int | str = SEED) -> Column:
    """A standard normal draw by the Box-Muller rule from two halves of one hash."""
    hashed = row_hash(*keys, seed=seed)
    first = (hex_number(hashed, 1) + F.lit(0.5)) / F.lit(4294967296.0)
    second = (hex_number(hashed, 9) + F.lit(0.5)) / F.lit(4294967296.0)
    return F.sqrt(F.lit(-2.0) * F.log(first)) * F.cos(F.lit(2.0) * F.pi() * second)
