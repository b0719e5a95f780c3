"""Size-checked broadcast and salted joins.

A side is broadcast only after a bounded count proves it small; beyond the
bound the join falls back to a shuffle join whose hot keys are spread over
``salt`` sub-partitions, so no single key can land in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows a side may hold and still be broadcast (a few tens of MB for narrow rows).
DEFAULT_BROADCAST_ROWS = 2_000_000
DEFAULT_SALT = 16


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    """Bounded check: reads at most ``max_rows + 1`` rows, never the whole side."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = DEFAULT_BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    if has_at_most(df, max_rows):
        return F.broadcast(df), True
    return df, False


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    salt: int = DEFAULT_SALT,
    salt_source: Column | None = None,
) -> DataFrame:
    """Shuffle join with the big side spread over ``salt`` buckets per key.

    The big side gets a bucket from ``salt_source`` (default: hash of all its
    columns); the small side is repeated once per bucket. A key holding a
    third of all rows is then split over ``salt`` tasks instead of one.
    """
    src = salt_source if salt_source is not None else F.xxhash64(*[F.col(c) for c in big.columns])
    b = big.withColumn("_salt", F.pmod(src, F.lit(salt)).cast("int"))
    s = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return b.join(s, on + ["_salt"], how).drop("_salt")


def join_small_side(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = DEFAULT_BROADCAST_ROWS,
    salt: int = DEFAULT_SALT,
    salt_source: Column | None = None,
) -> DataFrame:
    """Broadcast ``small`` when its row count is proven under ``max_rows``; otherwise salted shuffle join."""
    s, ok = broadcast_if_small(small, max_rows)
    if ok:
        return big.join(s, on, how)
    return salted_join(big, small, on, how, salt, salt_source)
