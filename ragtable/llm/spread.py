"""Joins whose hot keys are dealt over many tasks.

A key of more than ``ROWS_PER_TASK`` rows gets parts; its rows are dealt over
them and its one row of the other side is repeated for each. Of n rows at most
``n / ROWS_PER_TASK`` keys can be hot, which bounds the list that is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_PER_TASK = 1_000_000


def hot_keys(counts: DataFrame, keys: list[str], rows: str, per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys, parts) of the keys of ``counts`` that have more than ``per_task`` rows."""
    return cut_lineage(counts.where(F.col(rows) > per_task).select(*keys, F.ceil(F.col(rows) / F.lit(per_task)).cast("int").alias("_parts")))


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, deal: Column, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table`` (at most one row a key) on ``keys``; rows of ``hot`` keys are dealt by the hash of ``deal``."""
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(deal), parts).cast("int")).drop("_parts")
    each = table.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"], how).drop("_part")
