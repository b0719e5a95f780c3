"""Connected components by alternating large-star and small-star rounds.

Each round is a map-side combinable minimum per node and a join back, in which
the edges of a hub are dealt over tasks. Every round is a table in the shared
checkpoint folder: a checkpoint would hand on the planner's estimate of its
size, which joins multiply in each round. Edges are never collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .spread import hot_keys, spread_join


#: edges that one task of a round handles; rounds on few edges take few tasks, whatever the cluster's shuffle partitions
EDGES_PER_TASK = 250_000


def rounds_folder(spark) -> str:
    """A new folder for the tables of an iteration."""
    return f"{ensure_checkpoint_dir(spark)}/rounds-{uuid.uuid4().hex}"


def write_round(df: DataFrame, folder: str, name: int | str) -> DataFrame:
    """``df`` as a table of ``folder``, read again: its lineage is cut and its size is known."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _with_least(edges: DataFrame, key: str, least: DataFrame, n_edges: int, per_task: int) -> DataFrame:
    """``edges`` joined with ``least`` (key, m, degree) on ``key``; only where a node can have more than ``per_task`` edges, hubs are looked for."""
    if n_edges <= per_task:
        return edges.join(least.drop("degree"), key)
    other = next(c for c in edges.columns if c != key)
    return spread_join(edges, least.drop("degree"), [key], hot_keys(least, [key], "degree", per_task), F.col(other))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) for every node of ``edges``; component is its smallest node. Loops and nulls are ignored."""
    folder = rounds_folder(edges.sparkSession)
    cur = write_round(edges.where(F.col(u) != F.col(v)).select(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")).distinct(), folder, "start")
    state = _state(cur)
    for i in range(max_rounds):
        if not state[0]:
            break
        tasks = -(-state[0] // edges_per_task)  # a round never has more edges than the one before
        cur = cur.coalesce(tasks)
        both = cur.select(F.col("a").alias("x"), F.col("b").alias("y")).union(cur.select("b", "a"))
        low = both.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("degree")).select("x", F.least("x", "m").alias("m"), "degree")
        large = (_with_least(both.where(F.col("y") > F.col("x")), "x", low, state[0], edges_per_task)
                 .select(F.col("m").alias("a"), F.col("y").alias("b")).where(F.col("a") < F.col("b")).coalesce(tasks))
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("degree"))
        small = (_with_least(large, "b", least, state[0], edges_per_task).where(F.col("a") != F.col("m")).select(F.col("m").alias("a"), F.col("a").alias("b")).coalesce(tasks)
                 .union(least.select("m", "b").coalesce(tasks)).distinct())
        cur = write_round(small.coalesce(tasks), folder, i)
        now = _state(cur)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {max_rounds} rounds")
    return cur.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        cur.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
