"""Per-configuration leaderboard over a long results table (E-16..E-24).

``results(config, query_id, metric, value)``: one row per question and metric
(list-valued metrics are already one metric name per cut-off, e.g. RET_RC_5).
Every step is a grouped aggregate or a window partitioned by *metric* over the
(small) config x metric matrix; the per-question table is only aggregated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def flatten_metrics(results: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """E-16: long -> wide, one column per metric (explicit value list: no extra pass to find them)."""
    return results.groupBy("config", "query_id").pivot("metric", list(metrics)).agg(F.first("value"))


def config_means(results: DataFrame) -> DataFrame:
    """E-17: (config, metric, mean) skipping NaN like a pandas mean."""
    v = results.filter(~F.isnan("value") & F.col("value").isNotNull())
    return v.groupBy("config", "metric").agg(F.round(F.avg("value"), 6).alias("mean"))


def add_delta(means: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """E-17 delta: a per-config metric ``name`` = mean(a) - mean(b) (e.g. RAG minus no-RAG)."""
    p = means.groupBy("config").agg(
        (F.max(F.when(F.col("metric") == a, F.col("mean"))) - F.max(F.when(F.col("metric") == b, F.col("mean"))))
        .alias("mean")).filter(F.col("mean").isNotNull())
    return means.unionByName(p.select("config", F.lit(name).alias("metric"), F.round("mean", 6).alias("mean")))


def impute_mean(means: DataFrame, configs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """E-18: full config x metric grid; a missing mean becomes that metric's mean over configs."""
    grid = configs.select("config").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    g = grid.join(means, ["config", "metric"], "left")
    w = Window.partitionBy("metric")
    return g.select("config", "metric", F.col("mean").isNull().alias("imputed"),
                    F.round(F.coalesce(F.col("mean"), F.avg("mean").over(w)), 6).alias("value"))


def rank_by_mean(imputed: DataFrame) -> DataFrame:
    """E-19: (config, score, rank) by the unweighted mean of the selected metrics."""
    s = imputed.groupBy("config").agg(F.round(F.avg("value"), 6).alias("score"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())))


def zscores(imputed: DataFrame) -> DataFrame:
    """E-20/E-21: per-metric z-score (sample std); ``z_masked`` hides values that were imputed.

    A metric in which all configs are equal has no spread: its z-scores are NaN, as 0/0 is in the SQL
    and in pandas, where ANSI mode has division by zero end the query.
    """
    w = Window.partitionBy("metric")
    spread = F.stddev_samp("value").over(w)
    z = F.when(spread == 0, F.lit(float("nan"))).otherwise((F.col("value") - F.avg("value").over(w)) / spread)
    return imputed.withColumn("z", F.round(z, 6)).withColumn(
        "z_masked", F.when(F.col("imputed"), F.lit(None)).otherwise(F.col("z")))


def rank_by_zscore(imputed: DataFrame) -> DataFrame:
    """E-20: (config, score, rank) by the sum of per-metric z-scores; a NaN among them makes the sum NaN, which ranks highest, as in the SQL."""
    s = zscores(imputed).groupBy("config").agg(F.round(F.sum("z"), 6).alias("score"))
    return s.withColumn("rank", F.rank().over(Window.orderBy(F.col("score").desc())))


def metric_distribution(results: DataFrame) -> DataFrame:
    """E-22: per (config, metric): quartiles (exact, linear), mean and whether it is the best mean."""
    v = results.filter(~F.isnan("value") & F.col("value").isNotNull())
    d = v.groupBy("config", "metric").agg(
        F.transform(F.percentile("value", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])),
                    lambda x: F.round(x, 6)).alias("quartiles"),
        F.round(F.avg("value"), 6).alias("mean"))
    return d.withColumn("is_best", F.col("mean") == F.max("mean").over(Window.partitionBy("metric")))


def pending_configs(configs: DataFrame, results: DataFrame) -> DataFrame:
    """E-23: configs flagged ``evaluate`` that have no results yet."""
    done = results.select("config").distinct()
    return configs.filter(F.col("evaluate")).join(done, "config", "left_anti")


def resolve_max_k(configs: DataFrame) -> DataFrame:
    """E-24: max k over ensemble members, else the config's own k."""
    return configs.select("config", F.coalesce(F.array_max("member_ks"), F.col("k")).alias("max_k"))
