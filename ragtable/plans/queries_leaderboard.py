"""Registered leaderboard queries (E-16..E-24).

Two retrieval configurations are evaluated over the whole tables (BM25 top-5
and exact kNN top-5 for every benchmark question against verbatim qrels);
their per-question metrics form the long results table the leaderboard ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import leaderboard as L
from ..operators import metrics as M
from ..session import cut_lineage, read_table
from .queries_metrics import metric_ctes_for
from .queries_retrieval import K, QRELS_CTE, bm25_hits, bm25_hits_ctes, qrels
from .queries_vectors import KNN_L2_CTES, knn_hits
from .registry import register

METRICS = [f"RET_RC_{K}", f"RET_PR_{K}", f"RET_F1_{K}", f"RET_AP_{K}", "RET_RR", "RET_DCG", "RET_NDCG"]
CONFIGS = [("bm25_k5", "hits"), ("knn_k5", "knn")]


def results_long(spark, sf_dir):
    """(config, query_id, metric, value): each config retrieves once and is measured once, and its measures are stacked."""
    qr = cut_lineage(qrels(spark, sf_dir))
    qs = read_table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id")
    names = dict(zip(METRICS, ("recall", "precision", "f1", "ap", "rr", "dcg", "ndcg"), strict=True))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value")) for m, c in names.items()])
    parts = []
    for name, hits in (("bm25_k5", bm25_hits(spark, sf_dir)), ("knn_k5", knn_hits(spark, sf_dir))):
        hits = cut_lineage(hits)
        both = M.metrics_at_k(hits, qr, qs, K).where(F.col("k") == K).join(M.ranking_metrics(hits, qr, qs, K), "query_id")
        parts.append(both.select(F.lit(name).alias("config"), "query_id", F.inline(pairs)))
    return cut_lineage(reduce(lambda a, b: a.unionByName(b), parts))


def _res_sql() -> str:
    sql = "WITH " + bm25_hits_ctes() + ",\n" + KNN_L2_CTES + "," + QRELS_CTE
    for name, hits in CONFIGS:
        sql += metric_ctes_for(K, hits, "qrels", name + "_")
    sel = []
    for name, _ in CONFIGS:
        for metric, col in ((f"RET_RC_{K}", "recall"), (f"RET_PR_{K}", '"precision"'), (f"RET_F1_{K}", "f1"),
                            (f"RET_AP_{K}", "ap")):
            sel.append(f"SELECT '{name}' AS config, query_id, '{metric}' AS metric, {col} AS value "
                       f"FROM {name}_at_k WHERE k = {K}")
        for metric, col in (("RET_RR", "rr"), ("RET_DCG", "dcg"), ("RET_NDCG", "ndcg")):
            sel.append(f"SELECT '{name}' AS config, query_id, '{metric}' AS metric, {col} AS value FROM {name}_ranking")
    return sql + ",\nres AS (" + "\nUNION ALL\n".join(sel) + ")"


RES = _res_sql()
MEANS_SQL = RES + """,
means AS (SELECT config, metric, round(avg(value), 6) AS mean FROM res WHERE NOT isnan(value) GROUP BY config, metric),
imp AS (SELECT config, metric, mean IS NULL AS imputed,
               round(coalesce(mean, avg(mean) OVER (PARTITION BY metric)), 6) AS value FROM means)"""


@register("leaderboard_results_wide", RES + "\nSELECT config, query_id, " + ", ".join(
    f"max(CASE WHEN metric = '{m}' THEN value END) AS {m}" for m in METRICS) + " FROM res GROUP BY config, query_id")
def q_wide(spark, sf_dir):
    return L.flatten_metrics(results_long(spark, sf_dir), METRICS)


#: the delta of config means: a stand-in for answers with and without context, as both configs have retrieval measures only
DELTA = "RET_RC_MINUS_PR"


@register("leaderboard_delta", MEANS_SQL + f"""
SELECT config, metric, mean FROM means
UNION ALL
SELECT a.config, '{DELTA}', round(a.mean - b.mean, 6) FROM means a JOIN means b USING (config) WHERE a.metric = 'RET_RC_{K}' AND b.metric = 'RET_PR_{K}'""")
def q_delta(spark, sf_dir):
    """E-17: means, and a metric that is the difference of two others."""
    return L.add_delta(L.config_means(results_long(spark, sf_dir)), f"RET_RC_{K}", f"RET_PR_{K}", DELTA)


@register("leaderboard_means", MEANS_SQL + "\nSELECT config, metric, mean FROM means")
def q_means(spark, sf_dir):
    return L.config_means(results_long(spark, sf_dir))


@register("leaderboard_imputed", MEANS_SQL + "\nSELECT config, metric, imputed, value FROM imp")
def q_imputed(spark, sf_dir):
    res = results_long(spark, sf_dir)
    return L.impute_mean(L.config_means(res), res.select("config"), METRICS)


@register("leaderboard_rank_mean", MEANS_SQL + """
SELECT config, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank
FROM (SELECT config, round(avg(value), 6) AS score FROM imp GROUP BY config)""")
def q_rank_mean(spark, sf_dir):
    res = results_long(spark, sf_dir)
    return L.rank_by_mean(L.impute_mean(L.config_means(res), res.select("config"), METRICS))


ZS = MEANS_SQL + """,
z AS (SELECT config, metric, imputed, value,
             round((value - avg(value) OVER (PARTITION BY metric)) / stddev_samp(value) OVER (PARTITION BY metric), 6) AS z
      FROM imp)"""


@register("leaderboard_zscores", ZS + """
SELECT config, metric, imputed, value, z, CASE WHEN imputed THEN NULL ELSE z END AS z_masked FROM z""")
def q_zscores(spark, sf_dir):
    res = results_long(spark, sf_dir)
    return L.zscores(L.impute_mean(L.config_means(res), res.select("config"), METRICS))


@register("leaderboard_rank_zscore", ZS + """
SELECT config, score, CAST(rank() OVER (ORDER BY score DESC) AS INTEGER) AS rank
FROM (SELECT config, round(sum(z), 6) AS score FROM z GROUP BY config)""")
def q_rank_z(spark, sf_dir):
    res = results_long(spark, sf_dir)
    return L.rank_by_zscore(L.impute_mean(L.config_means(res), res.select("config"), METRICS))


@register("metric_distribution", RES + """,
d AS (SELECT config, metric,
             list_transform(quantile_cont(value, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: round(x, 6)) AS quartiles,
             round(avg(value), 6) AS mean
      FROM res WHERE NOT isnan(value) GROUP BY config, metric)
SELECT config, metric, quartiles, mean, mean = max(mean) OVER (PARTITION BY metric) AS is_best FROM d""")
def q_distribution(spark, sf_dir):
    return L.metric_distribution(results_long(spark, sf_dir))


CONFIG_ROWS = [("bm25_k5", True, 5, None), ("knn_k5", True, 5, None), ("ensemble_bm25_knn", True, 5, [5, 10]),
               ("bm25_k10", False, 10, None)]


@register("pending_configs", RES + """,
cfg AS (SELECT * FROM (VALUES ('bm25_k5', true, 5, NULL::INTEGER[]), ('knn_k5', true, 5, NULL::INTEGER[]),
                              ('ensemble_bm25_knn', true, 5, [5, 10]), ('bm25_k10', false, 10, NULL::INTEGER[]))
        t(config, evaluate, k, member_ks))
SELECT config, coalesce(list_max(member_ks), k) AS max_k FROM cfg
WHERE evaluate AND config NOT IN (SELECT DISTINCT config FROM res)""")
def q_pending(spark, sf_dir):
    cfg = spark.createDataFrame(CONFIG_ROWS, "config string, evaluate boolean, k int, member_ks array<int>")
    pending = L.pending_configs(cfg, results_long(spark, sf_dir))
    return L.resolve_max_k(pending)
