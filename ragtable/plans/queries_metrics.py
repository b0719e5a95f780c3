"""Registered retrieval-metric queries (E-01..E-09) on BM25 top-5 hits vs verbatim qrels."""

from __future__ import annotations

from ..operators import metrics
from ..session import cut_lineage, read_table
from .queries_retrieval import K, QRELS_CTE, bm25_hits, bm25_hits_ctes, qrels
from .registry import register


def metric_ctes(max_k: int) -> str:
    """Expects CTEs ``hits`` and ``qrels`` and the view ``benchmark`` (question ids)."""
    return f""",
rel AS (SELECT DISTINCT query_id, chunk_id, 1 AS r FROM qrels),
h AS (
  SELECT hits.query_id, hits.rank, hits.chunk_id, coalesce(rel.r, 0) AS is_rel
  FROM hits LEFT JOIN rel USING (query_id, chunk_id)
),
h2 AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) = 1
                 THEN is_rel ELSE 0 END AS new_rel
  FROM h
),
h3 AS (
  SELECT *, sum(new_rel) OVER (PARTITION BY query_id ORDER BY rank
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_rel
  FROM h2
),
perq AS (SELECT query_id, count(*) AS n_hits, sum(new_rel) AS tot_rel FROM h3 GROUP BY query_id),
refs AS (SELECT query_id, count(*) AS n_refs, count(DISTINCT chunk_id) AS n_refs_distinct
         FROM qrels GROUP BY query_id),
qids AS (SELECT DISTINCT item_id AS query_id FROM benchmark),
grid AS (SELECT query_id, CAST(unnest(range(1, {max_k} + 1)) AS INTEGER) AS k FROM qids),
g AS (
  SELECT grid.query_id, grid.k,
         coalesce(perq.n_hits, 0) AS n_hits, coalesce(refs.n_refs, 0) AS n_refs,
         coalesce(h3.cum_rel, perq.tot_rel, 0) AS cum, coalesce(h3.is_rel, 0) AS hit
  FROM grid
  LEFT JOIN h3 ON h3.query_id = grid.query_id AND h3.rank = grid.k
  LEFT JOIN perq ON perq.query_id = grid.query_id
  LEFT JOIN refs ON refs.query_id = grid.query_id
),
mt AS (
  SELECT query_id, k, n_refs, hit,
         CASE WHEN n_refs = 0 THEN 0.0 ELSE cum / n_refs END AS rc,
         CASE WHEN n_hits = 0 THEN 0.0 ELSE cum / least(k, n_hits) END AS pr
  FROM g
),
at_k AS (
  SELECT query_id, k, round(rc, 6) AS recall, round(pr, 6) AS "precision",
         round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1,
         round(CASE WHEN n_refs = 0 THEN 0.0
                    ELSE sum(pr * hit) OVER (PARTITION BY query_id ORDER BY k
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / n_refs END, 6) AS ap
  FROM mt
),
hq AS (SELECT h2.*, coalesce(refs.n_refs, 0) AS n_refs FROM h2 LEFT JOIN refs USING (query_id)),
pq AS (
  SELECT query_id,
         min(CASE WHEN is_rel = 1 THEN rank END) AS first_rel,
         sum(CASE WHEN rank <= {max_k} THEN is_rel ELSE 0 END) AS cg,
         sum(CASE WHEN rank <= {max_k} THEN is_rel / log2(rank + 1) ELSE 0.0 END) AS dcg,
         sum(CASE WHEN rank <= n_refs THEN is_rel / log2(rank + 1) ELSE 0.0 END) AS idcg
  FROM hq GROUP BY query_id
),
rk0 AS (
  SELECT qids.query_id, first_rel, coalesce(cg, 0) AS cg, coalesce(dcg, 0.0) AS dcg, coalesce(idcg, 0.0) AS idcg,
         least(coalesce(refs.n_refs_distinct, 0), {max_k}) AS m
  FROM qids LEFT JOIN pq USING (query_id) LEFT JOIN refs USING (query_id)
),
ranking AS (
  SELECT query_id,
         round(coalesce(1.0 / first_rel, 0.0), 6) AS rr,
         CAST(cg AS BIGINT) AS cg,
         round(dcg, 6) AS dcg,
         round(idcg, 6) AS idcg,
         round(CASE WHEN dcg = 0 OR idcg = 0 THEN 0.0 ELSE dcg / idcg END, 6) AS ndcg,
         round(CASE WHEN dcg = 0 OR m = 0 THEN 0.0
                    ELSE dcg / list_sum(list_transform(range(1, m + 1), lambda i: 1.0 / log2(i + 1))) END, 6)
           AS ndcg_standard
  FROM rk0
)"""


CTE_NAMES = ["rel", "h", "h2", "h3", "perq", "refs", "qids", "grid", "g", "mt", "at_k", "hq", "pq", "rk0", "ranking"]


def metric_ctes_for(max_k: int, hits: str, qrels: str, prefix: str) -> str:
    """``metric_ctes`` with every CTE name prefixed and other input CTE names, to compute several configs."""
    import re

    sql = metric_ctes(max_k)
    for name in CTE_NAMES:
        sql = re.sub(rf"\b{name}\b", prefix + name, sql)
    sql = re.sub(r"\bhits\b", hits, sql)
    return re.sub(r"\bqrels\b", qrels, sql)


def _inputs(spark, sf_dir):
    # both are read several times: by each metric, and for the references of each
    hits = cut_lineage(bm25_hits(spark, sf_dir))
    qr = cut_lineage(qrels(spark, sf_dir))
    qs = read_table(spark, sf_dir, "benchmark").selectExpr("item_id AS query_id")
    return hits, qr, qs


ALL = "WITH " + bm25_hits_ctes() + "," + QRELS_CTE + metric_ctes(K)


@register("retrieval_metrics_at_k", ALL + """
SELECT query_id, k, recall, "precision", f1, ap FROM at_k""")
def q_metrics_at_k(spark, sf_dir):
    hits, qr, qs = _inputs(spark, sf_dir)
    return metrics.metrics_at_k(hits, qr, qs, K)


@register("retrieval_ranking_metrics", ALL + """
SELECT query_id, rr, cg, dcg, idcg, ndcg, ndcg_standard FROM ranking""")
def q_ranking_metrics(spark, sf_dir):
    hits, qr, qs = _inputs(spark, sf_dir)
    return metrics.ranking_metrics(hits, qr, qs, K)


@register("retrieval_metric_means", ALL + f"""
SELECT round(avg(recall), 6) AS mean_recall, round(avg("precision"), 6) AS mean_precision,
       round(avg(f1), 6) AS mean_f1, round(avg(ap), 6) AS mean_ap, count(*) AS n_questions,
       (SELECT round(avg(rr), 6) FROM ranking) AS mean_rr,
       (SELECT round(avg(ndcg), 6) FROM ranking) AS mean_ndcg
FROM at_k WHERE k = {K}""")
def q_metric_means(spark, sf_dir):
    hits, qr, qs = _inputs(spark, sf_dir)
    return metrics.mean_metrics(metrics.metrics_at_k(hits, qr, qs, K), metrics.ranking_metrics(hits, qr, qs, K), K)
