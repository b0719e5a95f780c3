"""Retrieval metrics as set-based plans (E-01..E-09).

Inputs are tables, not lists:
  hits(query_id, rank, chunk_id)   rank 1..n, the retriever's order
  qrels(query_id, chunk_id)        the reference list; repeats count in its length
  queries(query_id)                every question to report (no hit / no reference -> zeros)

Semantics follow the reference's definitions, including two unusual ones:
  * recall@k and precision@k count *distinct* relevant candidates (sets),
    while AP@k, CG and DCG count a repeated relevant candidate every time;
  * the "ideal" DCG is the DCG of the actual candidates cut at the number of
    references, so ``ndcg`` is 1 exactly when the first hit is relevant (one
    reference). ``ndcg_standard`` is the usual form and is named apart.

All per-query groups are bounded by the retrieval depth k, so window
partitions by ``query_id`` are small whatever the corpus size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _r(c):
    return F.round(c, 6)


def _prepare(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    rel = qrels.select("query_id", "chunk_id").distinct().withColumn("_rel", F.lit(1))
    h = hits.select("query_id", "rank", "chunk_id").join(rel, ["query_id", "chunk_id"], "left")
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        h.withColumn("is_rel", F.coalesce(F.col("_rel"), F.lit(0)))
        .withColumn("new_rel", F.when(F.row_number().over(first) == 1, F.col("is_rel")).otherwise(0))
        .withColumn("cum_rel", F.sum("new_rel").over(upto))
        .drop("_rel")
    )


def _ref_counts(qrels: DataFrame) -> DataFrame:
    return qrels.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("chunk_id").alias("n_refs_distinct")
    )


def metrics_at_k(hits: DataFrame, qrels: DataFrame, queries: DataFrame, max_k: int) -> DataFrame:
    """(query_id, k, recall, precision, f1, ap) for k = 1..max_k (E-01, E-02, E-03, E-05)."""
    h = _prepare(hits, qrels)
    per_q = h.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_hits"), F.sum("new_rel").alias("tot_rel"))
    grid = queries.select("query_id").distinct().select(
        "query_id", F.explode(F.sequence(F.lit(1), F.lit(max_k))).alias("k")
    )
    at = h.select("query_id", F.col("rank").alias("k"), "is_rel", "cum_rel")
    g = (
        grid.join(at, ["query_id", "k"], "left")
        .join(per_q, "query_id", "left")
        .join(_ref_counts(qrels), "query_id", "left")
    )
    n_hits = F.coalesce(F.col("n_hits"), F.lit(0))
    n_refs = F.coalesce(F.col("n_refs"), F.lit(0))
    cum = F.coalesce(F.col("cum_rel"), F.col("tot_rel"), F.lit(0))
    hit = F.coalesce(F.col("is_rel"), F.lit(0))
    recall = F.when(n_refs == 0, F.lit(0.0)).otherwise(cum / n_refs)
    precision = F.when(n_hits == 0, F.lit(0.0)).otherwise(cum / F.least(F.col("k"), n_hits))
    g = g.select("query_id", "k", recall.alias("recall"), precision.alias("precision"), hit.alias("hit"),
                 n_refs.alias("n_refs"))
    upto = Window.partitionBy("query_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ap = F.when(F.col("n_refs") == 0, F.lit(0.0)).otherwise(
        F.sum(F.col("precision") * F.col("hit")).over(upto) / F.col("n_refs")
    )
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
    )
    return g.select(
        "query_id", "k", _r(F.col("recall")).alias("recall"), _r(F.col("precision")).alias("precision"),
        _r(f1).alias("f1"), _r(ap).alias("ap"),
    )


def ranking_metrics(hits: DataFrame, qrels: DataFrame, queries: DataFrame, max_k: int) -> DataFrame:
    """(query_id, rr, cg, dcg, idcg, ndcg, ndcg_standard) (E-04, E-06..E-09).

    rr has no cut-off; cg and dcg are cut at max_k; idcg is the reference's
    "ideal" (actual candidates cut at the number of references).
    """
    h = _prepare(hits, qrels)
    refs = _ref_counts(qrels)
    hq = h.join(refs, "query_id", "left").withColumn("n_refs", F.coalesce(F.col("n_refs"), F.lit(0)))
    gain = F.col("is_rel") / F.log2(F.col("rank") + 1)
    per_q = hq.groupBy("query_id").agg(
        F.min(F.when(F.col("is_rel") == 1, F.col("rank"))).alias("first_rel"),
        F.sum(F.when(F.col("rank") <= max_k, F.col("is_rel")).otherwise(0)).alias("cg"),
        F.sum(F.when(F.col("rank") <= max_k, gain).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(F.col("rank") <= F.col("n_refs"), gain).otherwise(0.0)).alias("idcg"),
    )
    q = queries.select("query_id").distinct().join(per_q, "query_id", "left").join(refs, "query_id", "left")
    dcg = F.coalesce(F.col("dcg"), F.lit(0.0))
    idcg = F.coalesce(F.col("idcg"), F.lit(0.0))
    m = F.least(F.coalesce(F.col("n_refs_distinct"), F.lit(0)), F.lit(max_k))
    ideal_std = F.aggregate(
        F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
        lambda acc, i: acc + F.when(i <= m, 1.0 / F.log2(i + 1)).otherwise(0.0),
    )
    return q.select(
        "query_id",
        _r(F.coalesce(1.0 / F.col("first_rel"), F.lit(0.0))).alias("rr"),
        F.coalesce(F.col("cg"), F.lit(0)).cast("long").alias("cg"),
        _r(dcg).alias("dcg"),
        _r(idcg).alias("idcg"),
        _r(F.when((dcg == 0) | (idcg == 0), F.lit(0.0)).otherwise(dcg / idcg)).alias("ndcg"),
        _r(F.when((dcg == 0) | (m == 0), F.lit(0.0)).otherwise(dcg / ideal_std)).alias("ndcg_standard"),
    )


def mean_metrics(at_k: DataFrame, ranking: DataFrame, k: int) -> DataFrame:
    """One row: means over questions of recall@k, precision@k, f1@k, ap@k, rr, ndcg."""
    a = at_k.filter(F.col("k") == k).agg(
        _r(F.avg("recall")).alias("mean_recall"), _r(F.avg("precision")).alias("mean_precision"),
        _r(F.avg("f1")).alias("mean_f1"), _r(F.avg("ap")).alias("mean_ap"), F.count(F.lit(1)).alias("n_questions"),
    )
    b = ranking.agg(_r(F.avg("rr")).alias("mean_rr"), _r(F.avg("ndcg")).alias("mean_ndcg"))
    return a.crossJoin(b)
