"""Registered vector queries: embedding table, exact kNN by L2 and by cosine (V-01..V-06)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vectors as V
from ..session import read_table
from .registry import register

K = 5
DIM = 64


def hashed_vectors_sql(table: str, id_col: str, text_col: str, dim: int = DIM) -> str:
    """CTE body producing (id, embedding) with the hashed embedder, relationally."""
    return f"""(
  WITH tok AS (
    SELECT {id_col} AS id,
           unnest(list_filter(string_split_regex(lower(coalesce({text_col}, '')), '[^a-z0-9]+'), lambda t: t <> '')) AS t
    FROM {table}),
  b AS (SELECT id, (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}) AS bucket, count(*)::DOUBLE AS c
        FROM tok GROUP BY id, bucket),
  nrm AS (SELECT id, sqrt(sum(c * c)) AS nr FROM b GROUP BY id),
  grid AS (SELECT {id_col} AS id, unnest(range({dim})) AS j FROM {table})
  SELECT g.id, list(CASE WHEN coalesce(n.nr, 0) = 0 THEN 0.0 ELSE coalesce(b.c, 0) / n.nr END ORDER BY g.j) AS embedding
  FROM grid g LEFT JOIN b ON b.id = g.id AND b.bucket = g.j LEFT JOIN nrm n ON n.id = g.id
  GROUP BY g.id)"""


def doc_vectors(spark, sf_dir):
    return V.build_vector_table(read_table(spark, sf_dir, "documents"), "doc_id", "text", DIM)


def question_vectors(spark, sf_dir):
    q = read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return V.embed_column(q, "text", "embedding", DIM).select("query_id", "embedding")


def knn_hits(spark, sf_dir, k: int = K):
    return V.knn(question_vectors(spark, sf_dir), doc_vectors(spark, sf_dir), k, "l2")


KNN_L2_CTES = f"""dv AS {hashed_vectors_sql('documents', 'doc_id', 'text')},
qv AS {hashed_vectors_sql('benchmark', 'item_id', 'text')},
knn_all AS (
  SELECT qv.id AS query_id, dv.id AS chunk_id, round(list_distance(qv.embedding, dv.embedding), 6) AS distance
  FROM qv, dv),
knn AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM knn_all)
  WHERE rank <= {K})"""


@register("vector_table", f"""
WITH v AS {hashed_vectors_sql('documents', 'doc_id', 'text')}
SELECT id AS chunk_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM v""")
def q_vector_table(spark, sf_dir):
    return doc_vectors(spark, sf_dir).select("chunk_id", V.round_vector(F.col("embedding")).alias("embedding"))


@register("knn_l2_top5", f"""
WITH {KNN_L2_CTES}
SELECT query_id, rank, chunk_id, distance FROM knn""")
def q_knn_l2(spark, sf_dir):
    return knn_hits(spark, sf_dir)


@register("knn_cosine_embeddings_top5", f"""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
         round(1.0 - CASE WHEN list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
                          ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))
                     END, 6) AS distance
  FROM e a, e b)
SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM p)
WHERE rank <= {K}""")
def q_knn_cosine(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings")
    return V.knn(e, e, K, "cosine", qid="vec_id", qvec="embedding", vid="vec_id", vvec="embedding")
