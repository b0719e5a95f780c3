"""Registered retrieval queries: BM25 index, scores, top-k, qrels (R-01..R-04, R-07)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bm25
from ..operators.containment import verbatim_qrels
from ..session import read_table
from .registry import register

K = 5

# ---- SQL building blocks (DuckDB) -------------------------------------------

BM25_INDEX_CTES = """
toks AS (
  SELECT doc_id AS chunk_id,
         list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS t
  FROM documents
),
lens AS (SELECT chunk_id, len(t) AS dl FROM toks),
base AS (SELECT count(*) AS n_chunks, sum(dl) / count(*) AS avgdl FROM lens),
post AS (
  SELECT term, chunk_id, dl, count(*) AS tf
  FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks)
  GROUP BY term, chunk_id, dl
),
dft AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n_chunks - df + 0.5) - ln(df + 0.5) AS idf_raw FROM dft, base),
eps AS (SELECT avg(idf_raw) AS avg_idf, 0.25 * avg(idf_raw) AS eps_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN idf_raw < 0 THEN eps_idf ELSE idf_raw END AS idf FROM raw, eps),
wpost AS (
  SELECT p.term, p.chunk_id, p.tf, p.dl,
         idf.idf * (p.tf * 2.5) / (p.tf + 1.5 * (0.25 + 0.75 * p.dl / base.avgdl)) AS w
  FROM post p JOIN idf USING (term), base
),
qt AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT item_id AS query_id,
           unnest(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '')) AS term
    FROM benchmark)
  GROUP BY query_id, term
),
scores AS (
  SELECT query_id, chunk_id, round(sum(qtf * w), 6) AS score
  FROM qt JOIN wpost USING (term) GROUP BY query_id, chunk_id
)"""


def bm25_hits_ctes(k: int = K) -> str:
    return BM25_INDEX_CTES + f""",
filler AS (SELECT chunk_id FROM lens ORDER BY chunk_id LIMIT {k}),
cand AS (
  SELECT query_id, chunk_id, max(score) AS score FROM (
    SELECT query_id, chunk_id, score FROM scores
    UNION ALL
    SELECT b.item_id AS query_id, f.chunk_id, 0.0 AS score FROM benchmark b, filler f)
  GROUP BY query_id, chunk_id
),
hits AS (
  SELECT query_id, CAST(rank AS INTEGER) AS rank, chunk_id, score FROM (
    SELECT query_id, chunk_id, score,
           row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
    FROM cand)
  WHERE rank <= {k}
)"""


QRELS_CTE = """
qrels AS (
  SELECT b.item_id AS query_id, d.doc_id AS chunk_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)
  WHERE b.text <> ''
)"""


# ---- Spark side ----------------------------------------------------------------

def corpus_index(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return bm25.build_index(docs, id_col="doc_id", text_col="text")


def bm25_hits(spark, sf_dir, k: int = K):
    idx = corpus_index(spark, sf_dir)
    questions = read_table(spark, sf_dir, "benchmark")
    return bm25.bm25_search(questions, idx, k, id_col="item_id", text_col="text")


def qrels(spark, sf_dir):
    return verbatim_qrels(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("bm25_postings", "WITH " + BM25_INDEX_CTES + """
SELECT term, chunk_id, tf, CAST(dl AS INTEGER) AS dl, round(w, 6) AS w FROM wpost""")
def q_bm25_postings(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    return idx.postings.select("term", "chunk_id", "tf", F.col("dl").cast("int").alias("dl"),
                               F.round("w", 6).alias("w"))


@register("bm25_corpus_stats", "WITH " + BM25_INDEX_CTES + """
SELECT n_chunks, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf, round(eps_idf, 6) AS eps_idf
FROM base, eps""")
def q_bm25_corpus_stats(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    return idx.stats.select("n_chunks", *[F.round(c, 6).alias(c) for c in ("avgdl", "avg_idf", "eps_idf")])


@register("bm25_term_idf", """
WITH dft AS (
  SELECT term, count(*) AS df
  FROM (SELECT unnest(list_distinct(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))) AS term FROM documents) GROUP BY term),
raw AS (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS idf_raw FROM dft),
eps AS (SELECT 0.25 * avg(idf_raw) AS eps_idf FROM raw)
SELECT term, df, round(CASE WHEN idf_raw < 0 THEN eps_idf ELSE idf_raw END, 6) AS idf FROM raw, eps""")
def q_bm25_term_idf(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    return idx.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("bm25_scores", "WITH " + BM25_INDEX_CTES + """
SELECT query_id, chunk_id, score FROM scores""")
def q_bm25_scores(spark, sf_dir):
    idx = corpus_index(spark, sf_dir)
    questions = read_table(spark, sf_dir, "benchmark")
    return bm25.bm25_scores(questions, idx, id_col="item_id", text_col="text")


@register("bm25_top5", "WITH " + bm25_hits_ctes() + """
SELECT query_id, rank, chunk_id, score FROM hits""")
def q_bm25_top5(spark, sf_dir):
    return bm25_hits(spark, sf_dir)


@register("qrels_verbatim", "WITH " + QRELS_CTE + """
SELECT query_id, chunk_id FROM qrels""")
def q_qrels(spark, sf_dir):
    return qrels(spark, sf_dir)


@register("fill_null_content", """
SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS INTEGER) AS n FROM documents""")
def q_fill_null(spark, sf_dir):
    d = bm25.fill_null_content(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", F.length("text").alias("n"))


FILTER_CTES = """fdocs AS (
  SELECT d.doc_id, d.text FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0
),""" + bm25_hits_ctes().replace("FROM documents", "FROM fdocs")


@register("bm25_top5_filtered", "WITH " + FILTER_CTES + """
SELECT query_id, rank, chunk_id, score FROM hits""")
def q_bm25_filtered(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").join(read_table(spark, sf_dir, "labels"), "doc_id")
    docs = bm25.metadata_filter(docs, (F.col("quality") == 1) & (F.col("toxic") == 0))
    idx = bm25.build_index(docs, id_col="doc_id", text_col="text")
    return bm25.bm25_search(read_table(spark, sf_dir, "benchmark"), idx, K, id_col="item_id", text_col="text")
