"""Registered keyphrase queries (R-08, R-09): benchmark questions against the whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyphrases as P
from ..session import read_table
from .queries_retrieval import K, bm25_hits, bm25_hits_ctes
from .registry import register

_STOP = ", ".join(f"'{w}'" for w in P.STOP_WORDS)


def _tokens_sql(expr: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


PHRASE_CTES = f"""
qt2 AS (SELECT item_id AS query_id, {_tokens_sql('text')} AS t FROM benchmark),
asked AS (
  SELECT query_id, phrase, count(*) AS tf FROM (
    SELECT query_id, array_to_string(t[i : i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, len(t) - m + 2)) AS i FROM qt2, (SELECT unnest([1, 2]) AS m) WHERE len(t) >= m))
  WHERE split_part(phrase, ' ', 1) NOT IN ({_STOP}) AND split_part(phrase, ' ', -1) NOT IN ({_STOP}) GROUP BY query_id, phrase),
dt2 AS (SELECT doc_id, {_tokens_sql('text')} AS t FROM documents),
held AS (
  SELECT DISTINCT doc_id, array_to_string(t[i : i + m - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, len(t) - m + 2)) AS i FROM dt2, (SELECT unnest([1, 2]) AS m) WHERE len(t) >= m)),
dfs AS (SELECT phrase, count(*) AS df FROM held WHERE phrase IN (SELECT phrase FROM asked) GROUP BY phrase),
weighed AS (
  SELECT query_id, phrase, tf, coalesce(df, 0)::BIGINT AS df, round(tf * ln(((SELECT count(*) FROM documents) + 1) / (coalesce(df, 0) + 1)), 6) AS score
  FROM asked LEFT JOIN dfs USING (phrase)),
keys AS (
  SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, phrase)::INT AS rank, phrase, tf, df, score FROM weighed) WHERE rank <= 5)"""


def _keyphrases(spark, sf_dir):
    return P.keyphrases(read_table(spark, sf_dir, "benchmark"), read_table(spark, sf_dir, "documents"), id_col="item_id", text_col="text")


@register("keyphrases", f"WITH {PHRASE_CTES} SELECT query_id, rank, phrase, tf, df, score FROM keys")
def q_keyphrases(spark, sf_dir):
    return _keyphrases(spark, sf_dir)


_HITS = ", ".join(f"""CASE WHEN grouping(phrase) = 1 THEN max(CASE WHEN hrank = {r} THEN hscore END)
  ELSE coalesce(max(CASE WHEN hrank = {r} THEN n END), 0)::DOUBLE END AS hit_{r}""" for r in range(1, K + 1))


@register("keyword_hit_matrix", f"""
WITH {bm25_hits_ctes().strip()}, {PHRASE_CTES},
cells AS (
  SELECT h.query_id, k.phrase, h.rank AS hrank, h.score AS hscore,
         (length(lower(d.text)) - length(replace(lower(d.text), k.phrase, ''))) // length(k.phrase) AS n
  FROM hits h JOIN documents d ON d.doc_id = h.chunk_id LEFT JOIN keys k USING (query_id))
SELECT query_id, phrase AS keyword, grouping(phrase) = 1 AS is_score, {_HITS}
FROM cells GROUP BY GROUPING SETS ((query_id, phrase), (query_id)) HAVING grouping(phrase) = 1 OR phrase IS NOT NULL""")
def q_keyword_hit_matrix(spark, sf_dir):
    texts = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    hits = bm25_hits(spark, sf_dir).join(texts, "chunk_id")
    return P.keyword_hit_matrix(hits, _keyphrases(spark, sf_dir), K)
