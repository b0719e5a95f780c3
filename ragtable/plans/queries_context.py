"""Registered fusion, dedupe, context, prompt, history, generation and citation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context as X
from ..operators.evaluate import evaluate
from ..operators.prompts import TEMPLATES, first_text, render_prompt
from ..session import cut_lineage, read_table
from .queries_retrieval import K, bm25_hits, bm25_hits_ctes, qrels
from .queries_vectors import KNN_L2_CTES, knn_hits
from .registry import register

TEMPLATE = "citation_history_v1"
HIST_K = 2


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _texts(spark, sf_dir):
    return read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def _hits(spark, sf_dir):
    """The hits, kept: k rows for each question."""
    return cut_lineage(bm25_hits(spark, sf_dir))


def _hits_with_text(spark, sf_dir, hits=None):
    return X.with_texts(_hits(spark, sf_dir) if hits is None else hits, _texts(spark, sf_dir))


def _questions(spark, sf_dir):
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


HT = "WITH " + bm25_hits_ctes() + """,
ht AS (SELECT h.query_id, h.rank, h.chunk_id, d.text AS content, d.lang, d.source
       FROM hits h JOIN documents d ON d.doc_id = h.chunk_id)"""


@register("rrf_fusion", "WITH " + bm25_hits_ctes() + ",\n" + KNN_L2_CTES + """,
tagged AS (
  SELECT h.query_id, h.rank, h.chunk_id, d.text AS content, 0 AS src, 0.5 AS w
  FROM hits h JOIN documents d ON d.doc_id = h.chunk_id
  UNION ALL
  SELECT k.query_id, k.rank, k.chunk_id, d.text AS content, 1 AS src, 0.5 AS w
  FROM knn k JOIN documents d ON d.doc_id = k.chunk_id),
agg AS (
  SELECT query_id, content, round(sum(w / (rank + 60)), 6) AS score,
         arg_min(chunk_id, src * 1000000 + rank) AS chunk_id, min(src * 1000000 + rank) AS first
  FROM tagged GROUP BY query_id, content)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INTEGER) AS rank,
       chunk_id, content, score
FROM agg""")
def q_rrf(spark, sf_dir):
    texts = _texts(spark, sf_dir)
    b = X.with_texts(_hits(spark, sf_dir), texts)
    k = X.with_texts(cut_lineage(knn_hits(spark, sf_dir)), texts)
    return X.fuse([b, k], [0.5, 0.5])


@register("dedupe_ordered", HT + """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first) AS INTEGER) AS rank, chunk_id
FROM (SELECT query_id, min(rank) AS first, arg_min(chunk_id, rank) AS chunk_id
      FROM ht GROUP BY query_id, content, lang, source)""")
def q_dedupe(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"),
                                                      "lang", "source")
    h = X.with_texts(_hits(spark, sf_dir).select("query_id", "rank", "chunk_id"), d)
    return X.dedupe_ordered(h, ["content", "lang", "source"]).select("query_id", "rank", "chunk_id")


@register("context_append_all", HT + """
SELECT query_id, string_agg(content, chr(10) ORDER BY rank) AS context FROM ht GROUP BY query_id""")
def q_append_all(spark, sf_dir):
    return X.append_all(_hits_with_text(spark, sf_dir))


CITATION_CTX = """,
ctx AS (
  SELECT query_id,
         string_agg('Document ' || CAST(chunk_id AS VARCHAR) || ':' || chr(10) || '```' || chr(10) || content
                    || chr(10) || '```', chr(10) ORDER BY rank) AS context
  FROM ht GROUP BY query_id)"""


@register("context_citation", HT + CITATION_CTX + """
SELECT query_id, context FROM ctx""")
def q_append_citation(spark, sf_dir):
    return X.append_all_citation(_hits_with_text(spark, sf_dir))


def _prompt_sql(name: str, with_context: bool) -> str:
    role, _, _, human = TEMPLATES[name]
    first = first_text(name)
    ctx = "coalesce(ctx.context, '')" if with_context else "''"
    hum = _sql_str(human).replace("{question}", "' || b.text || '").replace("{context}", f"' || {ctx} || '")
    rows = []
    if first is not None:
        rows.append(f"SELECT b.item_id AS query_id, 0 AS msg_index, '{role}' AS role, {_sql_str(first)} AS content "
                    f"FROM benchmark b")
    join = " LEFT JOIN ctx ON ctx.query_id = b.item_id" if with_context else ""
    rows.append(f"SELECT b.item_id AS query_id, {1 if first is not None else 0} AS msg_index, 'human' AS role, "
                f"{hum} AS content FROM benchmark b{join}")
    return "\nUNION ALL\n".join(rows)


def _explode_prompt(df, col):
    return df.select("query_id", F.posexplode(col).alias("msg_index", "m")).select(
        "query_id", "msg_index", F.col("m.role").alias("role"), F.col("m.content").alias("content"))


def _rag_prompts(spark, sf_dir, hits=None):
    ctx = X.append_all_citation(_hits_with_text(spark, sf_dir, hits))
    q = _questions(spark, sf_dir).join(ctx, "query_id", "left")
    return q.withColumn("prompt", render_prompt(TEMPLATE, F.col("question"), F.coalesce(F.col("context"), F.lit(""))))


@register("prompts_citation_v1", HT + CITATION_CTX + "\n" + _prompt_sql(TEMPLATE, True))
def q_prompts(spark, sf_dir):
    return _explode_prompt(_rag_prompts(spark, sf_dir), F.col("prompt"))


@register("no_rag_prompts", _prompt_sql(TEMPLATE, False))
def q_no_rag(spark, sf_dir):
    q = _questions(spark, sf_dir).withColumn("prompt", X.no_rag_prompt(TEMPLATE, F.col("question")))
    return _explode_prompt(q, F.col("prompt"))


@register("history_window_k2", f"""
SELECT conv_id, turn, role, text FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations)
WHERE r <= {2 * HIST_K}""")
def q_history(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return X.history_window(c, HIST_K).select("conv_id", "turn", "role", "text")


@register("reset_history", """
WITH last AS (SELECT conv_id, max(turn) AS rt FROM conversations WHERE role = 'system' GROUP BY conv_id)
SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c LEFT JOIN last USING (conv_id)
WHERE last.rt IS NULL OR c.turn > last.rt""")
def q_reset(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    return X.reset_history(c, F.col("role") == "system").select("conv_id", "turn", "role", "text")


GEN_SQL = HT + CITATION_CTX + """,
ans AS (SELECT b.item_id AS query_id, b.text || chr(10) || 'Context:' || chr(10) || coalesce(ctx.context, '') AS answer
        FROM benchmark b LEFT JOIN ctx ON ctx.query_id = b.item_id)"""


@register("generate_passthrough", GEN_SQL + """
SELECT query_id, answer FROM ans""")
def q_generate(spark, sf_dir):
    p = X.generate(_rag_prompts(spark, sf_dir), "prompt", "model_output")
    return p.select("query_id", X.parse_output(F.col("model_output")).alias("answer"))


@register("cite_sources", GEN_SQL + """,
cited AS (
  SELECT a.query_id, list_sort(list_distinct(list(split_part(CAST(h.chunk_id AS VARCHAR), '_', 1)))) AS srcs
  FROM ans a JOIN hits h ON h.query_id = a.query_id
  WHERE contains(a.answer, CAST(h.chunk_id AS VARCHAR))
  GROUP BY a.query_id)
SELECT a.query_id,
       CASE WHEN cited.srcs IS NULL OR len(cited.srcs) = 0 THEN a.answer
            ELSE a.answer || chr(10) || chr(10) || 'Sources:' ||
                 array_to_string(list_transform(cited.srcs, lambda s: chr(10) || '- https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:' || s), '')
       END AS answer
FROM ans a LEFT JOIN cited USING (query_id)""")
def q_cite(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    p = X.generate(_rag_prompts(spark, sf_dir, hits), "prompt", "model_output")
    answers = cut_lineage(p.select("query_id", X.parse_output(F.col("model_output")).alias("answer")))  # read twice
    return X.cite_sources(answers, hits).select("query_id", "answer")


@register("answer_batch")
def q_answer_batch(spark, sf_dir):
    """A-10 composite (rows-only): BM25 top-5 -> dedupe -> cited context -> prompt -> passthrough -> cite."""
    out = X.answer_batch(_questions(spark, sf_dir), _hits(spark, sf_dir), _texts(spark, sf_dir), TEMPLATE)
    return out.select("query_id", "question", "answer", "no_rag_answer")


@register("evaluate")
def q_evaluate(spark, sf_dir):
    """E-25 composite (rows-only; its parts have SQL): every benchmark question answered with and without context, and all its metrics."""
    qs = _questions(spark, sf_dir).withColumn("reference", F.col("question"))
    return evaluate(qs, bm25_hits(spark, sf_dir), cut_lineage(qrels(spark, sf_dir)), _texts(spark, sf_dir), K, TEMPLATE)
