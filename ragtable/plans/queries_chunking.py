"""Registered chunking queries over the whole ``documents`` table (C-01..C-13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.embed import cosine_distance
from ..functions.text import PY_SPACE
from ..operators import chunking as C
from ..session import bound_batches, read_table
from .registry import register

SIZE, OVERLAP = 256, 32
TOK_SIZE, TOK_OVERLAP = 64, 8
PCT = 95.0

STRIP_SQL = f"'^{PY_SPACE}+|{PY_SPACE}+$'"
SENT_SPLIT_SQL = (f"string_split(regexp_replace(coalesce(text, ''), '([.?!]){PY_SPACE}+', "
                  f"'\\1' || chr(1), 'g'), chr(1))")


def _docs(spark, sf_dir):
    bound_batches(spark)
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


@register("chunk_character_windows", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (
  SELECT doc_id, text,
         unnest(range(0, CASE WHEN n <= {SIZE} THEN 1 ELSE 1 + ceil((n - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT END)) AS i
  FROM d),
p AS (SELECT doc_id, i, regexp_replace(substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}), {STRIP_SQL}, '', 'g') AS chunk_text
      FROM w)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, chunk_text
FROM p WHERE chunk_text <> ''""")
def q_character_windows(spark, sf_dir):
    return C.split_documents(_docs(spark, sf_dir), C.character_windows(F.col("text"), SIZE, OVERLAP),
                             keep=["doc_id"])


@register("chunk_ids", f"""
WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (
  SELECT doc_id, text,
         unnest(range(0, CASE WHEN n <= {SIZE} THEN 1 ELSE 1 + ceil((n - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT END)) AS i
  FROM d),
p AS (SELECT doc_id, i, regexp_replace(substr(text, i * {SIZE - OVERLAP} + 1, {SIZE}), {STRIP_SQL}, '', 'g') AS chunk_text
      FROM w),
c AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS chunk_index FROM p WHERE chunk_text <> ''),
n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY doc_id),
o AS (SELECT doc_id, sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - n AS off FROM n)
SELECT c.doc_id, CAST(c.chunk_index AS INTEGER) AS chunk_index,
       CAST(c.doc_id AS VARCHAR) || '_' || CAST(c.chunk_index AS VARCHAR) || '.json' AS chunk_key,
       CAST(o.off + c.chunk_index AS BIGINT) AS chunk_id
FROM c JOIN o USING (doc_id)""")
def q_chunk_ids(spark, sf_dir):
    ch = C.split_documents(_docs(spark, sf_dir), C.character_windows(F.col("text"), SIZE, OVERLAP), keep=["doc_id"])
    ch = C.assign_chunk_ids(ch, doc_key="doc_id")
    return ch.select("doc_id", "chunk_index", C.chunk_key(F.col("doc_id"), F.col("chunk_index"), ".json").alias("chunk_key"),
                     F.col("chunk_id").cast("long").alias("chunk_id"))


@register("chunk_token_windows", f"""
WITH t AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> '') AS toks
           FROM documents),
w AS (
  SELECT doc_id, toks,
         unnest(range(0, CASE WHEN len(toks) = 0 THEN 0 WHEN len(toks) <= {TOK_SIZE} THEN 1
                              ELSE 1 + ceil((len(toks) - {TOK_SIZE}) / {TOK_SIZE - TOK_OVERLAP}.0)::BIGINT END)) AS i
  FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index,
       array_to_string(toks[i * {TOK_SIZE - TOK_OVERLAP} + 1 : i * {TOK_SIZE - TOK_OVERLAP} + {TOK_SIZE}], ' ') AS chunk_text
FROM w""")
def q_token_windows(spark, sf_dir):
    return C.split_documents(_docs(spark, sf_dir), C.token_windows(F.col("text"), TOK_SIZE, TOK_OVERLAP),
                             keep=["doc_id"])


@register("sentences", f"""
WITH s AS (SELECT doc_id, {SENT_SPLIT_SQL} AS sents FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index, sents[i] AS sentence
FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS i FROM s)""")
def q_sentences(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("sentence_index", "sentence"))


@register("sentence_windows", f"""
WITH s AS (SELECT doc_id, {SENT_SPLIT_SQL} AS sents FROM documents)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_index,
       concat_ws(' ', CASE WHEN i > 1 THEN sents[i - 1] END, sents[i], sents[i + 1]) AS window_text
FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS i FROM s)""")
def q_sentence_windows(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", F.posexplode(C.sentence_windows(C.sentences(F.col("text"))))
                    .alias("sentence_index", "window_text"))


@register("consecutive_cosine_distance", """
WITH p AS (
  SELECT a.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS dp,
         sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) AS na,
         sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS nb
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(CASE WHEN na = 0 OR nb = 0 THEN 1.0 ELSE 1.0 - dp / (na * nb) END, 6) AS distance FROM p""")
def q_consecutive_distance(spark, sf_dir):
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("e_next"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(cosine_distance(F.col("e"), F.col("e_next")), 6)
                                        .alias("distance"))


@register("semantic_chunks", f"""
WITH s0 AS (SELECT doc_id, text, {SENT_SPLIT_SQL} AS sents FROM documents),
s AS (SELECT doc_id, text, sents, len(sents) AS n_sent, unnest(range(0, len(sents))) AS i FROM s0),
win AS (SELECT doc_id, i, sents[i + 1] AS sentence, concat_ws(' ', CASE WHEN i > 0 THEN sents[i] END, sents[i + 1], sents[i + 2]) AS w FROM s),
tok AS (SELECT doc_id, i, unnest(list_filter(string_split_regex(lower(w), '[^a-z0-9]+'), lambda t: t <> '')) AS t
        FROM win),
b AS (SELECT doc_id, i, (('0x' || substr(md5(t), 1, 8))::BIGINT % 64) AS bucket, count(*)::DOUBLE AS c
      FROM tok GROUP BY doc_id, i, bucket),
nrm AS (SELECT doc_id, i, sqrt(sum(c * c)) AS nr FROM b GROUP BY doc_id, i),
dots AS (SELECT x.doc_id, x.i, sum(x.c * y.c) AS dp FROM b x JOIN b y
           ON x.doc_id = y.doc_id AND y.i = x.i + 1 AND x.bucket = y.bucket GROUP BY x.doc_id, x.i),
dist AS (
  SELECT w1.doc_id, w1.i,
         round(CASE WHEN coalesce(n1.nr, 0) = 0 OR coalesce(n2.nr, 0) = 0 THEN 1.0
                    ELSE 1.0 - coalesce(dots.dp, 0) / (n1.nr * n2.nr) END, 6) AS d
  FROM win w1 JOIN win w2 ON w2.doc_id = w1.doc_id AND w2.i = w1.i + 1
  LEFT JOIN nrm n1 ON n1.doc_id = w1.doc_id AND n1.i = w1.i
  LEFT JOIN nrm n2 ON n2.doc_id = w2.doc_id AND n2.i = w2.i
  LEFT JOIN dots ON dots.doc_id = w1.doc_id AND dots.i = w1.i),
thr AS (SELECT doc_id, quantile_cont(d, {PCT / 100.0}) AS t FROM dist GROUP BY doc_id),
flags AS (SELECT dist.doc_id, dist.i, CASE WHEN dist.d > thr.t THEN 1 ELSE 0 END AS f FROM dist JOIN thr USING (doc_id)),
g AS (
  SELECT win.doc_id, win.i, win.sentence,
         coalesce(sum(flags.f) OVER (PARTITION BY win.doc_id ORDER BY win.i
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gid
  FROM win LEFT JOIN flags ON flags.doc_id = win.doc_id AND flags.i = win.i),
multi AS (SELECT doc_id, CAST(gid AS INTEGER) AS chunk_index, string_agg(sentence, ' ' ORDER BY i) AS chunk_text
          FROM g WHERE doc_id IN (SELECT doc_id FROM s0 WHERE len(sents) > 1) GROUP BY doc_id, gid)
SELECT doc_id, chunk_index, chunk_text FROM multi
UNION ALL
SELECT doc_id, 0 AS chunk_index, coalesce(text, '') AS chunk_text FROM s0 WHERE len(sents) <= 1""")
def q_semantic_chunks(spark, sf_dir):
    return C.split_documents(_docs(spark, sf_dir), C.semantic_split(F.col("text"), PCT), keep=["doc_id"])


@register("recursive_chunks")
def q_recursive_chunks(spark, sf_dir):
    """C-03 (rows-only): recursive splitter 256/32 on ' ' with start indices (C-13)."""
    d = _docs(spark, sf_dir).withColumn("chunks", C.recursive_split(F.col("text"), SIZE, OVERLAP, [" "]))
    d = d.withColumn("starts", C.start_indices(F.col("text"), F.col("chunks")))
    return d.select("doc_id", F.posexplode(F.arrays_zip("chunks", "starts")).alias("chunk_index", "z")).select(
        "doc_id", "chunk_index", F.col("z.chunks").alias("chunk_text"), F.col("z.starts").alias("start_index"))


@register("boundary_chunks")
def q_boundary_chunks(spark, sf_dir):
    """C-07 (rows-only): chunks <= 512 characters cut at paragraph, sentence and word boundaries."""
    d = _docs(spark, sf_dir)
    return C.split_documents(d, C.boundary_split(F.col("text"), 512, 64, ["\n\n", "\n", ". ", " "]), keep=["doc_id"])
