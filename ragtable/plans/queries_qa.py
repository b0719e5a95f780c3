"""Registered QA-generation and answer-metric queries (Q-01..Q-07, E-10..E-15).

Answer metrics score consecutive conversation turns: the user message
(prediction) against the assistant reply that follows it (reference), over
the whole ``conversations`` table.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import PY_SPACE
from ..operators import answer_metrics as AM
from ..operators import qa as Q
from ..operators.chunking import sentences
from ..session import read_table
from .registry import register


def _types_sql() -> str:
    return "(VALUES " + ", ".join(f"('{t}')" for t in Q.QUESTION_TYPES) + ") t(type)"


# The expected prompt, written out apart from the operator's own constant; chr(10) ends each line.
_PROMPT_SQL = r"""regexp_replace(
  'You are an oracle system for a Retrieval Augmented Generation System, that guesses questions that would be answered by a particular exerpt of text.' || chr(10) ||
  repeat(' ', 12) || 'Given the following exerpt of text, generate 1 question that can be answered by the exerpt of text.' || chr(10) ||
  repeat(' ', 12) || '```' || chr(10) || repeat(' ', 12) || coalesce(d.text, '') || chr(10) || repeat(' ', 12) || '```' || chr(10) ||
  repeat(' ', 12) || CASE t.type
    WHEN 'confirmation' THEN 'Focus only on confirmation questions, i.e. questions that can be answered with a yes or no.'
    WHEN 'factoid' THEN 'Focus only on factoid questions, that usually begin with a who, what, where, when, why, or how.'
    WHEN 'list' THEN 'Focus only on list questions, i.e. questions that are answered with a list of items.'
    WHEN 'causal' THEN 'Focus only on causal questions, i.e. questions that begin with why or how.'
    WHEN 'hypothetical' THEN 'Focus only on hypothetical questions, i.e. questions that ask what if.'
    WHEN 'complex' THEN 'Focus only on complex questions, i.e. questions that require multi-step reasoning and comparisons.'
    ELSE '' END || chr(10) ||
  repeat(' ', 12) || 'Format the pairs as follows:' || chr(10) || repeat(' ', 12) || '```' || chr(10) ||
  repeat(' ', 12) || '{QUESTION i}: <question i> {ANSWER i}: <answer i>' || chr(10) || repeat(' ', 12) || '```' || chr(10) ||
  repeat(' ', 12) || 'Do not add any additional newlines between the pairs. Directly continue with the answer after the question.' || chr(10) ||
  repeat(' ', 12) || 'Only add a newline between the pairs (after the answer) if you want to add more pairs.' || chr(10) ||
  repeat(' ', 12) || 'Do not deviate from this format, since it will be used to extract the questions with the following regex: `{QUESTION \d+}: .+ {ANSWER \d+}: .+`' || chr(10),
  '(?m)^[ \t]+$', '', 'g')"""


@register("question_types_all", f"""
SELECT d.doc_id, t.type FROM documents d CROSS JOIN {_types_sql()}""")
def q_types(spark, sf_dir):
    return Q.all_types(read_table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "type")


@register("question_type_random")
def q_type_random(spark, sf_dir):
    """Q-02 (rows-only: seeded xxhash64 has no DuckDB twin)."""
    return Q.random_type(read_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=42)


@register("oracle_prompts", f"""
SELECT d.doc_id, t.type, {_PROMPT_SQL} AS prompt
FROM documents d CROSS JOIN {_types_sql()}""")
def q_oracle_prompts(spark, sf_dir):
    d = Q.all_types(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "type", Q.oracle_prompt(Q.oracle_context(F.lit(None).cast("string"), F.col("text")),
                                                      F.col("type")).alias("prompt"))


def _turn_pairs(spark, sf_dir):
    c = read_table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prediction"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("reference"))
    return u.join(a, ["conv_id", "turn"]).select(
        F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "prediction", "reference")


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id || ':' || u.turn AS pair_id, u.text AS prediction, a.text AS reference
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user')"""


@register("qa_pairs_extracted")
def q_qa_pairs(spark, sf_dir):
    """Q-05/Q-06 (rows-only: DuckDB's RE2 has no back-reference): responses built from turn pairs."""
    p = _turn_pairs(spark, sf_dir)
    resp = F.concat(F.lit("{QUESTION 1}: "), F.col("prediction"), F.lit(" {ANSWER 1}: "), F.col("reference"))
    d = p.withColumn("type", F.lit("default")).withColumn("pairs", Q.extract_qa_pairs(resp))
    return Q.flatten_pairs(d, "pair_id", "type", "pairs")


def _digest_model():
    """A stand-in for a language model: answers in the asked format, with a question and an answer that follow from the prompt."""
    from hashlib import md5

    def answer(prompts: list[list[dict]]) -> list[str]:
        texts = [p[-1]["content"] for p in prompts]
        return [f"{{QUESTION 1}}: What is {md5(t.encode()).hexdigest()}? {{ANSWER 1}}: {len(t)} characters" for t in texts]

    return answer


@register("oracle_dataset", f"""
SELECT doc_id AS source, type, 'What is ' || md5(prompt) || '?' AS question, length(prompt) || ' characters' AS answer
FROM (SELECT d.doc_id, t.type, {_PROMPT_SQL} AS prompt FROM documents d CROSS JOIN {_types_sql()})""")
def q_oracle_dataset(spark, sf_dir):
    """Q-07 over every document and type, with a model that answers in the format."""
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return Q.generate_oracle_dataset(d, "doc_id", "text", strategy="all", model=_digest_model)


def _bleu_tok_sql(col: str) -> str:
    t = f"' ' || replace(replace(replace(replace(replace(replace(replace(coalesce({col}, ''), '<skipped>', ''), " \
        f"'-' || chr(10), ''), chr(10), ' '), '&quot;', '\"'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>') || ' '"
    for pat, rep in AM.BLEU_13A_RULES:
        t = f"regexp_replace({t}, '{pat}', '{rep.replace('$', chr(92))}', 'g')"
    return f"list_filter(string_split_regex({t}, '{PY_SPACE}+'), lambda x: x <> '')"


def _clip_sql(ptok: str, rtok: str, orders: list[int]) -> str:
    ng = lambda col, n: (f"CASE WHEN len({col}) >= {n} THEN list_transform(range(1, len({col}) - {n} + 2), "  # noqa: E731
                         f"lambda i: array_to_string({col}[i:i + {n - 1}], ' ')) ELSE [] END")
    cand = " UNION ALL ".join(f"SELECT pair_id, {n} AS n, unnest({ng('ptok', n)}) AS gram FROM tok" for n in orders)
    ref = " UNION ALL ".join(f"SELECT pair_id, {n} AS n, unnest({ng('rtok', n)}) AS gram FROM tok" for n in orders)
    grid = " UNION ALL ".join(f"SELECT pair_id, {n} AS n, len(ptok) AS pl, len(rtok) AS rl FROM tok" for n in orders)
    return f"""tok AS (SELECT pair_id, {ptok} AS ptok, {rtok} AS rtok FROM pairs),
cg AS (SELECT pair_id, n, gram, count(*) AS cp FROM ({cand}) GROUP BY ALL),
rg AS (SELECT pair_id, n, gram, count(*) AS cr FROM ({ref}) GROUP BY ALL),
m AS (SELECT pair_id, n, sum(least(cp, cr)) AS overlap FROM cg JOIN rg USING (pair_id, n, gram) GROUP BY ALL),
cl AS (SELECT g.pair_id, g.n, g.pl, g.rl, coalesce(m.overlap, 0) AS overlap FROM ({grid}) g
       LEFT JOIN m USING (pair_id, n))"""


@register("bleu_scores", f"""
WITH {PAIRS_SQL},
{_clip_sql(_bleu_tok_sql('prediction'), _bleu_tok_sql('reference'), [1, 2, 3, 4])},
pr AS (SELECT pair_id, n, pl, rl,
              CASE WHEN greatest(pl - n + 1, 0) > 0 THEN overlap / greatest(pl - n + 1, 0) ELSE 0.0 END AS p FROM cl),
agg AS (SELECT pair_id, any_value(pl) AS tl, any_value(rl) AS rl, list(p ORDER BY n) AS ps, min(p) AS minp,
               sum(ln(CASE WHEN p > 0 THEN p ELSE 1 END)) AS slog FROM pr GROUP BY pair_id),
r AS (SELECT *, CASE WHEN rl > 0 THEN tl / rl ELSE 0.0 END AS ratio FROM agg)
SELECT pair_id,
       round((CASE WHEN minp > 0 THEN exp(slog / 4) ELSE 0.0 END) *
             (CASE WHEN ratio > 1.0 THEN 1.0 WHEN ratio = 0 THEN 0.0 ELSE exp(1.0 - 1.0 / ratio) END), 6) AS bleu,
       list_transform(ps, lambda x: round(x, 6)) AS precisions,
       round(CASE WHEN ratio > 1.0 THEN 1.0 WHEN ratio = 0 THEN 0.0 ELSE exp(1.0 - 1.0 / ratio) END, 6) AS brevity_penalty,
       round(ratio, 6) AS length_ratio, CAST(tl AS BIGINT) AS translation_length, CAST(rl AS BIGINT) AS reference_length
FROM r""")
def q_bleu(spark, sf_dir):
    return AM.bleu(_turn_pairs(spark, sf_dir))


_WT = "list_filter(string_split_regex(lower(coalesce({c}, '')), '[^a-z0-9]+'), lambda x: x <> '')"


@register("rouge_scores", f"""
WITH {PAIRS_SQL},
{_clip_sql(_WT.format(c='prediction'), _WT.format(c='reference'), [1, 2])},
f AS (SELECT pair_id, n,
             overlap / greatest(greatest(pl - n + 1, 0), 1) AS p, overlap / greatest(greatest(rl - n + 1, 0), 1) AS r
      FROM cl)
SELECT pair_id,
       round(max(CASE WHEN n = 1 THEN (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) END), 6) AS rouge1,
       round(max(CASE WHEN n = 2 THEN (CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END) END), 6) AS rouge2
FROM f GROUP BY pair_id""")
def q_rouge(spark, sf_dir):
    return AM.rouge_n(_turn_pairs(spark, sf_dir))


@register("rouge_l_scores")
def q_rouge_l(spark, sf_dir):
    """E-12/E-13 (rows-only: LCS dynamic programme in a pandas UDF)."""
    p = _turn_pairs(spark, sf_dir)
    return p.select("pair_id", AM.rouge_l("prediction", "reference").alias("rougeL"),
                    AM.rouge_lsum("prediction", "reference").alias("rougeLsum"))


@register("token_match_scores")
def q_token_match(spark, sf_dir):
    """E-14 (rows-only): greedy token-embedding match with the hashed token embedder."""
    p = _turn_pairs(spark, sf_dir)
    return p.select("pair_id", AM.token_match(F.col("prediction"), F.col("reference")).alias("m")).select(
        "pair_id", "m.precision", "m.recall", "m.f1")


@register("answer_relevance")
def q_answer_relevance(spark, sf_dir):
    """E-15 (rows-only): question vs the questions found in the reply (sentences ending in '?')."""
    p = _turn_pairs(spark, sf_dir)
    p = p.withColumn("generated", F.filter(sentences(F.col("reference")), lambda s: s.endswith("?")))
    return AM.answer_relevance(p, "prediction", "generated")
