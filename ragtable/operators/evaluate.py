"""Evaluation of a retrieval configuration over a question table (E-25).

Questions are answered once, with and without context, and every metric reads
those rows. Hits and answers are kept in the shared checkpoint folder between
the steps, so the chunks are read for the retrieval and for the texts of the
hits only, however many metrics follow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import answer_metrics as A
from . import metrics as M
from .context import answer_batch, generate
from .qa import extract_qa_pairs, oracle_prompt


def generated_questions(answers: DataFrame, n: int, model: Callable | None) -> DataFrame:
    """(pair_id, generated array<string>): the questions that a model asks back from each answer; without a model none."""
    if model is None:
        return answers.select("pair_id", F.array().cast("array<string>").alias("generated"))
    content = oracle_prompt(F.col("prediction"), F.lit("default"), n)
    asked = answers.withColumn("prompt", F.array(F.struct(F.lit("human").alias("role"), content.alias("content"))))
    said = generate(asked, "prompt", "said", model)
    return said.select("pair_id", F.transform(extract_qa_pairs(F.col("said")), lambda p: p["question"]).alias("generated"))


def evaluate(questions: DataFrame, hits: DataFrame, qrels: DataFrame, texts: DataFrame, max_k: int, template: str = "citation_history_v1", citation: bool = True,
             model: Callable | None = None, question_model: Callable | None = None, n_questions: int = 2, embed=None) -> DataFrame:
    """One row for every question: answers and all metrics, lists spread over columns.

    questions(query_id, question, reference): ids are taken to be distinct;
    hits(query_id, rank, chunk_id); qrels(query_id, chunk_id); texts(chunk_id,
    content). A question without hits has zero retrieval metrics and is answered
    from an empty context; one without a reference is compared to the empty text.

    Columns: query_id, answer, no_rag_answer, RET_RC_1..k, RET_PR_.., RET_F1_..,
    RET_AP_.., RET_RR, RET_CG, RET_DCG, RET_NDCG, A_BL, A_BL_PR (mean of the
    precisions), A_RG_1, A_RG_2, A_RG_L, A_RG_Lsum, A_BERT_RAG_{PR,RC,F1},
    A_BERT_{PR,RC,F1} (without context), A_BERT_RAG_DELTA_F1, A_AR_{PR,RC,F1}.
    """
    hits = cut_lineage(hits.select("query_id", "rank", "chunk_id"))
    asked = questions.select("query_id", "question", F.coalesce("reference", F.lit("")).alias("reference"))
    said = answer_batch(asked, hits, texts, template, citation, model=model)
    said = cut_lineage(said.select("query_id", "question", "reference", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce("no_rag_answer", F.lit("")).alias("no_rag_answer")))
    ids = said.select("query_id")
    at = M.metrics_at_k(hits, qrels, ids, max_k)
    lists = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"RET_{name}_{k}") for name, c in (("RC", "recall"), ("PR", "precision"), ("F1", "f1"), ("AP", "ap")) for k in range(1, max_k + 1)]
    ranking = M.ranking_metrics(hits, qrels, ids, max_k).select("query_id", F.col("rr").alias("RET_RR"), F.col("cg").alias("RET_CG"), F.col("dcg").alias("RET_DCG"), F.col("ndcg").alias("RET_NDCG"))
    pairs = said.select(F.col("query_id").alias("pair_id"), "question", F.col("answer").alias("prediction"), "reference")
    bleu = A.bleu(pairs).select("pair_id", F.col("bleu").alias("A_BL"), F.round(F.aggregate("precisions", F.lit(0.0), lambda t, p: t + p) / F.size("precisions"), 6).alias("A_BL_PR"))
    rouge = A.rouge_n(pairs).select("pair_id", F.col("rouge1").alias("A_RG_1"), F.col("rouge2").alias("A_RG_2"))
    asked_back = pairs.join(generated_questions(pairs, n_questions, question_model), "pair_id")
    relevance = A.answer_relevance(asked_back, "question", "generated", embed)
    relevance = relevance.select("pair_id", F.col("ar_precision").alias("A_AR_PR"), F.col("ar_recall").alias("A_AR_RC"), F.col("ar_f1").alias("A_AR_F1"))
    rows = said.select(
        "query_id", "answer", "no_rag_answer", A.rouge_l(F.col("answer"), F.col("reference")).alias("A_RG_L"), A.rouge_lsum(F.col("answer"), F.col("reference")).alias("A_RG_Lsum"),
        A.token_match(F.col("answer"), F.col("reference"), embed).alias("rag"), A.token_match(F.col("no_rag_answer"), F.col("reference"), embed).alias("plain"))
    kinds = (("PR", "precision"), ("RC", "recall"), ("F1", "f1"))
    rows = rows.select("query_id", "answer", "no_rag_answer", "A_RG_L", "A_RG_Lsum", *[F.col(f"rag.{c}").alias(f"A_BERT_RAG_{n}") for n, c in kinds],
                       *[F.col(f"plain.{c}").alias(f"A_BERT_{n}") for n, c in kinds], F.round(F.col("rag.f1") - F.col("plain.f1"), 6).alias("A_BERT_RAG_DELTA_F1"))
    for part in (at.groupBy("query_id").agg(*lists), ranking, *[p.withColumnRenamed("pair_id", "query_id") for p in (bleu, rouge, relevance)]):
        rows = rows.join(part, "query_id", "left")
    return rows
