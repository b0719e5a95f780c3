"""Fusion, ordered dedupe, contexts, history, generation and citations (R-05, P-14, A-01..A-10).

Per-question groups here are bounded by the retrieval depth (k hits per
question), so ``collect_list`` per question is bounded; lists are always
``array_sort``-ed on rank because list order after a shuffle is not defined.
Dedupe and fusion aggregate with ``min_by`` (map-side combinable) instead
of a window, so a key repeated across many rows never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import citation_link
from ..plans.sizing import join_small_side
from ..session import cut_lineage
from .prompts import MESSAGE, no_rag_prompt, render_prompt

RRF_C = 60


def rerank(df: DataFrame, order: list[Column], partition: str = "query_id") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(partition).orderBy(*order)))


def fuse(hit_lists: Sequence[DataFrame], weights: Sequence[float], content_col: str = "content",
         c: int = RRF_C) -> DataFrame:
    """R-05: weighted reciprocal-rank fusion, items merged by content.

    Each input is hits(query_id, rank, chunk_id, <content_col>). Output is the
    whole union (not cut to k): (query_id, rank, chunk_id, content, score),
    ranked by score desc, then first appearance (list order, then rank). The
    chunk kept for a content is its first appearance.
    """
    if len(hit_lists) != len(weights):
        raise ValueError("one weight per hit list")
    tagged = None
    for i, (h, w) in enumerate(zip(hit_lists, weights)):
        t = h.select("query_id", "rank", "chunk_id", F.col(content_col).alias("content"),
                     F.lit(i).alias("src"), F.lit(float(w)).alias("w"))
        tagged = t if tagged is None else tagged.unionByName(t)
    pos = F.struct(F.col("src"), F.col("rank"))
    agg = tagged.groupBy("query_id", "content").agg(
        F.round(F.sum(F.col("w") / (F.col("rank") + F.lit(c))), 6).alias("score"),
        F.min_by(F.col("chunk_id"), pos).alias("chunk_id"),
        F.min(pos).alias("first"),
    )
    out = rerank(agg, [F.col("score").desc(), F.col("first.src"), F.col("first.rank")])
    return out.select("query_id", "rank", "chunk_id", "content", "score")


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The hits with the other columns of texts(chunk_id, ...): few hits go to the texts, which are not shuffled."""
    cols = [F.col(c) for c in ("chunk_id", *(c for c in hits.columns if c != "chunk_id"), *(c for c in texts.columns if c != "chunk_id"))]
    return join_small_side(texts, hits, ["chunk_id"]).select(*cols)


def dedupe_ordered(hits: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """P-14: keep the first of equal (content, metadata) items per question, keep order, re-rank."""
    keys = ["query_id", *key_cols]
    others = [c for c in hits.columns if c not in keys and c != "rank"]
    first = hits.groupBy(*keys).agg(
        F.min("rank").alias("_first"),
        *[F.min_by(F.col(c), F.col("rank")).alias(c) for c in others],
    )
    return rerank(first, [F.col("_first")]).drop("_first")


def _ordered(hits: DataFrame, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), value.alias("v")))),
                       lambda x: x["v"])


def append_all(hits: DataFrame, text_col: str = "content", delimiter: str = "\n") -> DataFrame:
    """A-01: (query_id, context) = hit texts in rank order joined by ``delimiter``."""
    return hits.groupBy("query_id").agg(F.array_join(_ordered(hits, F.col(text_col)), delimiter).alias("context"))


def citation_block(doc_id: Column, text: Column, block_quotes: str = "```") -> Column:
    return F.concat(F.lit("Document "), doc_id.cast("string"), F.lit(f":\n{block_quotes}\n"),
                    F.coalesce(text, F.lit("")), F.lit(f"\n{block_quotes}"))


def append_all_citation(hits: DataFrame, id_col: str = "chunk_id", text_col: str = "content",
                        delimiter: str = "\n", block_quotes: str = "```") -> DataFrame:
    """A-02: 'Document <id>:\\n```\\n<text>\\n```' per hit, in rank order, joined by ``delimiter``."""
    block = citation_block(F.col(id_col), F.col(text_col), block_quotes)
    return hits.groupBy("query_id").agg(F.array_join(_ordered(hits, block), delimiter).alias("context"))


def history_window(conversations: DataFrame, k: int, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A-04: the last k exchanges (last 2k messages) per conversation, rows oldest first.

    ``row_number() <= 2k`` plans as a partial WindowGroupLimit, so even a very
    long conversation ships only 2k rows per map task.
    """
    w = Window.partitionBy(conv).orderBy(F.col(turn).desc())
    return conversations.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2 * k).drop("_r")


def history_messages(window: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                     text: str = "text") -> DataFrame:
    """(conv_id, history array<struct<role,content>>) oldest first, from a bounded window."""
    msg = F.struct(F.col(turn).alias("t"), F.struct(F.col(role).alias("role"), F.col(text).alias("content")).alias("m"))
    return window.groupBy(conv).agg(F.transform(F.array_sort(F.collect_list(msg)), lambda x: x["m"]).alias("history"))


def reset_history(conversations: DataFrame, is_reset: Column, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """A-05: drop messages at or before the last reset point of each conversation.

    The reset turn is a grouped max (map-side combined), joined back by key.
    """
    last = conversations.filter(is_reset).groupBy(conv).agg(F.max(turn).alias("_reset"))
    return (conversations.join(last, conv, "left")
            .filter(F.col("_reset").isNull() | (F.col(turn) > F.col("_reset"))).drop("_reset"))


def passthrough_model(messages: Column) -> Column:
    """A-06 default model: the content of the last message."""
    return F.element_at(messages, -1)["content"]


def generate(df: DataFrame, messages_col: str, out: str = "model_output",
             model: Callable[[], Callable[[list[list[dict]]], list[str]]] | None = None) -> DataFrame:
    """A-06: batch inference over a prompt table.

    ``model`` is a factory returning ``fn(list of message lists) -> list of strings``;
    it is built once per task and fed Arrow batches through ``mapInPandas``.
    Without a model the passthrough answer is a plain column expression.
    """
    if model is None:
        return df.withColumn(out, passthrough_model(F.col(messages_col)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = model()
        for pdf in batches:
            msgs = [[{"role": m["role"], "content": m["content"]} for m in row] for row in pdf[messages_col]]
            pdf[out] = fn(msgs)
            yield pdf

    return df.mapInPandas(run, schema)


def parse_output(c: Column) -> Column:
    """A-07: identity to string."""
    return c.cast("string")


def cite_sources(answers: DataFrame, hits: DataFrame, answer_col: str = "answer",
                 id_col: str = "chunk_id") -> DataFrame:
    """A-08: append '\\n\\nSources:' and one '\\n- <link>' per cited source.

    A hit is cited when its full id occurs in the answer; the source is the id
    text before the first '_'; sources are distinct and sorted (the source's
    set order is not defined). Answers citing nothing are unchanged.
    """
    h = hits.select("query_id", F.col(id_col).cast("string").alias("_id"))
    a = answers.join(h, "query_id", "left")
    cited = a.filter(F.col("_id").isNotNull() & F.contains(F.col(answer_col), F.col("_id")))
    srcs = cited.groupBy("query_id").agg(
        F.array_sort(F.collect_set(F.substring_index(F.col("_id"), "_", 1))).alias("_srcs"))
    out = answers.join(srcs, "query_id", "left")
    links = F.array_join(F.transform(F.col("_srcs"), lambda s: F.concat(F.lit("\n- "), citation_link(s))), "")
    return out.withColumn(
        answer_col,
        F.when(F.coalesce(F.size("_srcs"), F.lit(0)) > 0, F.concat(F.col(answer_col), F.lit("\n\nSources:"), links))
        .otherwise(F.col(answer_col)),
    ).drop("_srcs")


def answer_batch(questions: DataFrame, hits: DataFrame, texts: DataFrame, template: str = "citation_history_v1",
                 citation: bool = True, history: DataFrame | None = None, model=None) -> DataFrame:
    """A-10: retrieve -> dedupe -> context -> prompt -> generate -> parse -> cite, one plan per question table.

    questions(query_id, question); hits(query_id, rank, chunk_id); texts(chunk_id, content);
    history (optional) (query_id, history array<struct<role,content>>).
    """
    h = cut_lineage(with_texts(hits.select("query_id", "rank", "chunk_id"), texts))  # read for the context and for the sources
    h = dedupe_ordered(h, ["content"])
    ctx = append_all_citation(h) if citation else append_all(h)
    q = questions.join(ctx, "query_id", "left")
    if history is not None:
        q = q.join(history, "query_id", "left")
    hist = F.col("history") if history is not None else F.lit(None).cast(f"array<{MESSAGE}>")
    q = q.withColumn("prompt", render_prompt(template, F.col("question"), F.coalesce(F.col("context"), F.lit("")), hist))
    q = generate(q, "prompt", "model_output", model)
    q = q.withColumn("answer", parse_output(F.col("model_output")))
    q = q.withColumn("no_rag_prompt", no_rag_prompt(template, F.col("question")))
    q = generate(q, "no_rag_prompt", "no_rag_answer", model)
    return cite_sources(q, h, "answer")
