"""Keyphrases of questions and where hits contain them (R-08, R-09).

Candidates are a question's runs of 1 to ``n`` words that neither begin nor end
with a stop word; each is weighted by how often the question has it and how few
texts of the corpus do. Texts are asked only for the candidates: their runs meet
the distinct candidates before anything is shuffled, and a question keeps a
bounded list. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import let, ngrams
from ..plans.sizing import DEFAULT_BROADCAST_ROWS, join_small_side

# English words that do not begin or end a keyphrase.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could did do does doing down during "
    "each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor not of off on once only or other "
    "our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were what when where "
    "which while who whom why will with would you your"
).split()


def phrase_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits of any script; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def phrases(c: Column, n: int) -> Column:
    """All runs of 1 to ``n`` words, repeats included, joined by one space."""
    return let(phrase_tokens(c), lambda t: F.concat(*[ngrams(t, k) for k in range(1, n + 1)]))


def _candidates(c: Column, n: int, stop: list[str]) -> Column:
    ends = F.array(*[F.lit(w) for w in stop])
    return F.filter(phrases(c, n), lambda p: ~F.array_contains(ends, F.substring_index(p, " ", 1)) & ~F.array_contains(ends, F.substring_index(p, " ", -1)))


def keyphrases(questions: DataFrame, corpus: DataFrame, n: int = 2, top: int = 5, id_col: str = "query_id", text_col: str = "question", corpus_text: str = "text",
               stop_words: list[str] | tuple[str, ...] = STOP_WORDS, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """R-08: (query_id, rank, phrase, tf, df, score), the ``top`` best of every question that has any.

    score = tf * ln((texts + 1) / (df + 1)), rounded to 6 decimals also for the
    order, ties by phrase. Null questions and texts have no phrases; a phrase
    that no text holds has df 0.
    """
    asked = questions.select(F.col(id_col).alias("query_id"), F.explode(_candidates(F.col(text_col), n, list(stop_words))).alias("phrase")).groupBy("query_id", "phrase").agg(F.count("*").alias("tf"))
    held = corpus.select(F.explode(F.array_distinct(phrases(F.col(corpus_text), n))).alias("phrase"))
    df = join_small_side(held, asked.select("phrase").distinct(), ["phrase"], max_rows=max_broadcast_rows, salt_source=F.rand(7)).groupBy("phrase").agg(F.count("*").alias("df"))
    size = corpus.agg(F.count("*").alias("texts"))
    scored = asked.join(df, "phrase", "left").crossJoin(F.broadcast(size)).withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    scored = scored.withColumn("score", F.round(F.col("tf") * F.log((F.col("texts") + 1) / (F.col("df") + 1)), 6))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "phrase")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("query_id", "rank", "phrase", "tf", "df", "score")


def occurrences(text: Column, keyword: Column) -> Column:
    """How often ``keyword`` stands in ``text`` without overlaps; 0 for null or empty."""
    cut = F.length(text) - F.length(F.replace(text, keyword, F.lit("")))
    return F.coalesce(F.when(F.length(keyword) > 0, (cut / F.length(keyword)).cast("long")), F.lit(0).cast("long"))


def keyword_hit_matrix(hits: DataFrame, keywords: DataFrame, k: int, text_col: str = "content", keyword_col: str = "phrase", fold: bool = True) -> DataFrame:
    """R-09: one row for each question and keyword, and one for its scores (keyword null); columns hit_1 .. hit_k by rank.

    A keyword's cell is its occurrences in the text of that rank (A-Z and other
    letters folded to lower case with ``fold``), 0 where there is no such hit;
    the score row has the hits' scores, null where there is none. Counts and
    scores come from one grouping over the questions' hits times their keywords,
    both of bounded number; a question without keywords has its score row alone.
    """
    text = F.lower(text_col) if fold else F.col(text_col)
    words = keywords.select("query_id", F.col(keyword_col).alias("keyword")).distinct()
    cells = hits.select("query_id", "rank", "score", text.alias("text")).join(words, "query_id", "left")
    cells = cells.select("query_id", "keyword", "rank", "score", occurrences(F.col("text"), F.col("keyword")).alias("n"))
    is_score = F.grouping("keyword") == 1
    columns = [F.when(is_score, F.max(F.when(F.col("rank") == r, F.col("score")))).otherwise(F.coalesce(F.max(F.when(F.col("rank") == r, F.col("n"))), F.lit(0)).cast("double")).alias(f"hit_{r}")
               for r in range(1, k + 1)]
    out = cells.groupingSets([["query_id", "keyword"], ["query_id"]], "query_id", "keyword").agg(is_score.alias("is_score"), *columns)
    return out.where(F.col("is_score") | F.col("keyword").isNotNull())
