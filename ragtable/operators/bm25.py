"""Okapi BM25 as an inverted-index join (R-01..R-04, R-07).

Index build (a pass over the chunks for the lengths and df(term), kept in the
checkpoint folder): a one-row corpus_stats (N, avgdl, avg_idf),
  postings(term, chunk_id, tf, dl) by a groupBy over chunks dealt by chunk id, so that the
  texts are shuffled and not their words, which are counted and summed where the chunk is,
  and the per-posting weight ``w = idf * tf*(k1+1) / (tf + k1*(1-b+b*dl/avgdl))``.
Idf meets all postings without a shuffle of most of them: the ``OFTEN`` most frequent terms are broadcast,
a term of one chunk has the idf of all such, and only postings of the terms between are joined by a shuffle.

Query time: the chunks' words meet the query terms before they are counted, so
only postings of those are built; they equi-join the terms (with repeat counts)
on ``term`` and are summed per (query, chunk). The question table is broadcast when a bounded count proves it small,
otherwise the join is salted on chunk id so very common terms do not pile into
one task. Top-k uses ``row_number() <= k`` which Catalyst plans as a partial
WindowGroupLimit before the shuffle, so a query matching millions of chunks
ships only k rows per map partition.

Idf as in the Okapi variant: ``idf = ln(N-df+0.5) - ln(df+0.5)``; every
negative idf becomes ``epsilon * mean(idf over the whole vocabulary)``, the
mean taken before flooring. Scores are rounded to 6 decimals, also inside the
ranking order, so engines that sum in another order rank the same way; ties
break on ``chunk_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import whitespace_tokens
from ..plans.sizing import DEFAULT_BROADCAST_ROWS, DEFAULT_SALT, join_small_side
from ..session import cut_lineage

K1, B, EPSILON = 1.5, 0.75, 0.25
#: terms that are broadcast with their idf, and words that a task counts
OFTEN = 500_000
TASK_WORDS = 2_000_000


@dataclass
class BM25Index:
    chunks: DataFrame  # chunk_id, text
    stats: DataFrame  # one row: n_chunks, avgdl, avg_idf, eps_idf
    terms: DataFrame  # term, df, idf (floored)
    avgdl: float | None  # of that row; None without chunks
    k1: float = K1
    b: float = B
    epsilon: float = EPSILON
    salt: int = DEFAULT_SALT
    tasks: int | None = None  # tasks that chunks are dealt to by id; None: as many as shuffles have

    @property
    def chunk_ids(self) -> DataFrame:
        return self.chunks.select("chunk_id")

    @property
    def postings(self) -> DataFrame:
        """(term, chunk_id, tf, dl, w) of all terms."""
        words = chunk_words(self.chunks, self.tasks)
        heights = self.terms.groupBy(F.floor(F.log2("df")).cast("int").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min_by("idf", "df").alias("idf")).collect()
        least = min((h for h in range(64) if sum(r["n"] for r in heights if r["h"] >= h) <= OFTEN), default=64)
        often = F.broadcast(self.terms.where(F.col("df") >= 2 ** least).select("term", "idf"))
        out = counted(words.join(often, "term"), "idf")
        if least:  # words of less than 2 ** least chunks: no term of them is hot
            rest = counted(words.join(often.select("term"), "term", "left_anti"))
            once = F.lit(next((r["idf"] for r in heights if r["h"] == 0), None)).cast("double")
            if least > 1:
                rare = self.terms.where((F.col("df") > 1) & (F.col("df") < 2 ** least)).select("term", "idf")
                rest = rest.join(rare, "term", "left").withColumn("idf", F.coalesce("idf", once))
            else:
                rest = rest.withColumn("idf", once)
            out = out.unionByName(rest)
        return self._weighted(out)

    def postings_of(self, asked: DataFrame, max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
        """The postings of the terms in ``asked`` (term, other columns), with those columns; words of other terms are dropped before any shuffle."""
        known = cut_lineage(join_small_side(self.terms.select("term", "idf"), asked, ["term"], max_rows=max_broadcast_rows, salt=self.salt))
        words = chunk_words(self.chunks, self.tasks)
        kept = join_small_side(words, known.select("term", "idf").distinct(), ["term"], max_rows=max_broadcast_rows, salt=self.salt, salt_source=F.xxhash64("chunk_id"))
        # weighted before they are repeated for each question
        return join_small_side(self._weighted(counted(kept, "idf")), known.drop("idf"), ["term"], max_rows=max_broadcast_rows, salt=self.salt, salt_source=F.xxhash64("chunk_id"))

    def _weighted(self, postings: DataFrame) -> DataFrame:
        w = (F.col("idf") * (F.col("tf") * F.lit(self.k1 + 1.0))
             / (F.col("tf") + F.lit(self.k1) * (F.lit(1.0 - self.b) + F.lit(self.b) * F.col("dl") / F.lit(self.avgdl).cast("double"))))
        return postings.withColumn("w", w).drop("idf")


def fill_null_content(df: DataFrame, text_col: str = "text") -> DataFrame:
    """R-07: null page text becomes '' before indexing."""
    return df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))


def tokenize_chunks(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    return chunks.select(
        F.col(id_col).alias("chunk_id"), whitespace_tokens(F.col(text_col)).alias("tokens")
    )


def chunk_words(chunks: DataFrame, tasks: int | None = None, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, dl, term), a row for each word; chunks are dealt by id, so that no grouping with the id shuffles again.

    ``dl`` rides along the explode, so no join back to a chunk-length table.
    """
    chunks = chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text"))
    dealt = chunks.repartition(tasks, "chunk_id") if tasks else chunks.repartition("chunk_id")
    return tokenize_chunks(dealt).select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))


def counted(words: DataFrame, *others: str) -> DataFrame:
    return words.groupBy("term", "chunk_id", "dl", *others).agg(F.count(F.lit(1)).alias("tf"))


def build_postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """R-01: postings(term, chunk_id, tf, dl); whitespace tokens, case kept."""
    return counted(chunk_words(chunks, None, id_col, text_col))


def chunk_lengths(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    return tokenize_chunks(chunks, id_col, text_col).select("chunk_id", F.size("tokens").alias("dl"))


def corpus_stats(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                 epsilon: float = EPSILON) -> tuple[DataFrame, DataFrame]:
    """R-02: (terms(term, df, idf), stats(n_chunks, avgdl, avg_idf, eps_idf)).

    Both statistics are one aggregation (partial aggregation on the map side), in which
    the null term counts the chunks and their words; it is kept in the shared checkpoint
    folder, so that the chunks are read once for it whatever is asked of the index later; the
    one-row stats frame is the only thing cross-joined.
    """
    toks = tokenize_chunks(chunks, id_col, text_col)
    each = toks.select(F.size("tokens").alias("dl"), F.explode(F.array_append(F.array_distinct("tokens"), F.lit(None).cast("string"))).alias("term"))
    sums = cut_lineage(each.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum(F.when(F.col("term").isNull(), F.col("dl"))).alias("words")))
    base = sums.where("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n_chunks"), (F.sum("words") / F.sum("df")).alias("avgdl"))
    df_t = sums.where("term IS NOT NULL").select("term", "df")
    raw = df_t.crossJoin(F.broadcast(base)).select(
        "term", "df",
        (F.log(F.col("n_chunks") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf_raw"),
    )
    avg = raw.agg(F.avg("idf_raw").alias("avg_idf"))
    stats = cut_lineage(base.crossJoin(avg).withColumn("eps_idf", F.lit(epsilon) * F.col("avg_idf")))
    terms = raw.crossJoin(F.broadcast(stats.select("eps_idf"))).select(
        "term", "df", F.when(F.col("idf_raw") < 0, F.col("eps_idf")).otherwise(F.col("idf_raw")).alias("idf")
    )
    return terms, stats


def build_index(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                k1: float = K1, b: float = B, epsilon: float = EPSILON, salt: int = DEFAULT_SALT) -> BM25Index:
    chunks = fill_null_content(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")))
    terms, stats = corpus_stats(chunks, epsilon=epsilon)
    size = stats.first()
    shuffles = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(shuffles, int(size["n_chunks"] * (size["avgdl"] or 0) // TASK_WORDS))
    return BM25Index(chunks, stats, terms, size["avgdl"], k1, b, epsilon, salt, tasks)


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "question") -> DataFrame:
    """(query_id, term, qtf): a query token repeated n times counts n times."""
    return (
        queries.select(F.col(id_col).alias("query_id"), F.explode(whitespace_tokens(F.col(text_col))).alias("term"))
        .groupBy("query_id", "term")
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def bm25_scores(queries: DataFrame, index: BM25Index, id_col: str = "query_id", text_col: str = "question",
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """R-03: (query_id, chunk_id, score) for every chunk sharing at least one term."""
    joined = index.postings_of(cut_lineage(query_terms(queries, id_col, text_col)), max_broadcast_rows)
    return joined.groupBy("query_id", "chunk_id").agg(
        F.round(F.sum(F.col("qtf") * F.col("w")), 6).alias("score")
    )


def top_k(scores: DataFrame, k: int, partition: str = "query_id", order_desc: str = "score",
          tie: str = "chunk_id") -> DataFrame:
    """R-04: best k rows per query, rank 1..k, ties broken by ``chunk_id``."""
    w = Window.partitionBy(partition).orderBy(F.col(order_desc).desc(), F.col(tie).asc())
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def bm25_search(queries: DataFrame, index: BM25Index, k: int, id_col: str = "query_id",
                text_col: str = "question", fill: bool = True,
                max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """hits(query_id, rank, chunk_id, score), k per query.

    Like the Okapi retriever, a query with fewer than k matching chunks is
    filled with score-0 chunks; the filler is the k smallest chunk ids (a
    bounded k-row set), taken only where the query has room left.
    """
    scores = bm25_scores(queries, index, id_col, text_col, max_broadcast_rows)
    scored = cut_lineage(top_k(scores, k).drop("rank"))  # k rows a query, read several times below
    if not fill:
        return top_k(scored, k)
    # Only queries short of k matches are padded, so all their matches are in ``scored``; of the k + k smallest
    # chunk ids at least k do not match. Matched chunks keep their own scores, also negative ones.
    filler = [r[0] for r in index.chunk_ids.orderBy("chunk_id").limit(2 * k).collect()]
    if not filler:
        return top_k(scored, k).select("query_id", "rank", "chunk_id", "score")
    matched = scored.groupBy("query_id").agg(F.count("*").alias("n"))
    short = (queries.select(F.col(id_col).alias("query_id")).join(matched, "query_id", "left")
             .where(F.coalesce("n", F.lit(0)) < k).select("query_id"))
    pad = (short.select("query_id", F.explode(F.array(*[F.lit(c) for c in filler])).alias("chunk_id"))
           .join(scored.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("score", F.lit(0.0)))
    return top_k(scored.unionByName(pad), k).select("query_id", "rank", "chunk_id", "score")


def metadata_filter(chunks: DataFrame, predicate, limit: int | None = None) -> DataFrame:
    """R-06: keep chunks whose typed metadata satisfy ``predicate`` (a Column or SQL string), optionally
    at most ``limit`` of them, *before* scoring. A predicate on columns of a parquet source is pushed
    into the scan (PushedFilters), so filtered-out chunks are never read."""
    out = chunks.filter(F.expr(predicate) if isinstance(predicate, str) else predicate)
    return out.limit(limit) if limit is not None else out
