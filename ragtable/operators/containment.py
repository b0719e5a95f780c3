"""Verbatim containment join: which documents contain which passages.

Used to derive relevance judgements (qrels) from the given tables: a question
is relevant to every document whose text contains it verbatim.

A passage that stands in a text brings its inner words along whole: only its
first and last may be cut out of longer words. So a passage's runs of up to
``RUN`` inner words are keys that every text containing it has. The runs of the
texts meet the passages' keys before anything is shuffled and are counted; the
rarest key of each passage names the texts that may contain it, and those alone
are compared, letter by letter. Passages of one or two words have no inner
word; they are compared with each text in blocks of ``BLOCK`` passages.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import let, ngrams
from ..plans.sizing import DEFAULT_BROADCAST_ROWS, join_small_side
from ..session import cut_lineage

RUN = 3
BLOCK = 256


def _pieces(text: Column) -> Column:
    return F.split(text, r"\s+")


def _inner_runs(text: Column) -> Column:
    """Runs of RUN inner words (or all, if fewer); none for under three words."""

    def runs(words):
        inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
        return let(inner, lambda w: F.when(F.size(w) >= RUN, ngrams(w, RUN)).when(F.size(w) > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>")))

    return let(_pieces(text), runs)


def _runs_of(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, h): the hash of each run of n words of each text; the last ones of a text, of fewer words, are hashed as they are."""
    cut = docs.select("doc_id", _pieces(F.col("text")).alias("w"))
    return cut.select("doc_id", "w", F.posexplode("w").alias("i", "w0")).select("doc_id", F.xxhash64("w0", *[F.get("w", F.col("i") + j) for j in range(1, n)]).alias("h"))


def contains_join(docs: DataFrame, patterns: DataFrame, doc_id: str = "doc_id", doc_text: str = "text",
                  pattern_id: str = "item_id", pattern_text: str = "text",
                  max_broadcast_rows: int = DEFAULT_BROADCAST_ROWS) -> DataFrame:
    """(doc_id, pattern_id) for every document whose text contains the pattern text; ids keep their types.

    Null or empty patterns are in no document, null texts contain nothing, and
    rows that repeat are found as often as they stand there.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    p = patterns.select(F.col(pattern_id).alias("pattern_id"), F.col(pattern_text).alias("pattern")).where(F.col("pattern") != "")
    keys = p.select("pattern_id", "pattern", F.explode(F.array_distinct(_inner_runs(F.col("pattern")))).alias("key"))
    asked = keys.select("key").distinct()
    lengths = sorted(r[0] for r in asked.select(F.size(F.split("key", " "))).distinct().collect())  # RUN numbers at most
    # a pass over all texts for each length, in which runs meet by their hashes: one in common by chance names a text more to compare;
    # what the pass finds is kept, as it is counted first and looked up then
    parts = []
    for n in lengths or [RUN]:
        of_n = asked.select("key", F.split("key", " ").alias("k")).where(F.size("k") == n).select("key", F.xxhash64(*[F.get("k", F.lit(i)) for i in range(n)]).alias("h"))
        parts.append(join_small_side(_runs_of(d, n), of_n, ["h"], max_rows=max_broadcast_rows, salt_source=F.xxhash64("doc_id")).select("doc_id", "key"))
    met = cut_lineage(reduce(DataFrame.unionByName, parts).distinct())
    counted = met.groupBy("key").agg(F.count("*").alias("n"))
    # a passage with a key that no text has is in none; min_by keeps one key for each
    rated = keys.join(counted, "key", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    chosen = cut_lineage(rated.groupBy("pattern_id", "pattern").agg(F.min_by("key", F.struct("n", "key")).alias("key"), F.min("n").alias("n")).where("n > 0").drop("n"))
    # pairs carry the passage from here on, so no join on texts follows but the one with the documents' own rows
    named = join_small_side(met, chosen, ["key"], max_rows=max_broadcast_rows, salt_source=F.xxhash64("doc_id")).select("doc_id", "pattern_id", "pattern")
    pairs = cut_lineage(named.distinct().join(p.groupBy("pattern_id", "pattern").agg(F.count("*").alias("times")), ["pattern_id", "pattern"]))
    long = (join_small_side(d, pairs, ["doc_id"], max_rows=max_broadcast_rows, salt_source=F.xxhash64("text")).where(F.contains("text", "pattern"))
            .select("doc_id", "pattern_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_")).drop("_"))
    short = p.where(F.size(_inner_runs(F.col("pattern"))) == 0)
    n_short = short.count()
    if not n_short:
        return long
    # each text is repeated for every block, and compared with the block's passages where it is
    n_blocks = -(-n_short // BLOCK)
    blocks = short.groupBy(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(n_blocks)).cast("int").alias("b")).agg(F.collect_list(F.struct("pattern_id", "pattern")).alias("block"))
    dealt = d.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = join_small_side(dealt, blocks, ["b"], max_rows=max_broadcast_rows // BLOCK, salt_source=F.xxhash64("doc_id")).select("doc_id", F.explode(F.filter("block", lambda x: F.contains(F.col("text"), x["pattern"]))).alias("hit")).select("doc_id", "hit.pattern_id")
    return long.unionByName(found)


def verbatim_qrels(documents: DataFrame, questions: DataFrame, query_id: str = "item_id",
                   question_text: str = "text") -> DataFrame:
    """qrels(query_id, chunk_id): documents containing the question text verbatim."""
    return contains_join(documents, questions, pattern_id=query_id, pattern_text=question_text).select(
        F.col("pattern_id").alias("query_id"), F.col("doc_id").alias("chunk_id")
    )
