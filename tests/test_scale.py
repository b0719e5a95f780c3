"""Plans and settings that keep work in proportion to the input (findings F2 to F15 of round 3)."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ragtable.functions.embed import Buckets, hashed_embedding, hashed_vectors
from ragtable.operators import bm25
from ragtable.operators import chunking as C
from ragtable.operators import context as X
from ragtable.operators.containment import _runs_of, contains_join
from ragtable.plans import queries_chunking, queries_context, queries_metrics, queries_retrieval
from ragtable.session import ensure_checkpoint_dir


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_chunking_hands_workers_small_batches(spark):
    own = spark.newSession()
    queries_chunking.q_recursive_chunks(own, SF)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "4m"
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    queries_chunking.q_recursive_chunks(own, SF)
    assert own.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "70"


def test_hashing_in_workers_equals_the_expression(spark):
    texts = [None, "", "?!", "One two. TWO three! Kelvin Ärger? one", "a b. " * 5000 + "c d! " * 200 + "end"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select(hashed_vectors(F.col("text")).alias("a"), hashed_embedding(F.col("text")).alias("b")).collect():
        assert r.a == pytest.approx(r.b)
    chunks = df.select("id", C.semantic_split(F.col("text"), 60).alias("c"))
    assert "hashed" in plan(chunks) or "_distances" in plan(chunks)
    short = chunks.where("id < 4").join(df.select("id", C.semantic_split(F.col("text"), 60, embed=lambda w: hashed_embedding(w)).alias("d")).where("id < 4"), "id").collect()
    assert len(short) == 4 and all(r.c == r.d for r in short)
    d = df.where("id = 4").select(C.window_distances(C.sentences(F.col("text"))).alias("d")).first().d
    assert len(d) == 5200 and max(d[:4998]) < 1e-9 and max(d[5003:5198]) < 1e-9 and d[5000] > 1e-3


def corpus(spark):
    rows = [(i, f"common {'half ' * (i % 2)}third{i % 3} word{i // 4} only{i} only{i}") for i in range(40)] + [(7, "common again only7"), (7, "common again only7"), (None, "common"), (50, None)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_postings_do_not_depend_on_how_idf_meets_them(spark, monkeypatch):
    ensure_checkpoint_dir(spark)
    index = bm25.build_index(corpus(spark), id_col="doc_id")
    want = sorted(map(str, index.postings.collect()))
    joined = bm25.build_postings(index.chunks).join(index.terms.select("term", "idf"), "term")
    assert want == sorted(map(str, index._weighted(joined).collect())) and len(want) > 150
    shuffles = [p for p in plan(index.postings).splitlines() if "hashpartitioning(term" in p]
    assert not shuffles  # idf is broadcast, words are counted where their chunk is
    for often in (30, 5, 0):
        monkeypatch.setattr(bm25, "OFTEN", often)
        assert sorted(map(str, index.postings.collect())) == want


def test_search_shuffles_texts_only(spark):
    index = bm25.build_index(corpus(spark), id_col="doc_id")
    asked = spark.createDataFrame([(1, "only7 common half"), (2, "word3 word3 third1"), (3, "")], "query_id int, question string")
    scores = bm25.bm25_scores(asked, index)
    assert "hashpartitioning(chunk_id" in plan(scores) and not [p for p in plan(scores).splitlines() if "hashpartitioning(" in p and "chunk_id" in p and ("term" in p or "query_id#" in p)]
    assert {(r.query_id, r.chunk_id): r.score for r in scores.collect()}.keys() >= {(1, 7), (1, None), (2, 12)}


def test_runs_are_compared_word_by_word(spark):
    docs = spark.createDataFrame([(1, "x one two three four y"), (2, "one two"), (3, None), (4, "xa b cy a b c")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "one two three"), (2, "a b c"), (3, "wo three four y"), (4, "one two three four y z"), (5, "e two three f")], "item_id long, text string")
    got = {tuple(r) for r in contains_join(docs, asked).select("doc_id", "pattern_id").collect()}
    assert got == {(1, 1), (4, 2), (1, 3), (1, 5)}


def test_few_hits_go_to_the_texts(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(3, "again")], "chunk_id long, content string")
    hits = spark.createDataFrame([(1, 1, 3), (1, 2, 9), (2, 1, 99)], "query_id int, rank int, chunk_id long")
    got = X.with_texts(hits.repartition(3), texts.repartition(5))
    assert "SortMergeJoin" not in plan(got) and "BroadcastHashJoin" in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [(3, 1, 1, "again"), (3, 1, 1, "t3"), (9, 1, 2, "t9")]


def test_queries_index_and_look_up_once(spark, monkeypatch):
    made, build = [], bm25.build_index
    monkeypatch.setattr(queries_retrieval.bm25, "build_index", lambda *a, **b: made.append(1) or build(*a, **b))
    queries_context.q_cite(spark, SF)
    assert len(made) == 1
    assert "contains(" not in plan(queries_metrics.q_metric_means(spark, SF)).lower()  # the references are kept, not looked up for each metric


def test_statistics_of_the_index_read_the_chunks_once(spark):
    ensure_checkpoint_dir(spark)
    texts = ["one two  two", None, "", "two\tthree", "two"]
    read = spark.sparkContext.accumulator(0)

    def counting(rows):
        for r in rows:
            read.add(1)
            yield r

    chunks = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), 2).mapPartitions(counting), "chunk_id long, text string")
    terms, stats = bm25.corpus_stats(chunks)
    assert sorted((r.term, r.df) for r in terms.collect()) == [("one", 1), ("three", 1), ("two", 3)]
    assert (stats.first().n_chunks, stats.first().avgdl) == (5, 6 / 5) and read.value == len(texts)
    none, empty = bm25.corpus_stats(chunks.limit(0))
    assert none.count() == 0 and tuple(empty.first()) == (0, None, None, None)


def test_runs_meet_by_their_hashes(spark):
    docs = spark.createDataFrame([(1, " a b\nc"), (2, "a"), (3, ""), (4, None)], "doc_id int, text string")
    runs = _runs_of(docs, 3)
    asked = spark.sql("SELECT xxhash64('a', 'b', 'c') AS h")
    assert [r.doc_id for r in runs.join(asked, "h").collect()] == [1]
    assert "zip" not in plan(runs) and "slice" not in plan(runs)  # no copies of the texts' words


def test_bytes_of_words_are_hashed_as_the_expression_does(spark):
    texts = ["İstanbul Kelvin naïve xéy z a_b-c 7٣", "é", "A\x00b\x1fc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in df.select(hashed_vectors(F.col("text")).alias("a"), hashed_embedding(F.col("text")).alias("b")).collect():
        assert r.a == pytest.approx(r.b)
    assert all(isinstance(t, bytes) for t in _kept(texts))


def _kept(texts):
    buckets = Buckets(64)
    buckets.counts(texts)
    return buckets
