"""Chunking, BM25, kNN, fusion and context goldens."""

import pytest
from pyspark.sql import functions as F

from ragtable.operators import bm25, chunking as C, context as X, vectors as V

TEXTS = [
    "This is a test document",
    "The quick brown fox jumps over the lazy dog",
    "May the coffee kick in before reality does",
    "I am not lazy, I am on energy saving mode",
    "Time to get creative",
    "https://www.twitch.tv/wirtual",
    "Maybe this is enough documents",
]


def arr(spark, col):
    return spark.range(1).select(col.alias("v")).collect()[0]["v"]


def test_character_windows(spark):
    assert arr(spark, C.character_windows(F.lit("AAAAABBBBCCCCDDDD"), 5, 1)) == ["AAAAA", "ABBBB", "BCCCC", "CDDDD"]


def test_recursive_one_word(spark):
    # oversized pieces are emitted as split, separator kept at the start (the reference golden)
    words = ["This", " is", " a", " test", " document"]
    assert arr(spark, C.recursive_split(F.lit("This is a test document"), 1, 0, [" "])) == words
    assert C.recursive_split_text("This is a test document", [" "], 1, 0) == words


def test_recursive_invariants():
    text = " ".join(f"word{i}" for i in range(300))
    chunks = C.recursive_split_text(text, [" "], 50, 10)
    assert all(len(c) <= 50 for c in chunks)
    assert set(" ".join(chunks).split()) == set(text.split())


def test_token_windows(spark):
    assert arr(spark, C.token_windows(F.lit("This is a test document"), 1, 0)) == ["This", "is", "a", "test", "document"]
    assert arr(spark, C.token_windows(F.lit("a b c d e"), 2, 1)) == ["a b", "b c", "c d", "d e"]


def test_boundary_split_count(spark):
    text = ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 12)[:633]
    assert len(text) == 633
    assert len(arr(spark, C.boundary_split(F.lit(text), 15, 7, [" "]))) >= 42


def test_semantic_split(spark):
    text = "Energy law is complex. It covers many rules! Does it apply? Yes it does. The end."
    assert len(arr(spark, C.semantic_split(F.lit(text), 40.0))) >= 1
    assert arr(spark, C.semantic_split(F.lit("One sentence only"), 95.0)) == ["One sentence only"]


def test_start_indices(spark):
    assert arr(spark, C.start_indices(F.lit("ab ab cd"), F.array(F.lit("ab"), F.lit("ab"), F.lit("zz"))) ) == [0, 3, -1]


def test_chunk_ids_across_documents(spark):
    df = spark.createDataFrame([("doc1", "First sentence. Second sentence."), ("doc2", "A. B.")], "doc_key string, text string")
    ch = C.split_documents(df, F.split(F.col("text"), r"\. "), keep=["doc_key"])
    ch = C.assign_chunk_ids(ch, "doc_key")
    rows = sorted((r["doc_key"], r["chunk_index"], r["chunk_id"]) for r in ch.collect())
    assert rows == [("doc1", 0, 0), ("doc1", 1, 1), ("doc2", 0, 2), ("doc2", 1, 3)]


def _chunks(spark, texts=TEXTS):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "chunk_id long, text string")


def test_bm25_exact_title_first(spark):
    idx = bm25.build_index(_chunks(spark))
    q = spark.createDataFrame([(1, "Time to get creative")], "query_id long, question string")
    hits = bm25.bm25_search(q, idx, 2).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == 5
    assert hits[0]["score"] == pytest.approx(6.900410, abs=1e-6)
    assert len(hits) == 2


def test_bm25_zero_fill(spark):
    idx = bm25.build_index(_chunks(spark))
    q = spark.createDataFrame([(1, "nothing matches here zzz")], "query_id long, question string")
    hits = bm25.bm25_search(q, idx, 3).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == [1, 2, 3] and all(h["score"] == 0.0 for h in hits)


def test_knn_coffee(spark):
    vecs = V.build_vector_table(_chunks(spark))
    q = V.embed_column(spark.createDataFrame([(1, "coffee")], "query_id long, q string"), "q")
    hits = V.knn(q, vecs, 5).orderBy("rank").collect()
    assert len(hits) == 5 and hits[0]["chunk_id"] == 3


def test_ensemble(spark):
    docs = _chunks(spark, ["This is a test document", "This is another test document",
                           "May the coffee kick in before reality does"])
    texts = docs.select("chunk_id", F.col("text").alias("content"))
    q = spark.createDataFrame([(1, "test document")], "query_id long, question string")
    b = bm25.bm25_search(q, bm25.build_index(docs), 2).join(texts, "chunk_id")
    k = V.knn(V.embed_column(q, "question"), V.build_vector_table(docs), 2).join(texts, "chunk_id")
    fused = X.fuse([b, k], [0.5, 0.5]).orderBy("rank").collect()
    assert len(fused) == 2
    assert {r["content"] for r in fused} == {"This is a test document", "This is another test document"}


def test_contexts(spark):
    hits = spark.createDataFrame([(1, 2, "B_source", "b"), (1, 1, "A_source", "a"), (1, 3, "C_source", "c")],
                                 "query_id long, rank int, chunk_id string, content string")
    assert X.append_all(hits).collect()[0]["context"] == "a\nb\nc"
    assert X.append_all(hits, delimiter=" ").collect()[0]["context"] == "a b c"
    got = X.append_all_citation(hits).collect()[0]["context"]
    assert got == "\n".join(f"Document {i}:\n```\n{t}\n```" for i, t in
                            (("A_source", "a"), ("B_source", "b"), ("C_source", "c")))
    got = X.append_all_citation(hits, delimiter=" ", block_quotes='"').collect()[0]["context"]
    assert got.startswith('Document A_source:\n"\na\n"')


def test_dedupe_ordered(spark):
    hits = spark.createDataFrame([(1, 1, 10, "Page 1"), (1, 2, 11, "Page 2"), (1, 3, 12, "Page 3"), (1, 4, 13, "Page 1")],
                                 "query_id long, rank int, chunk_id long, content string")
    rows = X.dedupe_ordered(hits, ["content"]).orderBy("rank").collect()
    assert [(r["rank"], r["content"]) for r in rows] == [(1, "Page 1"), (2, "Page 2"), (3, "Page 3")]


def test_history_and_cite(spark):
    conv = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "q"),
                                  (1, 3, "assistant", "a"), (1, 4, "user", "q2")], "conv_id long, turn long, role string, text string")
    w = X.history_messages(X.history_window(conv, 2)).collect()[0]["history"]
    assert [m["content"] for m in w] == ["hello", "q", "a", "q2"]
    ans = spark.createDataFrame([(1, "see 32013R0666_4 and more")], "query_id long, answer string")
    hits = spark.createDataFrame([(1, 1, "32013R0666_4"), (1, 2, "21975A1201_0")], "query_id long, rank int, chunk_id string")
    out = X.cite_sources(ans, hits).collect()[0]["answer"]
    assert out == "see 32013R0666_4 and more\n\nSources:\n- https://eur-lex.europa.eu/legal-content/EN/TXT/?uri=CELEX:32013R0666"
    none = X.cite_sources(spark.createDataFrame([(1, "nothing")], "query_id long, answer string"), hits).collect()[0]
    assert none["answer"] == "nothing"


def test_answer_batch_passthrough(spark):
    q = spark.createDataFrame([(1, "What is energy?")], "query_id long, question string")
    hits = spark.createDataFrame([(1, 1, 7)], "query_id long, rank int, chunk_id long")
    texts = spark.createDataFrame([(7, "Energy is power.")], "chunk_id long, content string")
    row = X.answer_batch(q, hits, texts, "simple_v1", citation=False).collect()[0]
    assert row["answer"].startswith("Answer the question based only on the following context")
    mocked = X.answer_batch(q, hits, texts, model=lambda: (lambda msgs: ["Hello There!"] * len(msgs))).collect()[0]
    assert mocked["answer"].startswith("Hello There!")


def test_retrieve_dispatch(spark):
    from ragtable.plans.retrieve import resolve_max_k, retrieve

    docs = _chunks(spark)
    q = spark.createDataFrame([(1, "Time to get creative")], "query_id long, question string")
    cfg = {"retriever": "ensemble", "retriever_args": {
        "retriever_weights": [0.5, 0.5],
        "retrievers": [{"retriever": "BM25", "retriever_args": {"k_retrieved_documents": 2,
                                                                 "BM25_params": {"k1": 1.5, "b": 0.75, "epsilon": 0.25}}},
                       {"retriever": "FAISS", "retriever_args": {"k_retrieved_documents": 3}}]}}
    hits = retrieve(q, docs, cfg).orderBy("rank").collect()
    assert hits[0]["chunk_id"] == 5
    assert resolve_max_k(cfg) == 3
    with pytest.raises(ValueError):
        retrieve(q, docs, {"retriever": "BM25_retriever"})


def test_window_distances_equal_embedded_windows(spark):
    from ragtable.functions.embed import hashed_embedding

    texts = ["", "One. Two three? Four five six! one two.", "no end", None, "A. A. A.", "... !!! ???  x. \n y. é ü. z", "w " * 3000 + ". b. " + "c d. " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    s = C.sentences(F.col("text"))
    got = df.select(C.window_distances(s).alias("a"), C.consecutive_distances(F.transform(C.sentence_windows(s), lambda w: hashed_embedding(w))).alias("b"),
                    C.semantic_split(F.col("text"), 60).alias("c"), C.semantic_split(F.col("text"), 60, embed=lambda w: hashed_embedding(w)).alias("d")).collect()
    for r in got:
        assert len(r.a) == len(r.b) and all(abs(x - y) < 1e-9 for x, y in zip(r.a, r.b))
        assert r.c == r.d


def test_chunk_ids_of_a_document_spread_over_tasks(spark):
    rows = [("a", 0, "x"), *(("b", i, str(i)) for i in range(7)), ("c", 0, "y"), ("c", 1, "z")]
    chunks = spark.createDataFrame(rows, "doc_key string, chunk_index int, chunk_text string")
    got = {(r.doc_key, r.chunk_index): r.chunk_id for r in C.assign_chunk_ids(chunks, "doc_key", per_task=2).collect()}
    assert got == {(d, i): n for n, (d, i, _) in enumerate(rows)}
    assert C.assign_chunk_ids(chunks, "doc_key", per_task=2).columns == ["doc_key", "chunk_index", "chunk_text", "chunk_id"]


def test_start_indices_of_a_long_text(spark):
    text = "é" + "word " * 40000
    parts = ["word"] * 40000
    df = spark.createDataFrame([(1, text, parts), (2, None, ["a"]), (3, "ab", []), (4, "ab", None)], "id int, text string, chunks array<string>")
    got = {r.id: r.at for r in df.select("id", C.start_indices(F.col("text"), F.col("chunks")).alias("at")).collect()}
    assert got[1] == [1 + 5 * i for i in range(40000)] and got[2] is None and got[3] == [] and got[4] is None
