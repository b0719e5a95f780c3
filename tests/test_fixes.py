"""Byte-exact texts and edge cases, written apart from the library's constants."""

import pytest
from pyspark.sql import functions as F

from ragtable.operators import answer_metrics, bm25, chunking, prompts, qa


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_oracle_prompt_bytes(spark):
    got = one(spark, qa.oracle_prompt(F.lit("x\n  \ny"), F.lit("default"), 2))
    assert got.split("\n")[1:8] == ["            Given the following exerpt of text, generate 2 questions that can be answered by the exerpt of text.",
                                    "            ```", "            x", "", "y", "            ```", ""]
    assert got.endswith("`{QUESTION \\d+}: .+ {ANSWER \\d+}: .+`\n") and got.startswith("You are an oracle system")


def test_citation_v1_bytes():
    text = prompts.first_text("citation_history_v1", "X")
    assert text.startswith("             You are X, a RAG-based chat assistant focused on legal documents from EUR-Lex.             You process")
    assert '"<user_question> Context: <retrieved_sources>", where' in text and text.endswith("it operates in. ")


@pytest.mark.parametrize("name", [*prompts.TEMPLATES, "unknown"])
def test_every_template_renders(spark, name):
    got = one(spark, prompts.render_prompt(name, F.lit("Q{context}"), F.lit("C")))
    assert "{assistant}" not in str(got) and "C" in got[-1]["content"]
    assert name == "" or "Q{context}" in got[-1]["content"]


def test_rouge_lsum_is_a_share(spark):
    rows = spark.createDataFrame([("a", "a\na"), ("a b\nc", "a b\nc"), ("", "x"), ("b a", "a b\nb")], "p string, r string")
    got = [x[0] for x in rows.select(answer_metrics.rouge_lsum("p", "r")).collect()]
    assert got == [pytest.approx(2 / 3, abs=1e-6), 1.0, 0.0, pytest.approx(0.8, abs=1e-6)]


def test_filler_never_lifts_a_matched_chunk(spark):
    chunks = spark.createDataFrame([(1, "a a b"), (2, "a b"), (3, "a b")], "chunk_id long, text string")
    index = bm25.build_index(chunks)
    q = spark.createDataFrame([(1, "a b")], "query_id long, question string")
    plain = bm25.bm25_search(q, index, 2, fill=False).orderBy("rank").select("chunk_id", "score").collect()
    assert bm25.bm25_search(q, index, 2).orderBy("rank").select("chunk_id", "score").collect() == plain


def test_recursive_split_exact():
    cut = chunking.recursive_split_text
    assert cut("aa bb cc dd", [" "], 5, 3) == ["aa bb", "cc", "dd"]
    assert cut("aa bb cc dd", [" "], 6, 3) == ["aa bb", "bb cc", "cc dd"]
    assert cut("aaaaaaaa b", [" "], 4, 0) == ["aaaaaaaa", "b"]
    assert cut("one\n\ntwo three", ["\n\n", " "], 6, 0) == ["one", "two", " three"]  # as long as size, and nothing cuts it
    assert cut("abcdef", [""], 4, 2) == ["abcd", "cdef"]
    assert cut(None, [" "], 4, 0) == [] and cut("", [" "], 4, 0) == []
    assert chunking.character_split_text("a,b,,c,d", ",", 3, 1) == ["a,b", "b,c", "c,d"]
