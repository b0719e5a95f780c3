"""The containment join against ``in`` on small rows."""

import pytest

from ragtable.operators.containment import contains_join


@pytest.mark.parametrize("limit", [2_000_000, 1])
def test_contains_join_brute_force(spark, limit):
    texts = ["the quick brown fox jumps over", "xthe quick brown foxy", "the quick  brown fox", None, "", "a b c d e f g a b c", "quick brown\nfox jumps over it", "lazy dog", "lazy dog", "été à la mer"]
    passages = ["the quick brown fox", "he quick brown fo", "quick brown fox jumps", "fox", "lazy dog", "g a", "a b c", "c d e f g a b", " brown ", "\nfox jumps o", "", None, "none of these words", "té à la m", "zzz",
                "lazy dog", "brown  fox"]
    docs = spark.createDataFrame([(f"d{i}" if i != 8 else "d7", t, 1) for i, t in enumerate(texts)], "doc_id string, text string, pattern int")
    rows = spark.createDataFrame([(f"p{i}" if i != 15 else "p4", p, 2) for i, p in enumerate(passages)], "item_id string, text string, key int")
    want = sorted((f"d{i}" if i != 8 else "d7", f"p{j}" if j != 15 else "p4") for i, t in enumerate(texts) for j, p in enumerate(passages) if t and p and p in t)
    got = contains_join(docs, rows, max_broadcast_rows=limit)
    assert sorted((r.doc_id, r.pattern_id) for r in got.collect()) == want
    assert contains_join(docs.limit(0), rows).count() == 0 and contains_join(docs, rows.limit(0)).count() == 0
