"""Golden retrieval metrics (reference unit tests + hand-computed cases)."""

import importlib
import math

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ragtable.operators import answer_metrics, leaderboard
from ragtable.operators.metrics import metrics_at_k, ranking_metrics


def _run(spark, refs, cands, max_k):
    hits = spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(cands)], "query_id long, rank int, chunk_id string")
    qrels = spark.createDataFrame([(1, r) for r in refs], "query_id long, chunk_id string")
    qs = spark.createDataFrame([(1,)], "query_id long")
    at = {r["k"]: r for r in metrics_at_k(hits, qrels, qs, max_k).collect()}
    rk = ranking_metrics(hits, qrels, qs, max_k).collect()[0]
    return at, rk


@pytest.mark.parametrize("refs,cands,max_k,recall", [
    (["1", "2"], ["1", "2"], 2, [0.5, 1.0]),
    (["1", "2"], ["1"], 1, [0.5]),
    (["1", "2"], ["1", "3"], 1, [0.5]),
    (["1", "2"], ["3"], 1, [0.0]),
])
def test_recall(spark, refs, cands, max_k, recall):
    at, _ = _run(spark, refs, cands, max_k)
    assert [at[k]["recall"] for k in range(1, max_k + 1)] == pytest.approx(recall, abs=1e-4)


@pytest.mark.parametrize("refs,cands,max_k,precision", [
    (["1", "2"], ["1", "2"], 1, [1.0]),
    (["1", "2"], ["1"], 1, [1.0]),
    (["1", "2"], ["1", "3"], 2, [1.0, 0.5]),
    (["1", "2"], ["3"], 1, [0.0]),
])
def test_precision(spark, refs, cands, max_k, precision):
    at, _ = _run(spark, refs, cands, max_k)
    assert [at[k]["precision"] for k in range(1, max_k + 1)] == pytest.approx(precision, abs=1e-4)


@pytest.mark.parametrize("refs,cands,max_k,f1", [
    (["1", "2"], ["1", "2"], 2, [0.6667, 1.0]),
    (["1", "2"], ["1"], 1, [0.6667]),
    (["1", "2"], ["1", "3"], 2, [0.6667, 0.5]),
    (["1", "2"], ["3"], 1, [0.0]),
])
def test_f1(spark, refs, cands, max_k, f1):
    at, _ = _run(spark, refs, cands, max_k)
    assert [at[k]["f1"] for k in range(1, max_k + 1)] == pytest.approx(f1, abs=1e-4)


def test_repeated_candidate(spark):
    at, rk = _run(spark, ["B"], ["A", "B", "B"], 3)
    assert rk["rr"] == pytest.approx(0.5)
    assert [at[k]["recall"] for k in (1, 2, 3)] == [0.0, 1.0, 1.0]
    assert [at[k]["precision"] for k in (1, 2, 3)] == pytest.approx([0, 0.5, 0.3333], abs=1e-4)
    assert [at[k]["ap"] for k in (1, 2, 3)] == pytest.approx([0, 0.5, 0.8333], abs=1e-4)
    assert rk["cg"] == 2
    assert rk["dcg"] == pytest.approx(1.1309, abs=1e-4)
    assert rk["idcg"] == 0.0 and rk["ndcg"] == 0.0


def test_ndcg_first_hit(spark):
    _, rk = _run(spark, ["B"], ["B", "A"], 2)
    assert rk["dcg"] == pytest.approx(1.0) and rk["ndcg"] == pytest.approx(1.0)
    assert rk["ndcg_standard"] == pytest.approx(1.0)


def test_no_hits_no_refs(spark):
    hits = spark.createDataFrame([], "query_id long, rank int, chunk_id string")
    qrels = spark.createDataFrame([], "query_id long, chunk_id string")
    qs = spark.createDataFrame([(7,)], "query_id long")
    rows = metrics_at_k(hits, qrels, qs, 2).collect()
    assert len(rows) == 2 and all(r["recall"] == 0 and r["precision"] == 0 and r["ap"] == 0 for r in rows)
    assert ranking_metrics(hits, qrels, qs, 2).collect()[0]["rr"] == 0.0


def test_answer_goldens(spark):
    pairs = spark.createDataFrame([(1, "Hello world", "Hello world"), (2, "Hello world", "Hello"), (3, "", "x"), (4, None, None), (5, "the cat sat on the mat today", "the cat sat on the mat")],
                                  "pair_id long, prediction string, reference string")
    bleu = {r.pair_id: r for r in answer_metrics.bleu(pairs).collect()}
    assert list(bleu[1].precisions) == [1.0, 1.0, 0.0, 0.0] and list(bleu[2].precisions) == [0.5, 0.0, 0.0, 0.0] and bleu[1].bleu == 0.0
    assert list(bleu[5].precisions) == pytest.approx([6 / 7, 5 / 6, 4 / 5, 3 / 4], abs=1e-6)
    assert bleu[5].bleu == pytest.approx((6 / 7 * 5 / 6 * 4 / 5 * 3 / 4) ** 0.25, abs=1e-6) and bleu[5].brevity_penalty == 1.0
    rouge = {r.pair_id: r for r in answer_metrics.rouge_n(pairs).collect()}
    assert (rouge[1].rouge1, rouge[1].rouge2) == (1.0, 1.0) and rouge[2].rouge1 == pytest.approx(2 / 3, abs=1e-6) and rouge[2].rouge2 == 0.0
    longest = {r.pair_id: r for r in pairs.select("pair_id", answer_metrics.rouge_l("prediction", "reference").alias("l"), answer_metrics.rouge_lsum("prediction", "reference").alias("s")).collect()}
    assert longest[1].l == longest[1].s == 1.0 and longest[2].l == longest[2].s == pytest.approx(2 / 3, abs=1e-6) and longest[3].l == longest[4].l == 0.0


@given(st.lists(st.sampled_from("abc"), max_size=80), st.lists(st.sampled_from("abcd"), max_size=80))
def test_lcs_equals_its_table(a, b):
    assert answer_metrics._lcs(a, b) == answer_metrics._lcs_table(a, b)[-1][-1]


def test_leaderboard_rankings(spark):
    """Means, delta, imputation and both rankings of three configs, by hand."""
    results = spark.createDataFrame([("a", "m", 1.0), ("a", "m", 3.0), ("a", "n", 0.0), ("b", "m", 4.0), ("b", "n", float("nan")), ("b", "n", 1.0), ("c", "m", 0.0), ("c", "n", None)],
                                    "config string, metric string, value double")
    means = leaderboard.config_means(results)
    assert {(r.config, r.metric): r.mean for r in means.collect()} == {("a", "m"): 2.0, ("a", "n"): 0.0, ("b", "m"): 4.0, ("b", "n"): 1.0, ("c", "m"): 0.0}
    delta = leaderboard.add_delta(means, "m", "n", "d").where("metric = 'd'")
    assert {r.config: r["mean"] for r in delta.collect()} == {"a": 2.0, "b": 3.0}
    grid = leaderboard.impute_mean(means, results.select("config"), ["m", "n"])
    assert [(r.config, r.value) for r in grid.where("imputed").collect()] == [("c", 0.5)]
    assert [(r.config, r.score, r.rank) for r in leaderboard.rank_by_mean(grid).sort("rank").collect()] == [("b", 2.5, 1), ("a", 1.0, 2), ("c", 0.25, 3)]
    z = leaderboard.rank_by_zscore(grid).sort("rank").collect()
    assert [(r.config, r.rank) for r in sorted(z, key=lambda r: r.config)] == [("a", 2), ("b", 1), ("c", 2)]
    assert {r.config: r.score for r in z} == pytest.approx({"a": -1.0, "b": 2.0, "c": -1.0}, abs=1e-6)
    hidden = [r for r in leaderboard.zscores(grid).collect() if r.z_masked is None]
    assert [(r.config, r.metric) for r in hidden] == [("c", "n")]


def test_leaderboard_of_equal_means(spark, tmp_path):
    """Configs that are equal in a metric have NaN there, in the operators and in the registered queries as in their SQL."""
    rows = [("a", "m", 1.0), ("b", "m", 1.0), ("c", "m", 1.0), ("a", "n", 0.0), ("b", "n", 2.0), ("c", "n", 1.0)]
    grid = spark.createDataFrame([(*r, False) for r in rows], "config string, metric string, value double, imputed boolean")
    z = {(r.config, r.metric): r.z for r in leaderboard.zscores(grid).collect()}
    assert all(math.isnan(z[c, "m"]) for c in "abc") and [z[c, "n"] for c in "abc"] == [-1.0, 1.0, 0.0]
    assert all(math.isnan(r.score) and r.rank == 1 for r in leaderboard.rank_by_zscore(grid).collect())
    alone = leaderboard.zscores(grid.where("config = 'a'")).collect()
    assert len(alone) == 2 and all(r.z is None for r in alone)

    # kNN folds case and puts the first document before those that hold the question, BM25 does not: both have an NDCG of 1, and differ in the rest
    texts = ["ALPHA BETA GAMMA DELTA"] + ["alpha beta gamma delta"] * 6 + ["omega"] * 8
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, texts[1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    ent = importlib.import_module("__spark_entry__")
    for q, column, nans in (("leaderboard_zscores", "z", 2), ("leaderboard_rank_zscore", "score", 2)):
        got, want = ent.queries()[q](spark, str(tmp_path)), con.execute(ent.oracle_sql()[q])
        assert [d[0] for d in want.description] == got.columns
        rows = got.collect()
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r)) for r in rows) and sum(math.isnan(r[column]) for r in rows) == nans
