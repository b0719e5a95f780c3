"""Steps with snapshots (S-08), streamed documents (T-01), keyphrases (R-08, R-09) and the evaluation composite (E-25)."""

import json
import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ragtable.operators import answer_metrics as A
from ragtable.operators import keyphrases as P
from ragtable.operators import metrics as M
from ragtable.operators.evaluate import evaluate
from ragtable.plans.preprocess import document_steps, run_steps
from ragtable.sources import io
from ragtable.streaming import streams

STEPS = {"mapping": {"date": {"json_key": ["Dates", "Date of document"], "type": "date"}, "author": {"json_key": ["Misc", "Author"]}, "pages": {"json_key": ["Misc", "Pages"], "type": "int"}},
         "enrich": [["Dates", "Date of document"], ["Misc", "Author"]], "size": 80, "overlap": 10}


def _write(folder, names):
    os.makedirs(folder, exist_ok=True)
    for i, name in enumerate(names):
        note = '<p class="oj-note"><a id="n1">(1)</a> the note</p>'
        html = None if i == 2 else f"<p>Text {name} <a href=\"#n1\">(1)</a> &amp; {'word ' * (20 * i)}</p>{note}"
        doc = {"Dates": {"Date of document": f"0{i + 1}/02/2020"} if i % 2 else {}, "Misc": {"Author": "Council", "Pages": "x" if i else "12"}, "Classification": {}, "html": html}
        with open(f"{folder}/{name}.json", "w") as f:
            json.dump(doc, f)


def _rows(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True) for r in df.collect()))


def test_stream_of_documents_equals_batch_over_batches_and_a_restart(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(source, ["a", "b", "c", "d"])
    with open(f"{source}/ignored.txt", "w") as f:
        f.write("no document")
    streams.stream_documents(spark, source, out, files_per_batch=1, **STEPS)
    want = run_steps(io.read_documents(spark, source), document_steps(**STEPS))
    got = spark.read.schema(want.schema).parquet(out)
    assert _rows(got) == _rows(want) and want.count() > 4
    first = {r.chunk_key: r for r in want.collect()}["a_0.json"]
    assert first.page_content.startswith("Document content:\nText a") and "(the note)" in first.page_content.replace("\n", "") and first.page_content.endswith("\nAuthor:Council")
    assert first.pages == 12 and first.date == "" and first.text in first.page_content
    _write(source, ["a", "b", "c", "d", "e", "f"][4:])
    streams.stream_documents(spark, source, out, files_per_batch=1, **STEPS)
    streams.stream_documents(spark, source, out, files_per_batch=1, **STEPS)
    again = run_steps(io.read_documents(spark, source), document_steps(**STEPS))
    assert _rows(spark.read.schema(want.schema).parquet(out)) == _rows(again)


def test_snapshots_hold_each_steps_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    _write(source, ["a", "b", "c"])
    docs, steps = io.read_documents(spark, source), document_steps(**STEPS)
    lazy = run_steps(docs, steps)
    kept = run_steps(docs, steps, str(tmp_path / "snap"))
    assert sorted(os.listdir(tmp_path / "snap")) == ["00_footnotes", "01_text", "02_chunks", "03_enriched", "04_metadata"]
    for i, (name, _) in enumerate(steps):
        want = run_steps(docs, steps[: i + 1])
        assert _rows(spark.read.schema(want.schema).parquet(str(tmp_path / "snap" / f"{i:02d}_{name}"))) == _rows(want)
    for f in os.listdir(source):
        os.rename(f"{source}/{f}", f"{source}/{f}.gone")  # the last stage needs the source no more
    assert kept.count() == len(spark.read.parquet(str(tmp_path / "snap" / "04_metadata")).collect()) and lazy.columns == kept.columns


def _tokens(t):
    return [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]


def test_keyphrases_and_matrix_brute_force(spark):
    corpus = ["The solar panel and solar wind", "Wind farms, wind FARMS", None, "", "Énergie solaire: panel data", "of the of the"]
    asked = [(1, "What is the solar panel of the wind farms? Solar panel!"), (2, None), (3, "of the"), (4, "énergie zebra énergie"), (5, "wind")]
    n = len(corpus)
    df = Counter(p for t in corpus for p in {" ".join(w[i: i + k]) for w in [_tokens(t)] for k in (1, 2) for i in range(len(w) - k + 1)})
    want = []
    for q, t in asked:
        w = _tokens(t)
        grams = Counter(" ".join(w[i: i + k]) for k in (1, 2) for i in range(len(w) - k + 1) if w[i] not in P.STOP_WORDS and w[i + k - 1] not in P.STOP_WORDS)
        best = sorted((-round(c * math.log((n + 1) / (df[g] + 1)), 6), g, c) for g, c in grams.items())[:3]
        want += [(q, r, g, c, df[g], -s) for r, (s, g, c) in enumerate(best, 1)]
    questions, texts = spark.createDataFrame(asked, "query_id int, question string"), spark.createDataFrame([(t,) for t in corpus], "text string")
    for rows in (2_000_000, 1):  # both ways of the join
        got = P.keyphrases(questions, texts, top=3, max_broadcast_rows=rows)
        assert sorted((r.query_id, r["rank"], r.phrase, r.tf, r.df, pytest.approx(r.score, abs=2e-6)) for r in got.collect()) == sorted(want)
    hits = spark.createDataFrame([(1, 1, 2.5, corpus[0]), (1, 2, 1.5, corpus[1]), (2, 1, 0.5, None), (5, 3, 0.1, "wind windwind")], "query_id int, rank int, score double, content string")
    matrix = {(r.query_id, r.keyword): (r.is_score, r.hit_1, r.hit_2, r.hit_3) for r in P.keyword_hit_matrix(hits, got, 3).collect()}
    assert matrix[1, None] == (True, 2.5, 1.5, None) and matrix[2, None] == (True, 0.5, None, None) and matrix[5, "wind"] == (False, 0.0, 0.0, 3.0)
    for (q, word), (_, *cells) in matrix.items():
        if q == 1 and word:
            assert cells == [float(t.lower().count(word)) for t in corpus[:2]] + [0.0]


def test_evaluate_equals_the_single_metrics(spark):
    def back():
        return lambda prompts: ["{QUESTION 1}: what energy? {ANSWER 1}: x\n{QUESTION 2}: which law? {ANSWER 2}: y" if "energy" in p[-1]["content"] else "no idea" for p in prompts]

    qs = spark.createDataFrame([(1, "what energy law?", "the energy law of 2020"), (2, "who?", None), (3, "where is it", "here it is")], "query_id long, question string, reference string")
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (3, 1, 12), (3, 2, 10)], "query_id long, rank int, chunk_id long")
    qrels = spark.createDataFrame([(1, 11), (3, 12), (3, 13)], "query_id long, chunk_id long")
    texts = spark.createDataFrame([(10, "the energy law"), (11, "energy"), (12, "here it was"), (13, "unused")], "chunk_id long, content string")
    got = {r.query_id: r for r in evaluate(qs, hits, qrels, texts, 2, question_model=back).collect()}
    assert set(got) == {1, 2, 3}
    at = M.metrics_at_k(hits, qrels, qs, 2).collect()
    assert all(got[r.query_id][f"RET_{n}_{r.k}"] == r[c] for r in at for n, c in (("RC", "recall"), ("PR", "precision"), ("F1", "f1"), ("AP", "ap")))
    for r in M.ranking_metrics(hits, qrels, qs, 2).collect():
        assert (got[r.query_id].RET_RR, got[r.query_id].RET_CG, got[r.query_id].RET_DCG, got[r.query_id].RET_NDCG) == (r.rr, r.cg, r.dcg, r.ndcg)
    pairs = spark.createDataFrame([(q, got[q].answer, ref or "") for q, ref in ((1, "the energy law of 2020"), (2, None), (3, "here it is"))], "pair_id long, prediction string, reference string")
    for r in A.bleu(pairs).collect():
        assert got[r.pair_id].A_BL == r.bleu and got[r.pair_id].A_BL_PR == pytest.approx(sum(r.precisions) / 4, abs=1e-6)
    for r in A.rouge_n(pairs).collect():
        assert (got[r.pair_id].A_RG_1, got[r.pair_id].A_RG_2) == (r.rouge1, r.rouge2)
    single = pairs.select("pair_id", A.rouge_l("prediction", "reference").alias("l"), A.token_match(F.col("prediction"), F.col("reference")).alias("m")).collect()
    for r in single:
        g = got[r.pair_id]
        assert g.A_RG_L == r.l and g.A_BERT_RAG_F1 == r.m.f1 and g.A_BERT_RAG_DELTA_F1 == pytest.approx(g.A_BERT_RAG_F1 - g.A_BERT_F1, abs=1e-6)
    assert got[1].A_AR_F1 > 0 and got[2].RET_RC_2 == 0.0 and got[2].answer is not None and got[2].A_AR_F1 == 0.0
