"""Streaming equals batch; sources and sinks round-trip."""

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from ragtable.operators.context import history_window
from ragtable.sources import io
from ragtable.streaming import streams

SF = "/root/testdata/sf0.001"


def test_stream_history_equals_batch(spark):
    d = tempfile.mkdtemp(prefix="ragtable-stream-")
    src = os.path.join(d, "conv")
    conv = spark.read.parquet(f"{SF}/conversations.parquet")
    conv.repartition(3).write.parquet(src)
    got = streams.run_history_window(spark, src, conv.schema.simpleString()[7:-1].replace(":", " "), 2, os.path.join(d, "out"), files_per_batch=1)
    want = history_window(conv, 2).select("conv_id", "turn", "role", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_ingest_equals_batch(spark):
    from ragtable.functions.html import html_to_text
    from ragtable.operators.chunking import character_windows

    d = tempfile.mkdtemp(prefix="ragtable-ingest-")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    src, out = os.path.join(d, "pages"), os.path.join(d, "chunks")
    pages.write.parquet(src)
    streams.stream_ingest(spark, src, "page_id long, url string, html string", out)
    got = spark.read.parquet(out).select("page_id", "chunk_index", "chunk_text")
    want = pages.select("page_id", F.posexplode(character_windows(html_to_text(F.col("html")), 256, 32)))
    assert got.count() == want.count() > 0


def test_conversation_log_line(spark):
    df = spark.createDataFrame([("pytest", "pytest")], "role string, text string")
    line = io.conversation_log_lines(df).collect()[0]["value"]
    assert json.loads(line) == {"role": "pytest", "content": "pytest"}


def test_documents_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="ragtable-docs-")
    doc = {"Dates": {"Date of document": "01/12/1975", "Date of end of validity": "No end date"},
           "Misc": {"Author": "A"}, "Classification": {"Directory code": '{"code": "11.30.40.00"}'},
           "html": "<p>x</p>"}
    with open(os.path.join(d, "21975A1201(01).json"), "w") as f:
        json.dump(doc, f)
    with open(os.path.join(d, "notes.txt"), "w") as f:
        f.write("ignored")
    docs = io.read_documents(spark, d)
    r = docs.collect()[0]
    assert docs.count() == 1 and r["CELEX_ID"] == "21975A1201(01)" and r["doc_key"] == "21975A1201(01).json"
    mapping = {"date_of_document": {"json_key": ["Dates", "Date of document"], "type": "date"},
               "date_of_end_of_validity": {"json_key": ["Dates", "Date of end of validity"], "type": "date"},
               "depositary": {"json_key": ["Misc", "Depositary"], "type": "string"}}
    m = io.load_chunks(docs, "html", mapping).collect()[0]
    assert (m["date_of_document"], m["date_of_end_of_validity"], m["depositary"]) == ("1975-12-01", "No end date", "")


def test_streams_with_equal_folder_names_keep_apart(spark):
    d = tempfile.mkdtemp(prefix="ragtable-two-")
    src = os.path.join(d, "pages")
    spark.read.parquet(f"{SF}/pages.parquet").limit(20).write.parquet(src)
    outs = [os.path.join(d, x, "chunks") for x in "ab"]
    for out in outs:
        streams.stream_ingest(spark, src, "page_id long, url string, html string", out)
    a, b = (spark.read.parquet(o).count() for o in outs)
    assert a == b > 0


def test_conversation_log_two_batches(spark):
    d = tempfile.mkdtemp(prefix="ragtable-log-")
    src, out = os.path.join(d, "in"), os.path.join(d, "out")
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(src)
        streams.stream_conversation_log(spark.readStream.schema(rows.schema).parquet(src), out).awaitTermination()
    assert sorted(r[0] for r in spark.read.text(out).collect()) == sorted(['{"role":"user","content":"a"}', '{"role":"assistant","content":"b"}'] * 2)


def test_index_and_results_on_any_store(spark):
    d = tempfile.mkdtemp(prefix="ragtable-index-")
    assert not io.index_exists(spark, f"file://{d}/x/t")
    io.materialise_index({"t": spark.range(3)}, f"file://{d}", "x")
    assert io.index_exists(spark, f"file://{d}/x/t") and io.materialise_index({"t": spark.range(9)}, f"file://{d}", "x")["t"].count() == 3
    with open(os.path.join(d, "one.csv"), "w") as f:
        f.write("a,b\n1,2\n")
    assert [r["config"] for r in io.read_results(spark, f"file://{d}").collect()] == ["one"]


def test_results_of_differing_headers(spark):
    d = tempfile.mkdtemp(prefix="ragtable-results-")
    files = {"c 1.csv": "rr,text,n,none\n0.5,\"a,b\",1,\nNaN,,2,\n", "c2.csv": "rr,text,n,none\n1,3,3,\n", "c3.csv": "n,extra\n4,1e3\n5,x\n", "empty.csv": "", "no.txt": "z\n1\n"}
    for name, text in files.items():
        with open(os.path.join(d, name), "w") as f:
            f.write(text)
    got = io.read_results(spark, f"file://{d}")
    assert dict(got.dtypes) == {"rr": "double", "text": "string", "n": "bigint", "none": "string", "config": "string", "extra": "string"}
    rows = sorted((r.config, r.n, r.text, r.extra, str(r.rr)) for r in got.collect())
    assert rows == [("c 1", 1, "a,b", None, "0.5"), ("c 1", 2, None, None, "nan"), ("c2", 3, "3", None, "1.0"), ("c3", 4, None, "1e3", "None"), ("c3", 5, None, "x", "None")]
    assert io.read_results(spark, f"file://{tempfile.mkdtemp()}").collect() == []


def test_document_keys_are_file_names(spark):
    d = tempfile.mkdtemp(prefix="ragtable-names-")
    names = ["a b.json", "c+d.json", "e%20f.json", "é.x.json"]
    for n in names:
        with open(os.path.join(d, n), "w") as f:
            f.write('{"html": "x"}')
    assert sorted((r.doc_key, r.ID) for r in io.read_documents(spark, d).collect()) == sorted((n, n[:-5]) for n in names)


def test_idle_history_state_expires():
    class State:
        exists, hasTimedOut, value, timeout = False, False, None, None

        def update(self, v):
            self.exists, self.value = True, v

        def remove(self):
            self.exists, self.value = False, None

        def setTimeoutDuration(self, ms):
            self.timeout = ms

        @property
        def get(self):
            return self.value

    state, fn = State(), streams._window_fn(1, 500)
    rows = pd.DataFrame({"turn": [0, 1, 2], "role": ["u", "a", "u"], "text": ["x", "y", "z"]})
    assert [list(p.turn) for p in fn((7,), iter([rows]), state)] == [[1, 2]] and state.timeout == 500 and state.exists
    state.hasTimedOut = True
    assert list(fn((7,), iter([]), state)) == [] and not state.exists
    state.hasTimedOut = False
    assert [list(p.turn) for p in fn((7,), iter([rows.tail(1)]), state)] == [[2]]
