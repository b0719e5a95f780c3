"""Structured Streaming forms of the incremental steps (T-01..T-03).

T-01 ingest: new JSON documents (or page files) -> footnotes, HTML to text, chunks,
     enrichment, typed metadata -> parquet sink, with ids hashed from (document,
     chunk index) because a running corpus-wide id needs the whole corpus. The
     sink commits a batch's files in one step, so a batch that is tried again
     after a failure adds its rows once.
T-02 conversation log: messages appended as JSON lines; redelivered messages
     dropped by (conv_id, turn) within the watermark when an event time is given.
T-03 history window: ``applyInPandasWithState`` keeps the last 2k messages per
     conversation as state; each micro-batch emits the current window.
All sinks checkpoint to a folder under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import os
from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.html import html_to_text
from ..operators.chunking import character_windows
from ..plans.preprocess import document_steps, run_steps
from ..session import ensure_checkpoint_dir
from ..sources.io import DOCUMENT_SCHEMA, file_name


def _ckpt(spark: SparkSession, kind: str, target: str) -> str:
    """A checkpoint folder of its own for each kind of stream and full output path."""
    return os.path.join(ensure_checkpoint_dir(spark), "streams", f"{kind}-{hashlib.md5(target.rstrip('/').encode()).hexdigest()}")


def stream_ingest(spark: SparkSession, source_dir: str, schema: str, out_dir: str, size: int = 256,
                  overlap: int = 32, key_col: str = "page_id", html_col: str = "html", fmt: str = "parquet"):
    """T-01: pages arriving as files -> text -> chunks -> parquet; runs all available input then stops."""
    pages = spark.readStream.schema(schema).format(fmt).load(source_dir)
    chunks = (pages.select(key_col, F.posexplode(character_windows(html_to_text(F.col(html_col)), size, overlap))
                           .alias("chunk_index", "chunk_text"))
              .withColumn("chunk_id", F.xxhash64(F.col(key_col), F.col("chunk_index"))))
    q = (chunks.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", _ckpt(spark, "ingest", out_dir))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_documents(spark: SparkSession, source_dir: str, out_dir: str, files_per_batch: int = 1000, **steps):
    """T-01: ``*.json`` documents arriving in a folder, through the steps of ``document_steps(**steps)``; runs all available input, then stops.

    Keys come from the file names. A later call with the same ``out_dir`` goes on
    with the files that have come since.
    """
    docs = (spark.readStream.schema(DOCUMENT_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch)
            .json(source_dir).select("*", file_name().alias("doc_key")))
    docs = docs.withColumn("CELEX_ID", F.regexp_replace("doc_key", r"\.[^.]*$", "")).withColumn("ID", F.col("CELEX_ID"))
    q = (run_steps(docs, document_steps(**steps)).writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", _ckpt(spark, "documents", out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_conversation_log(messages: DataFrame, out_dir: str, event_time: str | None = None,
                            watermark: str = "10 minutes"):
    """T-02: append {"role","content"} JSON lines; de-duplicate redeliveries of (conv_id, turn)."""
    m = messages
    if event_time:
        m = m.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["conv_id", "turn"])
    lines = m.select(F.to_json(F.struct(F.col("role").alias("role"), F.col("text").alias("content"))).alias("value"))
    return (lines.writeStream.format("text").option("path", out_dir)
            .option("checkpointLocation", _ckpt(messages.sparkSession, "log", out_dir))
            .trigger(availableNow=True).start())


HISTORY_OUT = "conv_id long, turn long, role string, text string"
HISTORY_STATE = "turns array<long>, roles array<string>, texts array<string>"


def _window_fn(k: int, idle_ms: int | None = None):
    def fn(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        if state.exists:
            turns, roles, texts = state.get
            cur = pd.DataFrame({"turn": list(turns), "role": list(roles), "text": list(texts)})
        else:
            cur = pd.DataFrame({"turn": pd.Series(dtype="int64"), "role": pd.Series(dtype=object),
                                "text": pd.Series(dtype=object)})
        for pdf in batches:
            cur = pd.concat([cur, pdf[["turn", "role", "text"]]], ignore_index=True)
        cur = cur.drop_duplicates("turn", keep="last").sort_values("turn").tail(2 * k)
        state.update((cur["turn"].astype("int64").tolist(), cur["role"].tolist(), cur["text"].tolist()))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield cur.assign(conv_id=key[0])[["conv_id", "turn", "role", "text"]]

    return fn


def stream_history_window(messages: DataFrame, k: int, idle_ms: int | None = None) -> DataFrame:
    """T-03: per conversation, the last 2k messages as streaming state (bounded per key).

    With ``idle_ms`` the state of a conversation without a message for that long (processing time) is
    dropped; if it goes on later, its window starts anew. Without it, state is kept for ever.
    """
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return messages.groupBy("conv_id").applyInPandasWithState(_window_fn(k, idle_ms), HISTORY_OUT, HISTORY_STATE, "update", timeout)


def run_history_window(spark: SparkSession, source_dir: str, schema: str, k: int, out_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """Drive T-03 over all available files: each micro-batch's windows go to ``out_dir/batch=<id>`` (written again
    whole if a batch is retried); the result has each conversation's window from its latest batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = (stream_history_window(reader.parquet(source_dir), k).writeStream.foreachBatch(put).outputMode("update")
         .option("checkpointLocation", _ckpt(spark, "history", out_dir)).trigger(availableNow=True).start())
    q.awaitTermination()
    rows = spark.read.schema(HISTORY_OUT + ", batch long").parquet(out_dir)
    latest = rows.groupBy("conv_id").agg(F.max("batch").alias("batch"))
    return rows.join(latest, ["conv_id", "batch"]).select("conv_id", "turn", "role", "text")
