"""Documents to chunks as a list of steps, with a dump after each if asked for (S-08), alike in batch and stream (T-01)."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.footnotes import resolve_footnotes
from ..functions.html import html_to_text
from ..functions.text import enrich_text, nested_value, reformat_date
from ..operators.chunking import character_windows, chunk_key, split_documents

Step = tuple[str, Callable[[DataFrame], DataFrame]]


def run_steps(docs: DataFrame, steps: Sequence[Step], snapshots: str | None = None) -> DataFrame:
    """The steps one after the other; with ``snapshots`` each step's rows are written to its own folder there.

    A step goes on from the rows that the one before has written, so nothing
    is computed twice and the source is read once. Without snapshots all steps
    are one lazy plan.
    """
    for i, (name, step) in enumerate(steps):
        docs = step(docs)
        if snapshots is not None:
            folder = os.path.join(snapshots, f"{i:02d}_{name}")
            docs.write.parquet(folder)
            docs = docs.sparkSession.read.schema(docs.schema).parquet(folder)
    return docs


def _with_metadata(mapping: dict[str, dict]):
    def step(docs: DataFrame) -> DataFrame:
        for name, spec in mapping.items():
            if isinstance(spec["json_key"], str):
                raise TypeError(f"json_key of {name} must be a list")
            root, *rest = spec["json_key"]
            value = nested_value(F.col(root), rest)
            docs = docs.withColumn(name, reformat_date(value) if spec.get("type") == "date" else value.try_cast("long") if spec.get("type") == "int" else value)
        return docs

    return step


def _enriched(paths: Sequence[Sequence[str]], content: str):
    def step(chunks: DataFrame) -> DataFrame:
        found = []
        for root, *rest in paths:
            value = F.col(root)
            for key in rest:
                value = value[key]
            found.append(((rest or [root])[-1], value))
        return chunks.withColumn("text", F.col(content)).withColumn(content, enrich_text(F.col(content), found))

    return step


def document_steps(mapping: dict[str, dict] | None = None, enrich: Sequence[Sequence[str]] = (), size: int = 256, overlap: int = 32, drop: Sequence[str] = ("html",)) -> list[Step]:
    """Footnotes inlined, HTML to text, chunks, enrichment, typed metadata, columns dropped: rows in, rows out, no shuffle.

    Input has doc_key, CELEX_ID, html and the columns that ``mapping`` and
    ``enrich`` (paths into map columns) name. Output has chunk_id (a hash of
    document and index, as a running number needs the whole corpus), chunk_key,
    chunk_index and page_content besides; with ``enrich`` the chunk without its
    metadata stays in text. Null html has no chunks.
    """
    def split(docs: DataFrame) -> DataFrame:
        rows = split_documents(docs, character_windows(F.col("content"), size, overlap)).drop("content").withColumnRenamed("chunk_text", "page_content")
        return rows.withColumn("chunk_key", chunk_key(F.col("CELEX_ID"), F.col("chunk_index"), ".json")).withColumn("chunk_id", F.xxhash64("doc_key", "chunk_index"))

    steps: list[Step] = [
        ("footnotes", lambda d: d.withColumn("html", resolve_footnotes(F.col("html")))),
        ("text", lambda d: d.withColumn("content", html_to_text(F.col("html"))).drop(*drop)),
        ("chunks", split),
    ]
    if enrich:
        steps.append(("enriched", _enriched(enrich, "page_content")))
    if mapping:
        steps.append(("metadata", _with_metadata(mapping)))
    return steps
