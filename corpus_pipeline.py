"""Corpus pipeline: toxicity, near duplicates, long repeats, benchmark contamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet under the shared folder of ``spark.checkpoint.dir`` and rereads it as the
next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragtable.llm import decontam, mixing, near_dedup, quality, suffix_dedup, toxicity
from ragtable.llm.kernels import bound_batches
from ragtable.session import ensure_checkpoint_dir, read_table


def _prepare(spark: SparkSession) -> None:
    ensure_checkpoint_dir(spark)
    bound_batches(spark)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: rejected documents go. Labels of held-out rows are not learned."""
    _prepare(spark)
    labels = read_table(spark, sf_dir, "labels").where(quality.fold(F.col("doc_id"), 3) != 1)
    return toxicity.drop_toxic(docs, labels)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1 on shingles of five words: one document of each component stays, the smallest doc_id."""
    _prepare(spark)
    return near_dedup.drop_near_duplicates(docs, k=5, percent=80)


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7 on words: passages of over 50 words that occur again are cut out of the texts."""
    _prepare(spark)
    return suffix_dedup.remove_repeats(docs, **suffix_dedup.PASSAGES)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: contaminated documents go."""
    _prepare(spark)
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: each document's share in the mix and where its first pass begins, in training order."""
    _prepare(spark)
    return mixing.document_order(mixing.mix_sources(docs))


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("suffix_dedup", remove_repeats),
    ("decontamination", remove_contaminated),
    ("mixing", mix),
]

# Learned scores and near-duplicate components can't be said in SQL; tests/llm holds the rows of near_dedup and suffix_dedup against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    root = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = os.path.join(root, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
