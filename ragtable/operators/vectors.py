"""Embedding columns and exact nearest-neighbour search (V-01..V-06).

kNN is an exhaustive scan like a flat index, but distributed and by blocks: the
questions are packed into blocks by hash, the vectors into slabs where they are,
and each block meets each slab in one row, whose distances are one matrix
product. Blocks are broadcast if all questions together have under
``BROADCAST_BYTES``; else they meet the slabs by a salted join. A pair of block
and slab hands on at most k rows per question, a final ``row_number() <= k``
merges them. The driver gets the number of questions only.

Distances are rounded to 6 decimals, also for ranking; ties break on the
vector id.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.embed import DEFAULT_DIM, hashed_vectors
from ..plans.sizing import salted_join
from ..session import bound_batches

QUERY_BLOCK = 1024
SLAB = 2048
BROADCAST_BYTES = 64 << 20


def embed_column(df: DataFrame, col: str, out: str = "embedding", dim: int = DEFAULT_DIM,
                 model: Callable[[], Callable[[list[str]], list[list[float]]]] | None = None) -> DataFrame:
    """V-01/V-02: add an ``array<double>`` embedding of ``col``.

    Default: the hashed embedder. ``model`` is a factory
    returning ``encode(list[str]) -> list[list[float]]``; it runs in an
    iterator pandas UDF, so the model is loaded once per Python worker and fed
    Arrow batches.
    """
    bound_batches(df.sparkSession)
    if model is None:
        return df.withColumn(out, hashed_vectors(F.col(col), dim))

    @pandas_udf("array<double>")
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = model()
        for s in batches:
            vecs = encode([t if t is not None else "" for t in s.tolist()])
            yield pd.Series([list(map(float, v)) for v in vecs])

    return df.withColumn(out, _encode(F.col(col)))


def build_vector_table(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text",
                       dim: int = DEFAULT_DIM, model=None) -> DataFrame:
    """V-03: (chunk_id, embedding) for every chunk in one distributed select (no batch/merge loop)."""
    return embed_column(chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")),
                        "text", "embedding", dim, model).select("chunk_id", "embedding")


def _packed(rows_a_block: int):
    """Rows (b, id, vector) as rows (b, ids, flat): up to ``rows_a_block`` neighbouring rows of one b each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())  # here, as a filter in the plan would make each vector twice
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                for i in range(low, high, rows_a_block):
                    part = batch.slice(i, min(rows_a_block, high - i))
                    ids, flat = part.column(1), part.column(2).flatten()
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).slice(0, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.concat_arrays([ids])),
                         pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.concat_arrays([flat]))], names=["b", "ids", "flat"])

    return run


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    dot = q @ v.T
    qq, vv = (q * q).sum(axis=1), (v * v).sum(axis=1)
    if metric == "l2":
        d = np.sqrt(np.maximum(qq[:, None] + vv[None, :] - 2.0 * dot, 0.0))
    else:
        norms = np.sqrt(qq)[:, None] * np.sqrt(vv)[None, :]
        d = 1.0 - np.where(norms == 0, 0.0, dot / np.where(norms == 0, 1.0, norms))
    return np.round(d, 6)


def _nearest_in(k: int, metric: str):
    """Rows (qids, qflat, vids, vflat) -> each question's k nearest vectors of the slab, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                qids, qflat, vids, vflat = (batch.column(c).slice(i, 1).flatten() for c in range(4))
                q, v = qflat.to_numpy().reshape(len(qids), -1), vflat.to_numpy().reshape(len(vids), -1)
                d = _distances(q, v, metric)
                place = np.empty(len(vids), np.int64)
                place[np.argsort(vids.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(vids))
                most = min(k, len(vids))
                row, col = np.nonzero(d <= np.partition(d, most - 1, axis=1)[:, most - 1: most])  # k and what ties with the last
                order = np.lexsort((place[col], d[row, col], row))
                row, col = row[order], col[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < k
                row, col = row[keep], col[keep]
                yield pa.RecordBatch.from_arrays([qids.take(pa.array(row)), vids.take(pa.array(col)), pa.array(d[row, col])], names=["query_id", "chunk_id", "distance"])

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "l2",
        qid: str = "query_id", qvec: str = "embedding", vid: str = "chunk_id", vvec: str = "embedding",
        query_block: int = QUERY_BLOCK, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """V-04/V-05/V-06: hits(query_id, rank, chunk_id, distance), k per question.

    ``metric``: 'l2' (flat L2 index order) or 'cosine' (1 - cosine similarity,
    1 for zero vectors). Null vectors take no part; all others have one length.
    Ids keep their types.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError("metric must be 'l2' or 'cosine'")
    q = queries.select(F.col(qid).alias("id"), F.col(qvec).cast("array<double>").alias("v"))
    v = vectors.select(F.col(vid).alias("id"), F.col(vvec).cast("array<double>").alias("v"))
    n, dim = q.agg(F.count("*"), F.max(F.size("v"))).first()
    kinds = [x.schema["id"].dataType.simpleString() for x in (q, v)]
    blocks = -(-n // query_block) or 1
    hashed = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b")
    asked = (q.select(hashed, "id", "v").repartition(blocks, "b").sortWithinPartitions("b").mapInArrow(_packed(query_block), f"b int, ids array<{kinds[0]}>, flat array<double>")
             .select("b", F.col("ids").alias("qids"), F.col("flat").alias("qflat")))
    slabs = v.select(F.lit(0).alias("b"), "id", "v").mapInArrow(_packed(SLAB), f"b int, ids array<{kinds[1]}>, flat array<double>")
    slabs = slabs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.col("ids").alias("vids"), F.col("flat").alias("vflat"))
    small = n * (dim or 0) * 8 <= broadcast_bytes
    pairs = slabs.join(F.broadcast(asked), "b") if small else salted_join(slabs, asked, ["b"], salt_source=F.xxhash64("vids"))
    near = pairs.select("qids", "qflat", "vids", "vflat").mapInArrow(_nearest_in(k, metric), f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")
    w = Window.partitionBy("query_id").orderBy(F.col("distance").asc(), F.col("chunk_id").asc())
    return (near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "chunk_id", "distance"))


def round_vector(c: Column, digits: int = 6) -> Column:
    return F.transform(c, lambda x: F.round(x, digits))
