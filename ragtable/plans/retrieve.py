"""Retriever dispatch by configuration (R-10) and index materialisation (S-17).

``config`` mirrors the source's retriever section:
  {"retriever": "FAISS" | "BM25" | "ensemble",
   "retriever_args": {"k_retrieved_documents": k, "BM25_params": {k1, b, epsilon},
                      "retrievers": [...], "retriever_weights": [...]}}
Any other retriever name is rejected, as in the source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, vectors
from ..operators.context import fuse


def retrieve(questions: DataFrame, chunks: DataFrame, config: dict, embed_model=None) -> DataFrame:
    """hits(query_id, rank, chunk_id, score) for questions(query_id, question) over chunks(chunk_id, text)."""
    name = config["retriever"]
    args = config.get("retriever_args", {})
    if name == "FAISS":
        q = vectors.embed_column(questions, "question", "embedding", model=embed_model)
        v = vectors.build_vector_table(chunks, model=embed_model)
        return vectors.knn(q, v, args["k_retrieved_documents"]).withColumnRenamed("distance", "score")
    if name == "BM25":
        p = args.get("BM25_params", {})
        idx = bm25.build_index(chunks, k1=p.get("k1", bm25.K1), b=p.get("b", bm25.B),
                               epsilon=p.get("epsilon", bm25.EPSILON))
        return bm25.bm25_search(questions, idx, args["k_retrieved_documents"])
    if name == "ensemble":
        texts = chunks.select("chunk_id", F.col("text").alias("content"))
        lists = [retrieve(questions, chunks, member, embed_model).join(texts, "chunk_id")
                 for member in args["retrievers"]]
        return fuse(lists, args["retriever_weights"]).drop("content")
    raise ValueError(f"Retriever {name} not supported")


def resolve_max_k(config: dict) -> int:
    """E-24 for one config: max k over ensemble members, else the config's k."""
    args = config.get("retriever_args", {})
    if config["retriever"] == "ensemble":
        return max(m["retriever_args"]["k_retrieved_documents"] for m in args["retrievers"])
    return args["k_retrieved_documents"]
