"""Deterministic default embedder and vector math as column expressions (V-01, C-11).

The default embedder is a hashed bag of words: lower-cased alphanumeric
tokens, each put in bucket ``int(md5(token)[:8], 16) mod dim``, counts L2
normalised. It needs no model or network, runs inside codegen, and uses a
hash DuckDB computes identically (so the oracle can check it). A real model
plugs in through ``ragtable.operators.vectors.embed_column(..., model=fn)``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from .tokens import let, word_tokens

DEFAULT_DIM = 64
#: bytes of words stay, all others part words, those of letters beyond ASCII too
_PARTED = bytes(b if chr(b) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for b in range(256))
#: tokens whose bucket a task remembers, sentences that are counted at a time
REMEMBERED, SENTENCES = 1 << 17, 4096


def token_bucket(t: Column, dim: int = DEFAULT_DIM) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long"), F.lit(dim))


class Buckets(dict):
    """token -> bucket, hashed where it is met first; ``REMEMBERED`` tokens at most."""

    def __init__(self, dim: int):
        self.dim = dim

    def __missing__(self, token: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        bucket = self[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % self.dim
        return bucket

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """(texts, dim): the counts of ``hashed_counts``."""
        sizes, buckets = [], []
        for text in texts:
            words = (text or "").lower().encode(errors="replace").translate(_PARTED).split()
            sizes.append(len(words))
            buckets.append(np.fromiter(map(self.__getitem__, words), np.int64, len(words)))
        places = np.repeat(np.arange(len(texts)) * self.dim, sizes) + np.concatenate([np.zeros(0, np.int64), *buckets])
        return np.bincount(places, minlength=len(texts) * self.dim).reshape(-1, self.dim).astype(np.float64)


def hashed_vectors(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """``hashed_embedding`` of a whole column: an Arrow-batched pandas UDF (not for use inside a lambda)."""

    @pandas_udf("array<double>")
    def _vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets(dim)
        for texts in batches:
            v = buckets.counts(texts.tolist())
            n = np.sqrt((v * v).sum(axis=1, keepdims=True))
            yield pd.Series(list(v / np.where(n == 0, 1.0, n)), dtype=object)

    return _vectors(text)


def hashed_window_distances(sents: Column, dim: int = DEFAULT_DIM) -> Column:
    """1 - cos of each sentence window (previous, own, next) and the next one; 1 if a window has no word. An Arrow-batched pandas UDF.

    A window's term counts are the sum of its sentences', so each sentence is hashed once.
    """

    def apart(buckets: Buckets, texts: list[str | None]) -> np.ndarray:
        n, parts = len(texts), [np.zeros(0)]
        for low in range(0, n - 1, SENTENCES):  # distances low .. high - 1 need windows low .. high, sentences low - 1 .. high + 1
            high, first = min(low + SENTENCES, n - 1), max(low - 1, 0)
            c = buckets.counts(texts[first: high + 2])
            w = c.copy()
            w[1:] += c[:-1]
            w[:-1] += c[1:]
            w = w[low - first: high - first + 1]
            norms = np.sqrt((w * w).sum(axis=1))
            size = norms[:-1] * norms[1:]
            parts.append(1.0 - np.where(size == 0, 0.0, (w[:-1] * w[1:]).sum(axis=1) / np.where(size == 0, 1.0, size)))
        return np.concatenate(parts)

    @pandas_udf("array<double>")
    def _distances(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets(dim)
        for rows in batches:
            yield pd.Series([None if r is None else apart(buckets, list(r)) for r in rows], dtype=object)

    return _distances(sents)


def l2_normalize(v: Column) -> Column:
    def body(a):
        return let(F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)),
                   lambda nrm: F.transform(a, lambda x: F.when(nrm == 0, F.lit(0.0)).otherwise(x / nrm)))

    return let(v, body)


def hashed_counts(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<double>(dim): how many tokens fall in each bucket ('' or no word -> zeros).

    Each token's bucket is hashed once; a bucket's count is what its removal takes
    from the list, so there is one step for each bucket, not one for each (token, bucket).
    """
    buckets = F.transform(word_tokens(text), lambda t: token_bucket(t, dim).cast("int"))
    return let(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                              lambda j: (F.size(b) - F.size(F.array_remove(b, j))).cast("double")))


def hashed_embedding(text: Column, dim: int = DEFAULT_DIM) -> Column:
    """array<double>(dim): normalised hashed term counts ('' or no word -> zeros)."""
    return l2_normalize(hashed_counts(text, dim))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector is all zeros (as the usual library guard does)."""
    return let(norm(a), lambda na: let(norm(b), lambda nb: F.when((na == 0) | (nb == 0), F.lit(0.0))
                                       .otherwise(dot(a, b) / (na * nb))))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))


def hashed_embedding_sql(expr: str, dim: int = DEFAULT_DIM) -> str:
    """Same embedder in DuckDB SQL (for oracles)."""
    toks = f"list_filter(string_split_regex(lower(coalesce({expr}, '')), '[^a-z0-9]+'), lambda t: t <> '')"
    buckets = f"list_transform({toks}, lambda t: (('0x' || substr(md5(t), 1, 8))::BIGINT % {dim}))"
    return (f"list_transform(range({dim}), lambda j: "
            f"len(list_filter({buckets}, lambda b: b = j))::DOUBLE)")
