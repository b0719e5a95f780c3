"""Answer metrics (E-10..E-15) over a pair table ``pairs(pair_id, prediction, reference)``.

BLEU and ROUGE-N are relational: n-grams are exploded, counted per
(pair, n, gram) with map-side combined aggregates, clipped by a join on the
gram and summed back per pair. No per-pair loop, no pairwise token product.
ROUGE-L / ROUGE-Lsum (an LCS dynamic programme) and the greedy
token-embedding match are per-row numeric kernels in Arrow-batched pandas
UDFs; their cost is bounded by the length of one answer.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.text import PY_SPACE
from ..functions.tokens import ngrams, word_tokens

# The '13a' BLEU tokenizer rules, in order (pattern, Java replacement).
BLEU_13A_RULES = [
    (r"([{-~\[-\x60 -&(-+:-@/])", " $1 "),
    (r"([^0-9])([.,])", "$1 $2 "),
    (r"([.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


def bleu_tokens(c: Column) -> Column:
    """'13a' tokens: drop '<skipped>' and '-\\n', newlines to spaces, decode four entities, split punctuation."""
    t = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit(""))
    t = F.replace(t, F.lit("\n"), F.lit(" "))
    for ent, ch in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(ent), F.lit(ch))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pat, rep in BLEU_13A_RULES:
        t = F.regexp_replace(t, pat, rep)
    return F.filter(F.split(t, f"{PY_SPACE}+"), lambda x: x != F.lit(""))


def _gram_counts(df: DataFrame, tokens: str, orders: list[int], side: str) -> DataFrame:
    g = df.select("pair_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), ngrams(F.col(tokens), n).alias("g"))
                                               for n in orders])).alias("x"))
    return (g.select("pair_id", F.col("x.n").alias("n"), F.explode("x.g").alias("gram"))
            .groupBy("pair_id", "n", "gram").agg(F.count(F.lit(1)).alias(side)))


def _clipped(tok: DataFrame, orders: list[int]) -> DataFrame:
    """(pair_id, n, overlap) clipped n-gram matches, for every pair and order (0 when none)."""
    c = _gram_counts(tok, "ptok", orders, "cp")
    r = _gram_counts(tok, "rtok", orders, "cr")
    m = c.join(r, ["pair_id", "n", "gram"]).groupBy("pair_id", "n").agg(F.sum(F.least("cp", "cr")).alias("overlap"))
    grid = tok.select("pair_id", F.explode(F.array(*[F.lit(n) for n in orders])).alias("n"))
    return grid.join(m, ["pair_id", "n"], "left").withColumn("overlap", F.coalesce(F.col("overlap"), F.lit(0)))


def bleu(pairs: DataFrame, max_order: int = 4) -> DataFrame:
    """E-10: (pair_id, bleu, precisions, brevity_penalty, length_ratio, translation_length, reference_length).

    No smoothing: BLEU is 0 when any n-gram precision is 0.
    """
    tok = pairs.select("pair_id", bleu_tokens(F.col("prediction")).alias("ptok"),
                       bleu_tokens(F.col("reference")).alias("rtok"))
    orders = list(range(1, max_order + 1))
    cl = _clipped(tok, orders).join(tok.select("pair_id", F.size("ptok").alias("plen")), "pair_id")
    possible = F.greatest(F.col("plen") - F.col("n") + 1, F.lit(0))
    cl = cl.withColumn("p", F.when(possible > 0, F.col("overlap") / possible).otherwise(F.lit(0.0)))
    per = cl.groupBy("pair_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "p"))), lambda x: x["p"]).alias("precisions"))
    lens = tok.select("pair_id", F.size("ptok").alias("translation_length"), F.size("rtok").alias("reference_length"))
    out = per.join(lens, "pair_id")
    ratio = F.when(F.col("reference_length") > 0, F.col("translation_length") / F.col("reference_length")).otherwise(
        F.lit(0.0))
    bp = F.when(ratio > 1.0, F.lit(1.0)).when(ratio == 0, F.lit(0.0)).otherwise(F.exp(1.0 - 1.0 / ratio))
    geo = F.when(F.array_min("precisions") > 0,
                 F.exp(F.aggregate("precisions", F.lit(0.0), lambda a, p: a + F.log(p)) / max_order)).otherwise(0.0)
    r6 = lambda c: F.round(c, 6)
    return out.select(
        "pair_id", r6(geo * bp).alias("bleu"), F.transform("precisions", lambda p: F.round(p, 6)).alias("precisions"),
        r6(bp).alias("brevity_penalty"), r6(ratio).alias("length_ratio"),
        F.col("translation_length").cast("long").alias("translation_length"),
        F.col("reference_length").cast("long").alias("reference_length"),
    )


def rouge_n(pairs: DataFrame, orders=(1, 2)) -> DataFrame:
    """E-11: (pair_id, rouge1, rouge2, ...) F-measures on lower-cased alphanumeric tokens."""
    tok = pairs.select("pair_id", word_tokens(F.col("prediction")).alias("ptok"),
                       word_tokens(F.col("reference")).alias("rtok"))
    cl = _clipped(tok, list(orders)).join(
        tok.select("pair_id", F.size("ptok").alias("pl"), F.size("rtok").alias("rl")), "pair_id")
    pc = F.greatest(F.col("pl") - F.col("n") + 1, F.lit(0))
    rc = F.greatest(F.col("rl") - F.col("n") + 1, F.lit(0))
    p = F.col("overlap") / F.greatest(pc, F.lit(1))
    r = F.col("overlap") / F.greatest(rc, F.lit(1))
    cl = cl.withColumn("f", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return cl.groupBy("pair_id").agg(*[F.round(F.max(F.when(F.col("n") == n, F.col("f"))), 6).alias(f"rouge{n}")
                                       for n in orders])


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence; a row of the table is the bits of one integer (a zero: the length grows there)."""
    places: dict[str, int] = {}
    for i, t in enumerate(a):
        places[t] = places.get(t, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        hit = row & places.get(t, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _lcs_table(a: list[str], b: list[str]) -> list[list[int]]:
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t


def _union_lcs(ref: list[str], cands: list[list[str]]) -> list[str]:
    """Tokens of ``ref`` that are on the longest common subsequence with any of ``cands``, in order."""
    hit: set[int] = set()
    for c in cands:
        t = _lcs_table(ref, c)
        i, j = len(ref), len(c)
        while i > 0 and j > 0:
            if ref[i - 1] == c[j - 1]:
                hit.add(i - 1)
                i, j = i - 1, j - 1
            elif t[i - 1][j] >= t[i][j - 1]:
                i -= 1
            else:
                j -= 1
    return [ref[i] for i in sorted(hit)]


def _consumed(hits: list[str], *sides: list[list[str]]) -> int:
    """Hits that count: each takes a token of its kind from every side that still has one left."""
    left = [Counter(t for sent in side for t in sent) for side in sides]
    n = 0
    for h in hits:
        if all(c[h] > 0 for c in left):
            n += 1
            for c in left:
                c[h] -= 1
    return n


def _tok(s: str | None) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9]+", (s or "").lower()) if t]


def _f(overlap: int, pl: int, rl: int) -> float:
    p = overlap / pl if pl else 0.0
    r = overlap / rl if rl else 0.0
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


@pandas_udf(DoubleType())
def rouge_l(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """E-12: ROUGE-L F (LCS of token lists)."""
    out = []
    for p, r in zip(prediction, reference):
        pt, rt = _tok(p), _tok(r)
        out.append(round(_f(_lcs(pt, rt), len(pt), len(rt)), 6))
    return pd.Series(out)


@pandas_udf(DoubleType())
def rouge_lsum(prediction: pd.Series, reference: pd.Series) -> pd.Series:
    """E-13: ROUGE-Lsum F: union LCS over newline-separated sentences."""
    out = []
    for p, r in zip(prediction, reference):
        ps = [_tok(s) for s in (p or "").split("\n")]
        rs = [_tok(s) for s in (r or "").split("\n")]
        pl, rl = sum(map(len, ps)), sum(map(len, rs))
        hits = _consumed([t for ref in rs for t in _union_lcs(ref, ps)], ps, rs)
        out.append(round(_f(hits, pl, rl), 6))
    return pd.Series(out)


def hashed_token_vectors(tokens: list[str], dim: int = 64) -> np.ndarray:
    """Default token embedder: one-hot hashed bucket per token (md5, as the column embedder)."""
    v = np.zeros((len(tokens), dim))
    for i, t in enumerate(tokens):
        v[i, int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim] = 1.0
    return v


def greedy_match(pred: list[str], ref: list[str], embed: Callable[[list[str]], np.ndarray]) -> tuple[float, float, float]:
    """Greedy cosine matching of token vectors: P = mean max over prediction tokens, R over reference tokens."""
    if not pred or not ref:
        return 0.0, 0.0, 0.0
    a, b = embed(pred), embed(ref)
    a = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    b = b / np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-12)
    sim = a @ b.T
    p, r = float(sim.max(axis=1).mean()), float(sim.max(axis=0).mean())
    return p, r, (0.0 if p + r == 0 else 2 * p * r / (p + r))


def token_match(prediction: Column, reference: Column,
                embed: Callable[[list[str]], np.ndarray] | None = None) -> Column:
    """E-14: struct<precision, recall, f1> of greedy token-embedding matching (pluggable embedder)."""
    fn = embed or hashed_token_vectors

    @pandas_udf("struct<precision:double,recall:double,f1:double>")
    def _m(p: pd.Series, r: pd.Series) -> pd.DataFrame:
        rows = [greedy_match(_tok(x), _tok(y), fn) for x, y in zip(p, r)]
        return pd.DataFrame([[round(v, 6) for v in t] for t in rows] or None,
                            columns=["precision", "recall", "f1"])

    return _m(prediction, reference)


def answer_relevance(df: DataFrame, question: str, generated: str, embed=None) -> DataFrame:
    """E-15: mean token-match of the question against questions generated from the answer.

    ``generated`` is an array<string> column (e.g. Q-05 output's questions);
    none generated -> zeros.
    """
    ex = df.select("pair_id", question, F.explode_outer(generated).alias("_g"))
    m = ex.withColumn("_m", F.when(F.col("_g").isNotNull(), token_match(F.col(question), F.col("_g"), embed)))
    return m.groupBy("pair_id").agg(
        *[F.round(F.coalesce(F.avg(f"_m.{k}"), F.lit(0.0)), 6).alias(f"ar_{k}") for k in ("precision", "recall", "f1")])
