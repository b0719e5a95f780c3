"""Chunking (C-01..C-13).

Closed-form splitters (fixed character windows, token windows, sentences,
sentence windows, semantic breaks) are array expressions evaluated per row:
a document is one row, so no window or group is keyed by document and a huge
document never drags other rows into its task. The recursive separator splitter
is a sequential fold with overlap and runs as an Arrow-batched pandas UDF,
parallel over documents (C-03, C-04 with a separator, C-07).

Corpus-wide running chunk ids (C-02) use two-level offsets: per-document chunk
counts, range-partitioned by document key and checkpointed, per-partition
totals (one row per partition) turned into partition offsets, then a running
sum inside each partition. No single unpartitioned window over the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType
from pyspark.sql.pandas.functions import pandas_udf

from ..functions.embed import DEFAULT_DIM, cosine_distance, hashed_window_distances
from ..functions.text import PY_SPACE
from ..functions.tokens import let, whitespace_tokens
from ..session import cut_lineage

STRIP = f"^{PY_SPACE}+|{PY_SPACE}+$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace; Spark ``trim`` strips spaces only)."""
    return F.regexp_replace(c, STRIP, "")


# ---- C-01 / C-02: one row per chunk, ids --------------------------------------

def split_documents(df: DataFrame, chunks: Column, keep: Sequence[str] | None = None) -> DataFrame:
    """C-01: one row per chunk with every other column copied; ``chunk_index`` 0..n-1."""
    cols = [F.col(c) for c in (keep if keep is not None else df.columns)]
    return df.select(*cols, F.posexplode(chunks).alias("chunk_index", "chunk_text"))


def chunk_key(doc_key: Column, chunk_index: Column, ext: str = "") -> Column:
    """C-02 key '<stem>_<i><ext>'."""
    return F.concat(doc_key.cast("string"), F.lit("_"), chunk_index.cast("string"), F.lit(ext))


def _partition_offsets(counts: DataFrame, key: str) -> DataFrame:
    """(key, offset): exclusive prefix sum of ``n`` in key order, two-level."""
    ranged = cut_lineage(counts.repartitionByRange(key).sortWithinPartitions(key))
    totals = ranged.groupBy(F.spark_partition_id().alias("pid")).agg(F.sum("n").alias("t")).collect()
    base: dict[int, int] = {}
    run = 0
    for pid, t in sorted((int(r["pid"]), int(r["t"])) for r in totals):
        base[pid] = run
        run += t
    schema = f"{key} {dict(ranged.dtypes)[key]}, top long, offset long"

    def add_offsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        run_local = base.get(TaskContext.get().partitionId(), 0)
        for pdf in batches:
            n = pdf["n"].astype("int64")
            excl = n.cumsum() - n + run_local
            run_local += int(n.sum())
            yield pd.DataFrame({key: pdf[key], "top": pdf["top"].astype("int64"), "offset": excl.astype("int64")})

    return ranged.mapInPandas(add_offsets, schema)


#: chunks of one document that meet their offset in one task
CHUNKS_PER_TASK = 100_000


def assign_chunk_ids(chunks: DataFrame, doc_key: str = "doc_key", index_col: str = "chunk_index", per_task: int = CHUNKS_PER_TASK) -> DataFrame:
    """C-02: ``chunk_id`` = running int from 0 over all chunks in (doc key, chunk index) order.

    A document's offset is repeated for each ``per_task`` of its chunk indices, so a document with a third
    of all chunks meets its offset in many tasks.
    """
    counts = chunks.groupBy(doc_key).agg(F.count(F.lit(1)).alias("n"), F.max(index_col).alias("top"))
    part = F.floor(F.col(index_col) / F.lit(per_task))
    offs = (_partition_offsets(counts, doc_key)
            .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("top") / F.lit(per_task))))))
    return chunks.withColumn("part", part).join(offs, [doc_key, "part"]).withColumn("chunk_id", F.col("offset") + F.col(index_col)).drop("offset", "part", "top")


# ---- C-04: fixed character windows (separator '') ------------------------------

def character_windows(text: Column, size: int, overlap: int) -> Column:
    """C-04 with sep='': windows of ``size`` code points, stride size-overlap, stripped, empties dropped."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    n = F.length(F.coalesce(text, F.lit("")))
    n_chunks = F.when(n <= size, F.lit(1)).otherwise(F.lit(1) + F.ceil((n - size) / F.lit(step)).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), n_chunks - 1),
                         lambda i: py_strip(F.substring(text, i * step + 1, size)))
    return F.filter(pieces, lambda p: p != F.lit(""))


# ---- C-05: token windows -------------------------------------------------------

def token_windows(text: Column, size: int, overlap: int) -> Column:
    """C-05: windows of ``size`` whitespace tokens, stride size-overlap, up to the window reaching the end."""
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap

    def body(toks):
        n = F.size(toks)
        n_chunks = F.when(n == 0, F.lit(0)).when(n <= size, F.lit(1)).otherwise(
            F.lit(1) + F.ceil((n - size) / F.lit(step)).cast("int"))
        return F.when(n_chunks == 0, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.greatest(n_chunks - 1, F.lit(0))),
                        lambda i: F.array_join(F.slice(toks, i * step + 1, size), " ")))

    return let(whitespace_tokens(text), body)


# ---- C-09 / C-10: sentences and sentence windows -------------------------------

def sentences(text: Column) -> Column:
    """C-09: split on whitespace that follows '.', '?' or '!' (empty trailing piece kept)."""
    return F.split(F.coalesce(text, F.lit("")), f"(?<=[.?!]){PY_SPACE}+")


def sentence_windows(sents: Column) -> Column:
    """C-10: previous + current + next sentence joined by a space (missing neighbours skipped)."""
    return let(sents, lambda a: F.transform(a, lambda s, i: F.concat_ws(" ", F.get(a, i - 1), s, F.get(a, i + 1))))


# ---- C-11 / C-12 / C-06: semantic split ----------------------------------------

def consecutive_distances(vectors: Column) -> Column:
    """C-11: 1 - cos(e_i, e_i+1) for i = 0..n-2."""
    return let(vectors, lambda vs: F.transform(F.slice(vs, 1, F.greatest(F.size(vs) - 1, F.lit(0))),
                                               lambda v, i: cosine_distance(v, F.get(vs, i + 1))))


def window_distances(sents: Column, dim: int = DEFAULT_DIM) -> Column:
    """C-11 over C-10's windows under the hashed embedder: 1 - cos of each window and the next.

    A window's term counts are the sum of its sentences', so each sentence is tokenised and hashed once.
    """
    return hashed_window_distances(sents, dim)


def linear_percentile(values: Column, p: float) -> Column:
    """NumPy 'linear' percentile of an array (null when empty)."""
    def body(s):
        m = F.size(s)
        h = (m - 1).cast("double") * F.lit(p / 100.0)
        lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
        vlo, vhi = F.get(s, lo), F.get(s, hi)
        return F.when(m == 0, F.lit(None)).otherwise(vlo + (h - lo) * (vhi - vlo))

    return let(F.array_sort(values), body)


def percentile_breaks(sents: Column, distances: Column, p: float, text: Column) -> Column:
    """C-12: cut after sentence i where distance_i is strictly above the p-th percentile.

    One sentence (no distance) returns the text unchanged. Groups are sliced
    from break positions, so the cost is linear in the number of sentences.
    Every array is bound once (``let``), never re-evaluated inside a lambda.
    """
    def with_d(d):
        def with_thr(thr):
            brk = F.filter(F.sequence(F.lit(0), F.greatest(F.size(d) - 1, F.lit(0))),
                           lambda i: F.get(d, i) > thr)

            def with_brk(b):
                starts = F.concat(F.array(F.lit(0)), F.transform(b, lambda x: x + 1))
                ends = F.concat(b, F.array(F.size(sents) - 1))
                return let(ends, lambda e: F.transform(starts, lambda st, k: F.array_join(
                    F.slice(sents, st + 1, F.get(e, k) - st + 1), " ")))

            return let(brk, with_brk)

        return F.when(F.size(d) == 0, F.array(F.coalesce(text, F.lit("")))).otherwise(
            let(linear_percentile(d, p), with_thr))

    return let(distances, with_d)


def semantic_split(text: Column, percentile: float = 95.0, dim: int = DEFAULT_DIM, embed=None) -> Column:
    """C-06: sentences -> windows -> embeddings -> consecutive distances -> percentile breaks.

    ``embed`` maps a string Column to an array<double> Column; default is the
    hashed embedder, whose windows are summed from their sentences. Distances are rounded to 6 decimals before the percentile
    so engines with different float sum order cut at the same places.
    """
    def apart(s):
        return consecutive_distances(F.transform(sentence_windows(s), embed)) if embed else window_distances(s, dim)

    def with_both(b):
        return percentile_breaks(b["s"], F.transform(b["d"], lambda x: F.round(x, 6)), percentile, text)

    # the default embedder's distances come from a UDF, which takes the sentences as they are and stands outside of lambdas
    return let(F.struct(sentences(text).alias("s"), (let(sentences(text), apart) if embed else apart(sentences(text))).alias("d")), with_both)


# ---- C-13: start index ---------------------------------------------------------

@F.pandas_udf(ArrayType(IntegerType()))
def _found_at(texts: pd.Series, chunks: pd.Series) -> pd.Series:
    def places(text, parts):
        at, out = -1, []
        for part in parts:
            at = -1 if part is None else text.find(part, at + 1)
            out.append(at)
        return out

    return pd.Series([None if t is None or c is None else places(t, c) for t, c in zip(texts, chunks)], dtype=object)


def start_indices(text: Column, chunks: Column) -> Column:
    """C-13: 0-based position of each chunk in its source, searching from previous hit + 1; -1 if absent.

    The JVM's search by character walks a text from its start for every chunk; here each search goes on where
    the last one ended, so a very long text costs one walk. Null text or chunks give null.
    """
    return _found_at(text, chunks)


# ---- C-03 / C-04 with separator / C-07: recursive separator splitter ----------
# A text is never cut in strings before the end: pieces are offsets, a packed chunk is a pair of offsets.

def pack(lengths: Sequence[int], gap: int, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of consecutive pieces, joined by ``gap`` characters, that fit ``size``; successive
    ranges share pieces of at most ``overlap`` characters. One sweep of two pointers over prefix lengths."""
    reach = [0]
    for n in lengths:
        reach.append(reach[-1] + n + gap)

    def joined(a: int, b: int) -> int:
        return reach[b] - reach[a] - gap if b > a else 0

    a = 0
    for b in range(len(lengths)):
        if joined(a, b + 1) <= size:
            continue
        if b > a:
            yield a, b
        a = next(x for x in range(a, b + 1) if x == b or (joined(x, b) <= overlap and joined(x, b + 1) <= size))
    if a < len(lengths):
        yield a, len(lengths)


def chunk_spans(text: str, lo: int, hi: int, separators: Sequence[re.Pattern | None], size: int, overlap: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whole) of the chunks of text[lo:hi]; ``whole`` marks a piece too long for ``size`` that nothing can cut.

    ``None`` as a separator stands for "between any two characters".
    """
    level = next((i for i, p in enumerate(separators) if p is None or p.search(text, lo, hi)), None)
    finer = [] if level is None or separators[level] is None else separators[level + 1:]
    cutter = separators[-1 if level is None else level]
    starts = range(lo, hi) if cutter is None else sorted({lo, *(m.start() for m in cutter.finditer(text, lo, hi))})
    edges = [*starts, hi] if hi > lo else []
    small: list[int] = []  # edges of the current run of pieces under ``size``

    def packed() -> Iterator[tuple[int, int, bool]]:
        for a, b in pack([y - x for x, y in zip(small, small[1:])], 0, size, overlap):
            yield small[a], small[b], False

    for x, y in zip(edges, edges[1:]):
        if y - x < size:
            if not small:
                small.append(x)
            small.append(y)
            continue
        yield from packed()
        small = []
        if finer:
            yield from chunk_spans(text, x, y, finer, size, overlap)
        else:
            yield x, y, True
    yield from packed()


def recursive_split_text(text: str | None, separators: Sequence[str], size: int, overlap: int, is_regex: bool = False) -> list[str]:
    """Cut at the first separator that occurs (else the last listed; '' between characters), separators staying at
    the start of their pieces; pieces packed up to ``size``, up to ``overlap`` carried over; longer pieces cut by the
    separators after it. Chunks are stripped, blank ones dropped; a piece that nothing can cut stays as it is."""
    if not text:
        return []
    patterns = [None if s == "" else re.compile(s if is_regex else re.escape(s)) for s in separators]
    chunks = (text[x:y] if whole else text[x:y].strip() for x, y, whole in chunk_spans(text, 0, len(text), patterns, size, overlap))
    return [c for c in chunks if c]


def recursive_split(text: Column, size: int = 1000, overlap: int = 200,
                    separators: Sequence[str] = (" ",), is_regex: bool = False) -> Column:
    """C-03 (and C-07 with boundary patterns): array<string> of chunks, Arrow-batched pandas UDF."""
    seps = list(separators)

    @pandas_udf("array<string>")
    def _split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recursive_split_text(t, seps, size, overlap, is_regex))

    return _split(text)


def character_split_text(text: str | None, separator: str, size: int, overlap: int) -> list[str]:
    """Cut at one literal separator (dropped, empty pieces too), pieces joined by it again up to ``size``."""
    pieces = [p for p in (text or "").split(separator) if p]
    chunks = (separator.join(pieces[a:b]).strip() for a, b in pack([len(p) for p in pieces], len(separator), size, overlap))
    return [c for c in chunks if c]


def character_split(text: Column, size: int, overlap: int, separator: str = "") -> Column:
    """C-04: separator '' is the closed form; any other separator packs the separator-split pieces."""
    if separator == "":
        return character_windows(text, size, overlap)

    @pandas_udf("array<string>")
    def _split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: character_split_text(t, separator, size, overlap))

    return _split(text)


def boundary_split(text: Column, size: int, overlap: int, patterns: Sequence[str]) -> Column:
    """C-07: chunks of at most ``size`` characters cut at literal boundary patterns."""
    return recursive_split(text, size, overlap, list(patterns), is_regex=False)
