"""Benchmark decontamination with one Aho-Corasick automaton (operator 10).

Items and texts are normalised alike: A-Z lower-cased, words are runs of
digits, letters and non-ASCII characters, joined by one space. Every window of
``n`` words of an item (an item of fewer: the whole) is a pattern of one
automaton; each text is scanned once and hits are mapped back to its words and
character offsets. The patterns are a stated query set; they go to the workers
in shards of at most ``SHARD_BYTES`` of pattern text (one, for any usual
benchmark), each shard an automaton in a narrow pass after the last, so memory
is bounded whatever the benchmark's size and no text is shuffled.

Defined results: null, empty or wordless texts have no words and no hits; an
item without words has no windows; items that share windows are all reported;
an empty benchmark gives no hits; other columns are untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import ALNUM_BYTES, LOWER, Words, blocks, byte_arrays

N_WORDS = 13
SHARD_BYTES = 64 << 20
_FOLD = bytes(int(LOWER[b]) if ALNUM_BYTES[b] else 0x20 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_SPANS = "array<struct<start:long,end:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def normalise(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def patterns(benchmark: DataFrame, n: int = N_WORDS) -> DataFrame:
    """(pattern, item_ids sorted): the distinct word windows of the items."""

    def cut(batches):
        for batch in batches:
            data, off = byte_arrays(batch.column(1))
            raw, ids, out = data.tobytes(), [], []
            for i, name in enumerate(batch.column(0).to_pylist()):
                w = [x.decode("utf-8", "surrogateescape") for x in normalise(raw[off[i]: off[i + 1]])]
                got = {" " + " ".join(w[j: j + n]) + " " for j in range(max(1, len(w) - n + 1))} if w else ()
                ids += [name] * len(got)
                out += got
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(ids, pa.string())], names=["pattern", "item_id"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").mapInArrow(cut, "pattern string, item_id string")
    return rows.groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))


def _scan(shard):
    """A pass that adds one shard's hits to the columns hits (disjoint word spans), items and n_words."""

    def run(batches):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, (pattern, _) in enumerate(shard.value):
            machine.add_word(pattern, i)
        machine.make_automaton()
        for rows, data, off in blocks(batches, "text"):
            words, raw = Words(data, off, ALNUM_BYTES), data.tobytes()
            old_hits = rows.column(rows.schema.get_field_index("hits")).to_pylist()
            old_items = rows.column(rows.schema.get_field_index("items")).to_pylist()
            hits, items = [], []
            for i in range(rows.num_rows):
                found, names = [], set(old_items[i] or ())
                if len(shard.value) and words.bounds[i + 1] > words.bounds[i]:
                    flat = " " + b" ".join(normalise(raw[off[i]: off[i + 1]])).decode("utf-8", "surrogateescape") + " "
                    for end, k in machine.iter(flat):
                        found.append((end - len(shard.value[k][0]) + 1, end))
                        names.update(shard.value[k][1])
                spans = [(s["start"], s["end"]) for s in old_hits[i] or ()]
                if found:
                    gaps = np.flatnonzero(np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
                    spans += zip(np.searchsorted(gaps, [a for a, _ in found]).tolist(), np.searchsorted(gaps, [b for _, b in found]).tolist(), strict=True)
                hits.append(merged(spans))
                items.append(sorted(names))
            put = {"hits": pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], _SPANS_ARROW),
                   "items": pa.array(items, pa.list_(pa.string())), "n_words": pa.array(np.diff(words.bounds), pa.int64())}
            yield pa.RecordBatch.from_arrays([put.get(f.name, rows.column(j)) for j, f in enumerate(rows.schema)], names=rows.schema.names)

    return run


def merged(spans) -> list[tuple[int, int]]:
    """Sorted disjoint union of half-open spans."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The rows with hits (spans of word indices), items (item_ids) and n_words added under ``decon``."""
    spark = docs.sparkSession
    found = patterns(benchmark, n).cache()
    total = found.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
    shards = -(-total // shard_bytes) or 1
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].alias("text"), F.lit(None).cast(_SPANS).alias("hits"),
                        F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))
    for s in range(shards):
        part = found.where(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == s).collect()
        inner = inner.mapInArrow(_scan(spark.sparkContext.broadcast([(r[0], r[1]) for r in sorted(part)])), inner.schema)
    found.unpersist()
    return inner.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns], F.struct("hits", "items", "n_words").alias("decon"))


def n_hit():
    return F.aggregate("decon.hits", F.lit(0).cast("long"), lambda a, h: a + h["end"] - h["start"])


def contaminated():
    return (n_hit() > 0) & (n_hit() * 20 >= F.col("decon.n_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """The rows that are not contaminated, their columns as they were."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # a column of docs may be called decon
    named = docs.select(*[docs[c].alias("text" if c == "text" else n) for c, n in zip(docs.columns, names, strict=True)])
    kept = find_contamination(named, benchmark, n_words).where(~contaminated())
    return kept.select(*[F.col("text" if c == "text" else n).alias(c) for c, n in zip(docs.columns, names, strict=True)])


def character_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of a text as offsets of its characters."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in spans]
