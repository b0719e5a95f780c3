"""Removal of long repeats by prefix-free parsing (operator 7).

Every byte covered by a ``length``-byte string that starts anywhere else too
goes. The corpus order of all suffixes is only needed as far as it tells which
``length``-byte prefixes are equal, so the parse is ordered by names (64-bit
fingerprints: equal names, equal strings), not letter by letter:

1. Parse. A position is a trigger if its rolling hash over ``GRAM`` bytes is
   the least (rightmost on ties) of some ``SPACING`` neighbours. Triggers depend on the text around them
   alone, equal strings are cut alike, and two follow within ``SPACING`` bytes;
   so every window of ``length`` bytes owns one trigger, the first whose making
   lies inside it. A phrase is one trigger with the windows it owns.
2. Dictionary. A phrase has two names: its core (the bytes that all windows
   that such a trigger can own share) and its whole (the bytes its windows
   cover, and where they start). Phrases with a core that occurs once are
   unique and go no further - nearly all, in prose; a bounded bitmap of the
   repeated cores keeps them out of the shuffle (``slots``).
3. Parse order. Phrases with equal wholes make a class; all windows of a class
   of two or more repeat. Where one core has several classes, the class
   representatives' windows are named and counted, weighted by class sizes.
   So a passage in a third of all documents costs one representative, not its
   pairs, and highly repetitive text costs its dictionary, not its length.
4. Repeats go back to their texts as byte spans.

Texts are parsed as bytes, or as words (``words``): a letter is then a word's
hash, the windows are ``length`` words that follow each other, whatever white
space parts them, and each run of repeated words goes from its first to its last.

Defined results: null or empty text has no bytes; texts under ``length`` bytes
(words) lose nothing; equal rows are copies of each other and lose all bytes; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .decontam import merged
from .kernels import PrefixHash, Words, blocks, mix64
from .slots import may_contain, slot_filter

LENGTH = 400
SPACING = 120
GRAM = 12
#: passages of over 50 words
PASSAGES = {"length": 51, "spacing": 17, "gram": 3, "words": True}
_POS_BITS = 31


def _letters(data: np.ndarray, off: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a block is parsed as, and its rows' offsets in it: the bytes themselves, or a hash for each word."""
    if not words:
        return data, off
    found = Words(data, off)
    return PrefixHash(data).span(found.start, found.end), found.bounds


def _triggers(names: PrefixHash, off: np.ndarray, spacing: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted trigger positions of a block and their rows."""
    n = int(off[-1]) - gram + 1
    if n < spacing:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n)
    low = np.uint64((1 << _POS_BITS) - 1)
    key = (names.span(at, at + gram) & ~low) | (low - at.astype(np.uint64))
    width = 1
    while width < spacing:  # least of every window of ``spacing`` keys, by doubling
        step = min(width, spacing - width)
        key = np.minimum(key[:-step], key[step:])
        width += step
    row = np.searchsorted(off, at[: len(key)], "right") - 1
    inside = at[: len(key)] + spacing - 1 + gram <= off[row + 1]
    pos, row = (low - (key[inside] & low)).astype(np.int64), row[inside]
    new = np.ones(len(pos), dtype=bool)
    new[1:] = (pos[1:] != pos[:-1])
    return pos[new], row[new]


def phrases(data: np.ndarray, off: np.ndarray, length: int = LENGTH, spacing: int = SPACING, gram: int = GRAM):
    """(row, first window's start in the row, number of windows, core name, whole name) arrays of a block."""
    if 3 * spacing + gram > length + 3:
        raise ValueError("triggers are too far apart for this length")
    names = PrefixHash(data)
    pos, row = _triggers(names, off, spacing, gram)
    before = np.full(len(pos), -(1 << 40))
    same = row[1:] == row[:-1]
    before[1:][same] = pos[:-1][same]
    first = np.maximum(off[row], before - spacing + 2)
    last = np.minimum(pos - spacing + 1, off[row + 1] - length)
    own = last >= first
    pos, row, first, last = pos[own], row[own], first[own], last[own]
    core = names.span(pos - spacing + 1, pos - 2 * spacing + 2 + length)
    whole = mix64(names.span(first, last + length) + ((pos - first) * 4096 + (last - first)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row, first - off[row], last - first + 1, core, whole


def _cores(length, spacing, gram, words):
    def run(batches):
        for _, data, off in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(phrases(*_letters(data, off, words), length, spacing, gram)[3].view(np.int64))], names=["core"])

    return run


def _parse(length, spacing, gram, words, repeated):
    """Phrases whose core may be one of the ``repeated`` ones."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            row, first, n, core, whole = phrases(*_letters(data, off, words), length, spacing, gram)
            pick = np.flatnonzero(may_contain(repeated.value, core))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(row[pick])), pa.array(core[pick].view(np.int64)), pa.array(whole[pick].view(np.int64)),
                 pa.array(first[pick], pa.int32()), pa.array(n[pick], pa.int32())],
                names=["rk", "core", "whole", "first", "n"])

    return run


def _among(rows: DataFrame, keys, inside: bool) -> DataFrame:
    """The rows whose ``rk`` (first column) may be one of ``keys``, or the others."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(may_contain(keys.value, batch.column(0).to_numpy()) == inside))

    return rows.mapInArrow(run, rows.schema)


def _window_names(length, words):
    """Rows (text, phrases array<struct<first, n, whole, size>>) -> a named row for each window of each phrase."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            listed = rows.column(2)
            data, off = _letters(data, off, words)
            names, flat = PrefixHash(data), listed.flatten()
            n = flat.field("n").to_numpy().astype(np.int64)
            at_row = np.repeat(np.arange(rows.num_rows), listed.value_lengths().to_numpy())
            which = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            start = flat.field("first").to_numpy().astype(np.int64)[which] + step
            name = names.span(off[at_row[which]] + start, off[at_row[which]] + start + length)
            pick = pa.array(which)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at_row[which])), pa.array(name.view(np.int64)), pa.array(start, pa.int32()), flat.field("size").take(pick)],
                names=["rk", "name", "start", "size"])

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, spacing: int = SPACING, gram: int = GRAM, words: bool = False) -> DataFrame:
    """(rk, row, text, spans) for every row: its other columns as ``row``, the starts of its repeated windows as ``spans`` (null: none)."""
    rows = docs.select(F.xxhash64(docs["doc_id"], docs["text"]).alias("rk"), F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["text"].alias("text"))
    again = cut_lineage(rows.select("text").mapInArrow(_cores(length, spacing, gram, words), "core long")
                        .groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core"))
    parse = rows.select("rk", "text").mapInArrow(_parse(length, spacing, gram, words, slot_filter(again, "core")), "rk long, core long, whole long, first int, n int")
    parse = cut_lineage(parse.join(again, "core"))
    classes = cut_lineage(parse.groupBy("core", "whole").agg(F.count("*").alias("size"), F.min(F.struct("rk", "first", "n")).alias("p")))
    many = classes.groupBy("core").agg(F.count("*").alias("c")).where("c > 1").select("core")
    probes = cut_lineage(classes.join(many, "core").groupBy(F.col("p.rk").alias("rk"))
                         .agg(F.collect_list(F.struct("p.first", "p.n", "size")).alias("probes")))
    windows = (_among(rows.select("rk", "text"), slot_filter(probes, "rk"), True).join(probes, "rk").dropDuplicates(["rk"]).select("rk", "text", "probes")
               .mapInArrow(_window_names(length, words), "rk long, name long, start int, size long"))
    # a class of one repeats where a window's name is met again; larger classes only add to the counts
    shared = windows.groupBy("name").agg(F.sum("size").alias("c")).where("c > 1").select("name")
    part = windows.where("size = 1").join(shared, "name").select("rk", F.col("start").alias("first"), F.col("start").alias("last"))
    full = (parse.join(classes.where("size > 1").select("core", "whole"), ["core", "whole"])
            .select("rk", "first", (F.col("first") + F.col("n") - 1).alias("last")).distinct())
    spans = cut_lineage(full.union(part).groupBy("rk").agg(F.collect_list(F.struct("first", "last")).alias("spans")))
    touched = slot_filter(spans, "rk")
    clean = _among(rows, touched, False)
    return _among(rows, touched, True).join(spans, "rk", "left").unionByName(clean.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))


def _removed(spans: pa.Array, length: int) -> list[list[tuple[int, int]]]:
    return [merged([(s["first"], s["last"] + length) for s in row or ()]) for row in spans.to_pylist()]


def _word_bytes(removed: list[list[tuple[int, int]]], data: np.ndarray, off: np.ndarray) -> list[list[tuple[int, int]]]:
    """Spans of words as spans of bytes, from the first word's start to the last one's end."""
    found = Words(data, off)
    return [[(int(found.start[w + a] - at), int(found.end[w + b - 1] - at)) for a, b in spans]
            for spans, w, at in zip(removed, found.bounds[:-1], off[:-1], strict=True)]


def _kept(raw: bytes, spans) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def repeat_digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            raw, spans = data.tobytes(), _removed(rows.column(2), length)
            kept = [hashlib.sha256(_kept(raw[off[i]: off[i + 1]], s)).hexdigest() for i, s in enumerate(spans)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(off), pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = repeated_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length).select("row.doc_id", "text", "spans")
    return out.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to whole UTF-8 characters."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, spacing: int = SPACING, gram: int = GRAM, words: bool = False) -> DataFrame:
    """The rows with repeats cut out of ``text`` (whole characters only) and ``n_chars``, if there, brought up to date.

    Null texts stay empty texts. Other columns are kept as they are.
    """

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            raw, spans = data.tobytes(), _removed(rows.column(2), length)
            if words:
                spans = _word_bytes(spans, data, off)
            cut = [_kept(raw[off[i]: off[i + 1]], whole_characters(raw[off[i]: off[i + 1]], s)).decode("utf-8", "replace") for i, s in enumerate(spans)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(cut, pa.string())], names=["row", "text"])

    found = repeated_spans(docs, length, spacing, gram, words).select("row", "text", "spans")
    cut = found.mapInArrow(run, found.select("row", "text").schema)
    return cut.select(*[F.col("text") if c == "text" else (F.char_length("text").cast(docs.schema[c].dataType) if c == "n_chars" else F.col("row").getField(c)).alias(c)
                        for c in docs.columns])
