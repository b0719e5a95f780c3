"""Target-distribution importance resampling (operator 12).

Texts are drawn with odds that follow how much likelier a target distribution
makes their word windows than the corpus itself does:

1. Pre-tokenisation. An untrained Regex ``Split`` of the tokenizers library cuts
   the text, A-Z lower-cased, into words with their offsets. Texts go to it in
   pieces of about ``PIECE`` bytes cut behind separators, which belong to no word.
2. Windows. A window is a pair of offsets, the start of a word and the end of
   the same, the next or the second next one; it stands for its words joined by
   one space. Its CRC-32 comes from the CRCs of its words: a CRC is linear, so
   what a word adds to a longer string's is its own, moved by the length that
   follows. ``BUCKETS`` buckets by remainder.
3. Histograms. Buckets of all texts are counted in the tasks and summed, as are
   those of the target. The words are cut once: the buckets of each text are
   written to the shared folder, two bytes a window, and read for both passes.
4. Gains. A bucket's gain is the floored log ratio of the smoothed shares; a
   text's weight is the sum over its windows, and Gumbel noise from a hash
   of seed and doc_id makes the highest scores a draw without replacement.

The driver gets the two histograms (``BUCKETS`` numbers each) and one count
for each partition, never a row of the corpus.

Defined results: null, empty or wordless texts have no windows, weight 0, and
take no part in the draw if they have under ``min_words`` words; equal doc_ids
get the same noise; a null doc_id counts as the empty string and comes last
among ties; rows alike in score and doc_id are told apart by n_features, weight
and, as equal rows, in any order; an empty target or corpus gives gains from
the smoothing alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .kernels import ALNUM_BYTES, LOWER, blocks, byte_arrays
from .shared_tables import SharedTable

BUCKETS = 10_000
WINDOW = 3
PIECE = 1 << 11
SEED = 42
MIN_WORDS = 20
PERCENT = 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = bytes(LOWER.tolist())
_NIBBLES = 256


@lru_cache(1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(WORD), "removed", invert=True)


def _pieces(raw: bytes):
    """Cuts of a text behind separators, so that no word is parted."""
    if len(raw) <= PIECE:
        return [raw] if raw else []
    at, gaps = [0], np.flatnonzero(~ALNUM_BYTES[np.frombuffer(raw, np.uint8)]) + 1
    while len(raw) - at[-1] > PIECE:
        k = int(np.searchsorted(gaps, at[-1] + PIECE))
        if k == len(gaps):
            break
        at.append(int(gaps[k]))
    return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True) if b > a]


def words_with_offsets(text: str | None) -> list[tuple[str, tuple[int, int]]]:
    """The words of a text, A-Z lower-cased, with their offsets in its characters."""
    out, base = [], 0
    for piece in _pieces((text or "").encode().translate(_LOWER)):
        said = piece.decode()
        out += [(w, (a + base, b + base)) for w, (a, b) in _splitter().pre_tokenize_str(said)]
        base += len(said)
    return out


@lru_cache(4096)
def _moves(length: int) -> np.ndarray:
    """What ``length`` more bytes make of a CRC, as four tables of a byte each (4 x 256)."""
    if length == 0:
        return (np.arange(_NIBBLES, dtype=np.uint32)[None, :] << np.array([[0], [8], [16], [24]], dtype=np.uint32)).astype(np.uint32)
    if length == 1:
        # zlib gives crc(a + b"\0") for the one-byte move: crc(x, prev) is linear in prev up to crc(x, 0)
        zero = zlib.crc32(b"\0", 0)
        return np.array([[zlib.crc32(b"\0", v << s) ^ zero for v in range(_NIBBLES)] for s in (0, 8, 16, 24)], dtype=np.uint32)
    half = _moves(length // 2)
    out = _move(half.ravel(), half).reshape(4, _NIBBLES)
    return _move(out.ravel(), _moves(1)).reshape(4, _NIBBLES) if length % 2 else out


def _move(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def _moved(crc: np.ndarray, which: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Each CRC moved by its own table, ``tables[which]``."""
    flat, base = tables.ravel(), which * 1024
    out = flat[base + (crc & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[base + (k << 8) + ((crc >> np.uint32(8 * k)) & np.uint32(255))]
    return out


class Buckets:
    """Buckets of all windows of a block of texts; ``n_words`` by text."""

    def __init__(self, texts: list[bytes]):
        number: dict[str, int] = {}
        split = _splitter().pre_tokenize_str
        at, n = [], np.zeros(len(texts), np.int64)
        for i, raw in enumerate(texts):
            before = len(at)
            for piece in _pieces(raw.translate(_LOWER)):
                at += [number.setdefault(w, len(number)) for w, _ in split(piece.decode())]
            n[i] = len(at) - before
        known = [w.encode() for w in number]
        own = np.array([zlib.crc32(w) for w in known], dtype=np.uint32)
        after = np.array([zlib.crc32(b" " + w) for w in known], dtype=np.uint32)  # as it follows another word
        lengths, which = np.unique(np.array([len(w) + 1 for w in known], dtype=np.int64), return_inverse=True)
        tables = np.stack([_moves(int(x)) for x in lengths]) if known else np.zeros((0, 4, _NIBBLES), np.uint32)
        words = np.array(at, dtype=np.int64)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(n, out=bounds[1:])
        self.n_words, self.bounds = n, bounds
        crc = own[words]
        self.values = [(crc % np.uint32(BUCKETS)).astype(np.uint16)]  # by window length; those across texts are not asked for
        for k in range(1, WINDOW):  # offset pairs (i, i + k): the pair (i, i + k - 1) grown by a word
            last = words[k:]
            crc = _moved(crc[: len(last)], which[last], tables) ^ after[last]
            self.values.append((crc % np.uint32(BUCKETS)).astype(np.uint16))

    def packed(self) -> list[bytes]:
        """Each text's buckets, two bytes each: those of single words, of pairs, of triples."""
        raw = [v.tobytes() for v in self.values]
        return [b"".join([v[2 * a: 2 * max(a, b - k)] for k, v in enumerate(raw)]) for a, b in zip(self.bounds[:-1].tolist(), self.bounds[1:].tolist(), strict=True)]


def _cut(batches):
    for rows, data, off in blocks(batches, "text"):
        raw = data.tobytes()
        got = Buckets([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(got.n_words), pa.array(got.packed(), pa.binary())], names=["doc_id", "n_words", "buckets"])


def hashed_windows(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, buckets): the bucket of every window of every text, two bytes each, repeats included."""
    rows = docs.select(docs[id_column].alias("doc_id"), docs["text"].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_cut, f"doc_id {kind}, n_words long, buckets binary")


def _counted(batches):
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        total += np.bincount(byte_arrays(batch.column(0))[0].view(np.uint16), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])


def histogram(hashed: DataFrame) -> np.ndarray:
    """Windows in each bucket, counted in the tasks and summed by bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for r in hashed.select("buckets").mapInArrow(_counted, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the source."""
    s_all, t_all = float(source.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], dtype=np.int64)


def _weigh(gains):
    def run(batches):
        for batch in batches:
            data, off = byte_arrays(batch.column(2))
            total = np.concatenate([[0], np.cumsum(gains.value[data.view(np.uint16)])])
            off = off // 2
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]])],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return run


def text_weights(hashed: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): a text's weight is the sum of its windows' gains."""
    shared = hashed.sparkSession.sparkContext.broadcast(gains)  # BUCKETS numbers
    kind = hashed.schema["doc_id"].dataType.simpleString()
    return hashed.mapInArrow(_weigh(shared), f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel_noise(doc_id, seed: int = SEED):
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:doc_id"), as a column."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.log(-F.log(u)) * -1000.0)


def ranked(rows: DataFrame, draw: int, *order) -> DataFrame:
    """The rows with ``rank`` 1, 2, ... in the given order, null from ``draw`` on: a range sort, and each partition's rows before it."""
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    here = F.monotonically_increasing_id()
    numbered = placed.select("*", F.shiftright(here, 33).alias("_part"), here.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    before, starts = 0, []
    for r in sorted(numbered.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one row for each partition
        starts.append((r["_part"], before))
        before += r["n"]
    offsets = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part long, _before long"))
    rank = F.col("_before") + F.col("_at") + 1
    return numbered.join(offsets, "_part").withColumn("rank", F.when(rank <= draw, rank)).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row; rank is null where the row isn't drawn.

    Of the N rows with ``min_words`` words, floor(percent * N / 100) are drawn.
    ``target`` needs a column text.
    """
    stored = SharedTable(hashed_windows(docs, id_column), "windows")
    hashed = stored.read()
    aim = histogram(hashed_windows(target.select(F.lit(None).cast("long").alias("doc_id"), "text")))
    gains = bucket_gains(histogram(hashed), aim)
    scored = text_weights(hashed, gains).withColumn("score", F.col("weight") + gumbel_noise(F.col("doc_id"), seed))
    scored = cut_lineage(scored)
    stored.drop()
    able = F.col("n_words") >= min_words
    draw = scored.where(able).count() * percent // 100
    drawn = ranked(scored.where(able).withColumn("_row", F.monotonically_increasing_id()), draw,
                   F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")).drop("_row")
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))

