"""Vectorised text kernels over Arrow string columns, shared by the operators here.

Texts are handled as UTF-8 bytes in blocks of about ``BLOCK_BYTES`` so that a
task's memory does not depend on how many rows Arrow puts in a batch; a single
longer text makes a block of its own. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 1 << 18
BATCH_ROWS = 1000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_BATCH_DEFAULT = "10000"

_U64 = np.uint64
_MULT = _U64(0x9E3779B97F4A7C15)
_STEP = _U64(0x5851F42D4C957F2D)
_STEP_INV = _U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def bound_batches(spark: SparkSession) -> None:
    """Hand workers at most BATCH_ROWS rows at a time, as rows hold whole texts; a session's own setting stays."""
    if spark.conf.get(_BATCH_CONF, _BATCH_DEFAULT) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))


def _table(flags) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[i for i in range(256) if flags(i)]] = True
    return out


#: bytes of words ``[^\x20\x09-\x0D]+``
WORD_BYTES = _table(lambda b: not (b == 0x20 or 0x09 <= b <= 0x0D))
#: bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
ALNUM_BYTES = _table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE_HASH = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finalising bijection on 64-bit values (xor-shift-multiply)."""
    x = x ^ (x >> _U64(31))
    x = x * _U64(0x7FB5D329728EA185)
    x = x ^ (x >> _U64(27))
    x = x * _U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U64(33))


def byte_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, its buffers unless a null hides bytes; nulls are empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    if column.null_count and np.diff(off)[column.is_null().to_numpy(zero_copy_only=False)].any():
        return byte_arrays(pc.fill_null(column.cast(pa.large_binary()), b""))
    buf = column.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8)[off[0]: off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def blocks(batches, column: str, max_bytes: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches by bytes of ``column``: yields (rows, bytes, offsets)."""
    for batch in batches:
        data, off = byte_arrays(batch.column(batch.schema.get_field_index(column)))
        n, i = batch.num_rows, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + max_bytes, "right")) - 1)
            j = min(j, n, i + 4096)
            yield batch.slice(i, j - i), data[off[i]: off[j]], off[i: j + 1] - off[i]
            i = j


class Words:
    """Word spans of a block: ``start``, ``end`` (bytes), ``doc`` (row), ``bounds`` (first word of each row, n+1)."""

    def __init__(self, data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray = WORD_BYTES):
        inside = word_bytes[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True  # words never cross rows
        before = np.empty(len(data), dtype=bool)
        after = np.empty(len(data), dtype=bool)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.bounds = np.searchsorted(self.start, off, "left")
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.bounds))


class PrefixHash:
    """Hash of any range of a block in O(1) (64-bit wrapping polynomial over random byte values, or over hashes given as uint64)."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        step = np.full(n + 1, _STEP)
        step[0] = 1
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data if data.dtype == np.uint64 else _BYTE_HASH[data]) * np.cumprod(step)[:-1], out=self.sums[1:])
        step[1:] = _STEP_INV
        self.inverse = np.cumprod(step)

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * _MULT)


def word_hashes(data: np.ndarray, words: Words) -> np.ndarray:
    """Hash of each word, A-Z taken as a-z."""
    return PrefixHash(LOWER[data]).span(words.start, words.end)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each row; fewer words make one shingle, none an empty set."""
    words = Words(data, off)
    h = word_hashes(data, words)
    n = len(h)
    rolled = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        part = h[j:] * (_MULT ** _U64(2 * j + 1))
        rolled[: n - j] += part
    rolled = mix64(rolled + _U64(k))
    out = []
    for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a: b - k + 1]))
        elif b > a:
            weights = np.array([_MULT ** _U64(2 * j + 1) for j in range(b - a)], dtype=np.uint64)
            out.append(mix64(np.array([(h[a:b] * weights).sum(dtype=np.uint64) + _U64(b - a)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def list_column(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    """A list<kind> column, one list per part."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, type=kind))
