"""Per-line and per-text counts of a block, vectorised; used by the quality classifier and the line rules."""

from __future__ import annotations

import numpy as np

from .kernels import PrefixHash, Words, mix64

_MULT = np.uint64(0x9E3779B97F4A7C15)


def byte_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


SYMBOLS = byte_table(b"#*$%&|<>")
UPPER = byte_table(bytes(range(0x41, 0x5B)))
LETTERS = UPPER | byte_table(bytes(range(0x61, 0x7B)))
LETTERS[0x80:] = True
DIGITS = byte_table(b"0123456789")
SHOUTS = byte_table(b"!?")
STOPS = byte_table(b".!?:;")
CONTINUATION = np.zeros(256, dtype=bool)
CONTINUATION[0x80:0xC0] = True


def counts(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """True flags in each [off[i], off[i+1])."""
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def within(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Hashes made different between groups."""
    return mix64(hashes + group.astype(np.uint64) * _MULT)


def repeated_windows(hashes: np.ndarray, words: Words, n: int) -> np.ndarray:
    """Per word: True if it is in an n-word window that the same row holds twice or more."""
    m = len(hashes)
    cover = np.zeros(m + 1, dtype=np.int64)
    if m >= n:
        rolled = np.zeros(m - n + 1, dtype=np.uint64)
        for j in range(n):
            rolled += hashes[j: m - n + 1 + j] * (_MULT ** np.uint64(2 * j + 1))
        inside = words.doc[: m - n + 1] == words.doc[n - 1:]
        at = np.flatnonzero(inside)
        _, back, freq = np.unique(within(rolled[at], words.doc[at]), return_inverse=True, return_counts=True)
        often = at[freq[back] > 1]
        np.add.at(cover, often, 1)
        np.add.at(cover, often + n, -1)
    return np.cumsum(cover[:-1]) > 0


def split_lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start offsets of all \\n-split lines + end, row of each line); a row's last line has no \\n, the others keep theirs at the end."""
    breaks = np.flatnonzero(data == 10) + 1
    starts = np.concatenate([off[:-1], breaks])
    rows = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks - 1, "right") - 1])
    order = np.lexsort((starts, rows))
    return np.concatenate([starts[order], off[-1:]]), rows[order]


def line_hashes(data: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Hash of each line without its \\n."""
    end = edges[1:].copy()
    full = end > edges[:-1]
    end[full] -= data[end[full] - 1] == 10
    return PrefixHash(data).span(edges[:-1], end)


def ratios(data: np.ndarray, off: np.ndarray, words: Words, hashes: np.ndarray) -> np.ndarray:
    """Rows x measures: shares of kinds of characters and words in each [off[i], off[i+1])."""
    size = np.maximum(np.diff(off), 1)
    n = np.diff(words.bounds)
    some = np.maximum(n, 1)
    letters = counts(LETTERS[data], off)
    twin = np.zeros(len(hashes), dtype=bool)
    if len(hashes):
        twin[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    first = np.zeros(len(hashes), dtype=bool)
    first[np.unique(within(hashes, words.doc), return_index=True)[1]] = True
    by_word = lambda flags: counts(flags, words.bounds) / some
    length = words.end - words.start
    last = data[words.end - 1] if len(hashes) else np.zeros(0, np.uint8)
    return np.column_stack([
        np.log1p(n), counts(SYMBOLS[data], off) / size, counts(UPPER[data], off) / np.maximum(letters, 1), counts(SHOUTS[data], off) / size,
        counts(DIGITS[data], off) / size, counts(data == 0x7C, off) / size, letters / size, by_word(twin), by_word(first), by_word(length > 20), by_word(length < 3),
        by_word(STOPS[last]), by_word(SYMBOLS[last]), counts(data == 10, off) / some, np.minimum(size / some, 30) / 30,
    ])
