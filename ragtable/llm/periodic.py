"""Periodic runs of words by string synchronising sets (operator 11).

A run is a stretch of consecutive words with smallest period q, at least
``EXPONENT`` * q long, that no neighbouring word extends keeping that period.
Texts are independent, so a task finds the runs of its own texts:

1. Highly periodic regions, periods 1 to ``SMALL`` - 1: stretches where words q
   apart are equal, read off directly.
2. Periods from ``SMALL`` on, by dyadic scales t <= q < 2t. The synchronising set
   of scale t holds the positions i whose t-word window, or the one at i + t,
   has the least hash of the windows starting in i .. i + t; windows inside a run
   of period up to t / 4 take no part. Membership hangs on the 2t words from i
   alone. A run with t <= q < 2t has such a position among its first t, and the
   same context again q further, not sooner: so neighbouring positions of equal
   context (2t words) that lie t <= d < 2t apart propose the period d.
   Windows left out belong to runs of smaller periods, which earlier scales
   and step 1 have supplied.
3. Proposals of one period that touch are one stretch; it is extended word by
   word to both sides and kept if long enough. Window hashes only propose:
   every stretch is compared on the words themselves.

Work is n log n words a text, whatever the runs; nothing is emitted for pairs of
positions inside a run but its stretch.

Defined results: a null, empty or blank text has no words and no runs; texts are
scanned whole, whatever their length; equal rows give equal results, one each;
an empty table gives no rows; other columns are handed through, except that the
operator's own ``n_words``, ``runs`` and ``collapsed`` are put after them under a
struct named by the caller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import blocks, mix64

EXPONENT = 4
MIN_LENGTH = 6
SMALL = 4
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of True as (starts, ends)."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of the windows twice as wide, from those of ``width``; the last ones of a text are never asked for."""
    out = names * _A
    out[:-width] += names[width:] * _B
    return mix64(out)


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of each window of ``width`` keys (at the end: of what is left)."""
    out, done = keys.copy(), 1
    while done < width:
        step = min(done, width - done)
        if step < len(out):
            np.minimum(out[:-step], out[step:], out=out[:-step])
        done += step
    return out


def _small_runs(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs of periods under SMALL as (start, end, period)."""
    out = []
    for q in range(1, SMALL):
        if len(words) <= q:
            break
        start, end = _stretches((words[:-q] == words[q:]) & (doc[:-q] == doc[q:]))
        full = end + q - start >= EXPONENT * q
        out += [(a, b + q, q) for a, b in zip(start[full].tolist(), end[full].tolist(), strict=True)
                if q == 1 or (words[a: a + q] != words[a]).any()]  # 2 and 3 are prime: a shorter period makes all words equal
    return out


def _extended(words: np.ndarray, low: int, high: int, first: int, last: int, d: int) -> tuple[int, int]:
    """The stretch [low, high) of words equal to those d later, grown within the text [first, last)."""
    step = 64
    while low > first:
        a = max(first, low - step)
        other = np.flatnonzero(words[a:low] != words[a + d: low + d])
        if len(other):
            low = a + int(other[-1]) + 1
            break
        low, step = a, step * 2
    step = 64
    while high + d < last:
        b = min(last - d, high + step)
        other = np.flatnonzero(words[high:b] != words[high + d: b + d])
        if len(other):
            high += int(other[0])
            break
        high, step = b, step * 2
    return low, high


def _synchronised(names: np.ndarray, periodic: np.ndarray, left: np.ndarray, t: int) -> np.ndarray:
    """Positions of the synchronising set of scale t; left: words from a position to its text's end."""
    keys = np.where(periodic, _NONE, names)
    least = _least(keys, t + 1)
    far = np.full(len(keys), _NONE)
    far[:-t] = keys[t:]
    return np.flatnonzero((left >= 2 * t) & (least != _NONE) & ((keys == least) | (far == least)))


def find_runs(words: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """Sorted runs (start, end, period) in the words (as numbers) of texts laid end to end; text k is [bounds[k], bounds[k + 1])."""
    total = len(words)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    runs = _small_runs(words, doc)
    size = np.diff(bounds)
    at = np.arange(total)
    names = _doubled(mix64(words.astype(np.uint64) * _A + _B), 1) if total > 1 else np.zeros(total, np.uint64)
    t = SMALL
    width = 2
    while total:
        alive = size[doc[at]] >= EXPONENT * t  # shorter texts hold no run of such a period
        if not alive.any():
            break
        names, at = names[alive], at[alive]
        names = _doubled(names, width)
        width = t
        periodic = np.zeros(total + 1, dtype=np.int32)
        for s, e, q in runs:
            if EXPONENT * q <= t <= e - s:
                periodic[s] += 1
                periodic[e - t + 1] -= 1
        inside = (np.cumsum(periodic[:-1]) > 0)[at]
        pos = _synchronised(names, inside, bounds[doc[at] + 1] - at, t)
        if len(pos):
            context = _doubled(names, t)[pos] + doc[at[pos]].astype(np.uint64) * _A
            order = np.argsort(context, kind="stable")
            one, two = pos[order[:-1]], pos[order[1:]]
            d = two - one
            near = (context[order[:-1]] == context[order[1:]]) & (d >= t) & (d < 2 * t)
            runs += _joined(words, at[one[near]], d[near], bounds, doc, t)
        t *= 2
    return sorted(set(runs))


def _joined(words, start, d, bounds, doc, t) -> list[tuple[int, int, int]]:
    """Runs behind the proposals (start, period d) of scale t."""
    if not len(start):
        return []
    order = np.lexsort((start, d))
    start, d = start[order], d[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (start[1:] > start[:-1] + 2 * t)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(start)) - 1
    out = []
    for a, b in zip(head.tolist(), tail.tolist(), strict=True):
        q, k = int(d[a]), int(doc[start[a]])
        low, high = _extended(words, int(start[a]), int(start[b]) + 2 * t, int(bounds[k]), int(bounds[k + 1]), q)
        for s, e in zip(*_stretches(words[low:high] == words[low + q: high + q]), strict=True):
            if e - s + q >= EXPONENT * q:
                out.append((low + int(s), low + int(e) + q, q))
    return out


def _scan(batches):
    for rows, data, off in blocks(batches, "text"):
        raw = data.tobytes()
        split = [raw[a:b].split() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        bounds = np.zeros(len(split) + 1, np.int64)
        np.cumsum([len(w) for w in split], out=bounds[1:])
        number: dict[bytes, int] = {}
        words = np.fromiter((number.setdefault(w, len(number)) for ws in split for w in ws), np.int64, int(bounds[-1]))
        cover = np.zeros(len(words) + 1, np.int32)
        listed: list[list[dict]] = [[] for _ in split]
        for s, e, q in find_runs(words, bounds):
            if e - s >= MIN_LENGTH:
                k = int(np.searchsorted(bounds, s, "right")) - 1
                listed[k].append({"start": s - int(bounds[k]), "length": e - s, "period": q})
                cover[s + q] += 1
                cover[e] -= 1
        kept = np.cumsum(cover[:-1]) == 0
        texts = [b" ".join([w for w, k in zip(ws, kept[a: a + len(ws)].tolist(), strict=True) if k] if runs else ws).decode()
                 for ws, runs, a in zip(split, listed, bounds[:-1].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(listed, _RUN_ARROW), pa.array(texts, pa.string())],
                                         names=["row", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: str = "text", into: str = "periodic") -> DataFrame:
    """The rows with a struct ``into``: n_words, runs (sorted by start, then period) and collapsed.

    collapsed is the text's words joined by one space, without those that some
    run holds after its first period.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text].alias("text"))
    found = rows.mapInArrow(_scan, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, runs {RUNS}, collapsed string") if docs.columns else rows
    return found.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c != into], F.struct("n_words", "runs", "collapsed").alias(into))


def longest_run(runs):
    """The run of greatest length (ties: smallest start, then period), as a column; null without runs."""
    order = F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    return F.array_min(order)
