"""Quality rules with line sequence labelling (operator 8).

Every text's lines are labelled content or boilerplate by Viterbi decoding of a
linear-chain conditional random field over line features; a text is kept if its
base rules hold and at least ``CONTENT_SHARE`` of its word characters stand in
content lines. The field is trained here by gradient ascent of the conditional
likelihood on a bounded sample of labelled documents (``SAMPLE`` per class): lines
of documents marked good are content, of the others boilerplate. All lines of a
sampled document count; more than ``MAX_LINES`` make several sequences.

Defined results: null, empty or wordless texts have no words, fail the base
rules and are not kept; without labelled rows of both kinds every line is
content; lines without words have no label; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import CONTINUATION, SYMBOLS, counts, line_hashes, ratios, repeated_windows, split_lines, within
from .kernels import WORD_BYTES, PrefixHash, Words, blocks
from .quality import labelled_sample

SAMPLE = 800
MAX_LINES = 200
CONTENT_SHARE = 0.5
MIN_WORDS = 10
REPEAT_PERCENT = 20


def line_table(data: np.ndarray, off: np.ndarray):
    """(rows, features, word characters, is a repeat) of the lines with a word."""
    edges, row = split_lines(data, off)
    words = Words(data, edges)
    hashes = PrefixHash(data).span(words.start, words.end)
    filled = np.diff(words.bounds) > 0
    same = within(line_hashes(data, edges), row)
    repeat = np.ones(len(row), dtype=bool)
    repeat[np.unique(same, return_index=True)[1]] = False
    x = ratios(data, edges, words, hashes)
    few = np.diff(words.bounds)
    x = np.column_stack([np.ones(len(row)), x, repeat, few < 4, few > 20])
    chars = counts(WORD_BYTES[data] & ~CONTINUATION[data], edges)
    return row[filled], x[filled], chars[filled], repeat[filled]


def _pad(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    long = max(len(s) for s in sequences)
    x = np.zeros((len(sequences), long, sequences[0].shape[1]))
    mask = np.zeros((len(sequences), long), dtype=bool)
    for i, s in enumerate(sequences):
        x[i, : len(s)], mask[i, : len(s)] = s, True
    return x, mask


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(sequences: list[np.ndarray], labels: list[int], rounds: int = 80, rate: float = 0.5, ridge: float = 1e-3) -> dict:
    """Conditional random field of two labels: ``w`` (features of label 1 against 0) and ``move`` (2 x 2 transitions)."""
    x, mask = _pad(sequences)
    every = x[mask]
    mean, scale = every.mean(axis=0), every.std(axis=0) + 1e-3
    mean[0], scale[0] = 0.0, 1.0
    x = (x - mean) / scale * mask[:, :, None]
    y = np.array(labels)
    n, long, width = x.shape
    w, move = np.zeros(width), np.zeros((2, 2))
    speed_w, speed_m = np.zeros_like(w), np.zeros_like(move)
    total = mask.sum()
    for _ in range(rounds):
        emit = np.zeros((n, long, 2))
        emit[:, :, 1] = x @ w
        fore, back = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        fore[:, 0] = emit[:, 0]
        for t in range(1, long):
            step = _logsum(fore[:, t - 1, :, None] + move, 1) + emit[:, t]
            fore[:, t] = np.where(mask[:, t, None], step, fore[:, t - 1])
        for t in range(long - 2, -1, -1):
            step = _logsum(move + (emit[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where(mask[:, t + 1, None], step, 0.0)
        norm = _logsum(fore[:, -1], 1)
        one = np.exp(fore[:, :, 1] + back[:, :, 1] - norm[:, None]) * mask
        grad_w = (((y[:, None] * mask) - one)[:, :, None] * x).sum(axis=(0, 1)) / total - ridge * w
        pair = mask[:, 1:]
        joint = np.exp(fore[:, :-1, :, None] + move + (emit + back)[:, 1:, None, :] - norm[:, None, None, None]) * pair[:, :, None, None]
        grad_m = -joint.sum(axis=(0, 1))
        steps = pair.sum(axis=1)
        grad_m[0, 0] += steps[y == 0].sum()
        grad_m[1, 1] += steps[y == 1].sum()
        speed_w, speed_m = 0.8 * speed_w + rate * grad_w, 0.8 * speed_m + rate * (grad_m / total - ridge * move)
        w, move = w + speed_w, move + speed_m
    return {"mean": mean, "scale": scale, "w": w, "move": move}


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best labels of one sequence; ``emit`` scores label 1 against label 0; ties go to label 1."""
    (m00, m01), (m10, m11) = move.tolist()
    back, s0, s1 = [], 0.0, 0.0
    for i, e in enumerate(emit.tolist()):
        if i == 0:
            s0, s1 = 0.0, e
            continue
        to0, to1 = (s1 + m10 >= s0 + m00), (s1 + m11 >= s0 + m01)
        back.append((to0, to1))
        s0, s1 = (s1 + m10 if to0 else s0 + m00), (s1 + m11 if to1 else s0 + m01) + e
    out = [int(s1 >= s0)]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


def train(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> dict | None:
    """The field, or None without labelled rows of both kinds; the line features of at most 2 * per_class documents reach the driver."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            row, x, _, _ = line_table(data, off)
            edge = np.searchsorted(row, np.arange(rows.num_rows + 1))
            cuts = [(i, j, min(j + MAX_LINES, edge[i + 1])) for i in range(rows.num_rows) for j in range(edge[i], edge[i + 1], MAX_LINES)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array([i for i, _, _ in cuts], pa.int64())), pa.array([b - a for _, a, b in cuts], pa.int32()), pa.array([x[a:b].tobytes() for _, a, b in cuts], pa.binary())],
                names=["y", "lines", "x"])

    rows = labelled_sample(docs, labels, "quality", per_class).select("y", "text").mapInArrow(run, "y int, lines int, x binary").collect()
    if len({r["y"] for r in rows}) < 2:
        return None
    return fit_field([np.frombuffer(r["x"]).reshape(r["lines"], -1) for r in rows], [r["y"] for r in rows])


def line_rules(docs: DataFrame, field: dict | None, content_share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            n = rows.num_rows
            words = Words(data, off)
            hashes = PrefixHash(data).span(words.start, words.end)
            again = np.zeros(len(hashes) + 1, dtype=np.int64)
            np.cumsum(repeated_windows(hashes, words, 5), out=again[1:])
            n_words, n_again = np.diff(words.bounds), again[words.bounds[1:]] - again[words.bounds[:-1]]
            row, x, chars, repeat = line_table(data, off)
            if field is None:
                content = np.ones(len(row), dtype=bool)
            else:
                emit = ((x - field["mean"]) / field["scale"]) @ field["w"]
                edge = np.searchsorted(row, np.arange(n + 1))
                labels = [viterbi(emit[a:b], field["move"]) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]
                content = np.array([v for s in labels for v in s], dtype=bool)
            total = np.bincount(row, chars, n)
            share = np.bincount(row, chars * content, n) / np.maximum(total, 1)
            failed = (n_words < MIN_WORDS) | (100 * n_again > REPEAT_PERCENT * n_words)
            out = [n_words, total.astype(np.int64), counts(SYMBOLS[data], off), np.bincount(row, repeat, n).astype(np.int64), n_again]
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(v, pa.int64()) for v in out), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(share)],
                                             names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
