"""Chat formatting with offset-aligned loss masks (operator 2).

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. The marks are added to
the tokenizer as special tokens, so no token ever spans a mark and a text. A
role or text can't hold a mark: ``%`` becomes ``%25`` and ``<|`` becomes ``%3C|``,
undone by one substitution. Any control string that is not made of ``<|`` (such
as ``[INST]`` or ``</s>``) is ordinary text to this template.

Turns are range-sorted by (conv_id, turn). A task renders each conversation,
encodes the rendering once with offsets (some half a million characters a call), and intersects the sorted spans of the
assistant texts with the sorted token spans by binary search. A conversation of
any length works: beyond ``PIECE_CHARS`` it is rendered in pieces cut between
turns (marks are whole tokens, so pieces encode as the whole does), range
partitioning spreads them over tasks, and ``read_back`` streams the pieces of a
conversation in order with running digests.

Defined results: null text or role is empty; turns that share a number are
ordered by role, then text; a null turn number comes first; null conv_id is a
conversation of its own; conversations without assistant turns have an empty
loss text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import list_column

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
LEARNED_ROLE = "assistant"
PIECE_CHARS = 1 << 18
GROUP_CHARS = 1 << 19
_READ = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def escape(text: str) -> str:
    return text.replace("%", "%25").replace("<|", "%3C|")


def unescape(text: str) -> str:
    return re.sub("%(25|3C)", lambda m: "%" if m[1] == "25" else "<", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(rendering, sorted character spans of the learned texts)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _READ.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens that lie in a span; both sorted, found by binary search."""
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        lo = np.searchsorted(offsets[:, 1], [a for a, _ in spans], "right")
        hi = np.searchsorted(offsets[:, 0], [b for _, b in spans], "left")
        for a, b in zip(lo, hi, strict=True):
            mask[a:b] = True
    return mask


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Character spans of the runs of masked tokens."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return [(int(offsets[a, 0]), int(offsets[b - 1, 1])) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def load_tokenizer(source: str):
    from tokenizers import Tokenizer, processors

    tok = Tokenizer.from_str(source)
    tok.add_special_tokens([TURN, TEXT, END])
    tok.post_processor = processors.ByteLevel(trim_offsets=False)  # offsets cover leading spaces too
    return tok


@lru_cache(maxsize=1)
def worker_tokenizer(source: str):
    """The tokenizer of a Python worker: read once, not once a task; tasks are the parallelism, so it starts no threads."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return load_tokenizer(source)


def _conversations(batches, piece_chars):
    """Runs of sorted rows with one conv_id: (conv_id, first turn, turns)."""
    now, first, turns, size = None, None, [], 0
    for batch in batches:
        for conv, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if turns and (conv != now or size > piece_chars):
                yield now, first, turns
                turns, size = [], 0
            if not turns:
                now, first = conv, turn
            turns.append((role or "", text or ""))
            size += len(text or "")
    if turns:
        yield now, first, turns


def _groups(pieces):
    """Lists of pieces of about ``GROUP_CHARS`` rendered characters, for one call of the tokenizer each."""
    group, size = [], 0
    for piece in pieces:
        if group and size + len(piece[4]) > GROUP_CHARS:
            yield group
            group, size = [], 0
        group.append(piece)
        size += len(piece[4])
    if group:
        yield group


def format_conversations(turns: DataFrame, tokenizer: str = TOKENIZER, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """conv_id, turn (of the piece's first row), seq, n_turns, formatted, input_ids, loss_mask, loss_spans."""
    with open(tokenizer, encoding="utf-8") as f:
        source = turns.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: a few MB, whatever the table's size

    def run(batches):
        tok = worker_tokenizer(source.value)
        pieces = ((conv, first, seq, len(rows), *render(rows)) for seq, (conv, first, rows) in enumerate(_conversations(batches, piece_chars)))
        for group in _groups(pieces):
            codes = tok.encode_batch([p[4] for p in group], add_special_tokens=False)
            masks, spans = [], []
            for code, piece in zip(codes, group, strict=True):
                offsets = np.fromiter(chain.from_iterable(code.offsets), np.int64).reshape(-1, 2)
                masks.append(token_mask(offsets, piece[5]))
                spans.append(masked_spans(offsets, masks[-1]))
            ids = list_column([np.array(code.ids, dtype=np.int32) for code in codes], pa.int32())
            learned = pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _SPANS)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([p[i] for p in group], pa.int64()) for i in range(4)), pa.array([p[4] for p in group], pa.string()), ids,
                 list_column(masks, pa.bool_()), learned],
                names=["conv_id", "turn", "seq", "n_turns", "formatted", "input_ids", "loss_mask", "loss_spans"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    ordered = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, seq long, n_turns long, formatted string, input_ids array<int>, "
                                   "loss_mask array<boolean>, loss_spans array<struct<start:long,end:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, read from the output alone."""

    def run(batches):
        now, open_, state = None, False, None

        def row():
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
            return pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([state[0]], pa.int64()), pa.array([state[1].hexdigest()]), pa.array([state[2]], pa.int64()),
                 pa.array([state[3].hexdigest()]), pa.array([state[4]], pa.int64()), pa.array([state[5]], pa.int64())], names=names)

        for batch in batches:
            for conv, text, spans, tokens in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5)), strict=True):
                if not open_ or conv != now:
                    if open_:
                        yield row()
                    now, open_, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                loss = "".join(unescape(text[s["start"]: s["end"]]) for s in spans)
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
                state[5] += tokens
        if open_:
            yield row()

    pieces = formatted.select("conv_id", "turn", "seq", "formatted", "loss_spans", F.size("input_ids").alias("tokens"))
    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
