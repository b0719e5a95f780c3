"""Toxicity with noisy-channel deobfuscation (operator 9).

1. A character trigram model of words is counted over the whole corpus.
2. Suspicious spans - letters mixed with look-alikes (``m0r0n``), letters spaced
   or dotted out (``m o r o n``), letters drawn out (``mooooron``) - become lattices:
   each character stands for itself or for the letters it looks like, separators
   may vanish, repeats may collapse. Viterbi decoding under the trigram model
   restores the likeliest letters, in time linear in the span's length; a second pass
   chooses which separators end a word, under the corpus' frequent words and, for
   others, the trigrams. The raw form stays beside them, and so do the letters as one word.
3. Restored texts are scored by a decision list learned from labelled rows: word
   beginnings and whole words that mark toxic rows and nearly no others; first the
   common ones, then a greedy cover of the toxic rows left. A text's score is the
   precision of its best mark. One automaton finds the marks in one scan.

The trigram counts are aggregated in Spark over every word; the model kept is
over the ``LETTERS`` commonest letters, so at most LETTERS ** 3 numbers reach the
workers, and of words those that are one in ``LEXICON`` or more of the corpus. The list is learned from at most ``SAMPLE`` documents per class, one per
distinct text. Defined results: null and empty texts get the base score; without
labelled rows of both kinds every text does; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .decontam import normalise
from .kernels import blocks
from .quality import labelled_sample

SAMPLE = 2500
LETTERS = 64
LEXICON = 200_000
MIN_ROWS = 2
MIN_ROWS_SHARE = 0.002
COMMON_SHARE = 0.03
PRECISION = 0.97
FALSE_MARKS = 0.05
CUT = 0.7
BASE_SCORE = 0.02
PREFIXES = range(3, 9)
MEMO_SPAN = 80
# letters that a character can stand for, fixed values
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "£": "l", "*": ""}
SEPARATORS = " .-_*~"
_EDGES = ".,;:?\"'()[]{}<>-_"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .\-_*~]){3,}[^\W_](?![^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1\1")


# -- character model ---------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the lower-case words of the corpus."""

    def run(batches):
        for rows, data, off in blocks(batches, "text"):
            seen = Counter(data.tobytes().translate(None, b".,;:!?\"'()").lower().split())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace").lower() for w in seen]), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    joined = docs.select("text")  # a word never spans rows: each block ends its rows with a break
    words = joined.select(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n"))


def character_counts(words: DataFrame) -> DataFrame:
    """(gram, n): character trigrams of counted words, '^^' before and '$' after a word."""

    def grams(batches):
        total: Counter = Counter()
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word.isalpha():
                    w = f"^^{word}$"
                    for i in range(len(w) - 2):
                        total[w[i: i + 3]] += n
            if len(total) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["gram", "n"])

    return words.mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def character_model(docs: DataFrame, letters: int = LETTERS) -> dict:
    """Log probabilities of a character after two others, over the commonest letters: at most letters ** 3 entries; and of frequent words."""
    words = cut_lineage(word_counts(docs))
    total = words.agg(F.sum("n")).first()[0] or 0
    often = {r["word"]: math.log(r["n"] / total) for r in words.where(F.col("n") >= max(2, total / LEXICON)).collect() if r["word"].isalpha()}
    grams = cut_lineage(character_counts(words))
    top = grams.groupBy(F.substring("gram", 3, 1).alias("c")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "c").limit(letters)
    known = {r["c"] for r in top.collect()} | {"^", "$"}
    inside = F.lit(True)
    for i in (1, 2, 3):
        inside = inside & F.substring("gram", i, 1).isin(*sorted(known))
    rows = grams.where(inside).collect()
    context: Counter = Counter()
    for r in rows:
        context[r["gram"][:2]] += r["n"]
    size = len(known)
    return {"known": known, "p": {r["gram"]: math.log((r["n"] + 0.1) / (context[r["gram"][:2]] + 0.1 * size)) for r in rows},
            "rest": {c: math.log(0.1 / (n + 0.1 * size)) for c, n in context.items()}, "none": math.log(1 / max(size, 1)),
            "words": often, "longest": max(map(len, often), default=0)}


def _step(model: dict, two: str, c: str) -> float:
    p = model["p"].get(two + c)
    return p if p is not None else model["rest"].get(two, model["none"])


SWAP, DROP, COLLAPSE, STRANGE = -2.0, -0.5, -1.0, -9.0
UNKNOWN = -4.0


def _pieces(span: str, model: dict) -> list[str]:
    """The likeliest letters behind ``span`` (lower-case), and '' where a separator vanished: Viterbi over the lattice of its readings."""
    states = {"^^": (0.0, None)}  # last two letters -> (score, pieces so far: the last one and what is before)
    previous = ""
    for i, c in enumerate(span):
        options = [(c, 0.0)] if c.isalpha() and c in model["known"] else [(c, STRANGE)]
        options += [(x, SWAP) for x in LOOKALIKES.get(c, "")]
        parts = c in SEPARATORS and 0 < i < len(span) - 1
        drop = DROP if parts else (STRANGE if not c.isalnum() else None)
        nxt: dict[str, tuple[float, tuple | None]] = {}
        for two, (score, read) in states.items():
            for x, cost in options:
                got = score + cost + _step(model, two, x)
                key = two[1] + x
                if key not in nxt or got > nxt[key][0]:
                    nxt[key] = (got, (x, read))
            if drop is not None and (two not in nxt or score + drop > nxt[two][0]):
                nxt[two] = (score + drop, ("", read) if parts and read else read)
            if c == previous and read and (two not in nxt or score + COLLAPSE > nxt[two][0]):
                nxt[two] = (score + COLLAPSE, read)
        states, previous = nxt, c
    _, read = max(((score + _step(model, two, "$"), read) for two, (score, read) in states.items()), key=lambda x: x[0], default=(0, None))
    out = []
    while read:
        out.append(read[0])
        read = read[1]
    return out[::-1]


def restore(span: str, model: dict) -> str:
    """The likeliest word behind ``span`` (lower-case)."""
    return "".join(_pieces(span, model))


def split_words(letters: str, cuts: list[int], model: dict) -> list[str]:
    """``letters`` cut into its likeliest words at some of ``cuts``: frequent words by their share, others of any length by their trigrams."""
    n, often = len(letters), model["words"]
    padded = "^^" + letters
    run = [0.0]  # score of each letter after the two before it
    for k in range(n):
        run.append(run[-1] + _step(model, padded[k: k + 2], letters[k]))
    begin = lambda a, k: sum(_step(model, ("^^" + letters[a: a + 2])[j: j + 2], letters[a + j]) for j in range(k))
    ends = [*cuts, n]
    best = {0: (0.0, 0)}  # end of a word -> (score, its start)
    far, far_at = -math.inf, 0  # the best start of an unknown word of over two letters, without what its end decides
    waiting, near = [], []  # starts too close for that, and close enough for a frequent word
    start = 0
    for end in ends:
        waiting.append(start)
        near = [a for a in [*near, start] if end - a <= model["longest"]]
        options = []
        for a in [a for a in waiting if end - a > 2]:
            waiting.remove(a)
            got = best[a][0] + begin(a, 2) - run[a + 2]
            if got > far:
                far, far_at = got, a
        close = lambda a: _step(model, ("^^" + letters[a:end])[-2:], "$")  # noqa: B023, E731
        if far > -math.inf:
            options.append((far + run[end] + close(far_at) + UNKNOWN, far_at))
        options += [(best[a][0] + begin(a, end - a) + close(a) + UNKNOWN, a) for a in waiting]
        options += [(best[a][0] + often[letters[a:end]], a) for a in near if letters[a:end] in often]
        best[end] = max(options)
        start = end
    out, end = [], n
    while end:
        out.append(letters[best[end][1]: end])
        end = best[end][1]
    return out[::-1]


def readings(span: str, model: dict) -> str:
    """The restored words of a span; several also as one word."""
    pieces, cuts, at = _pieces(span, model), [], 0
    for x in pieces:
        at += len(x)
        if not x and (not cuts or cuts[-1] < at):
            cuts.append(at)
    whole = "".join(pieces)
    cuts = [c for c in cuts if 0 < c < len(whole)]
    words = split_words(whole, cuts, model) if cuts else [whole]
    return " ".join([*words, whole] if len(words) > 1 else words)


def suspicious(text: str) -> set[str]:
    """Lower-case spans of a text whose letters may be disguised."""
    out = set()
    for w in set(text.split()):
        if not w.isalpha():
            core = w.strip(_EDGES)
            if len(core) >= 3 and not core.isalpha() and any(c in LOOKALIKES for c in core) and any(c.isalpha() for c in core):
                out.add(core.lower())
    out.update(m.group().lower() for m in _SPACED.finditer(text))
    if _DRAWN.search(text):
        out.update(w.strip(_EDGES).lower() for w in set(text.split()) if _DRAWN.search(w))
    return out


def restored_text(raw: bytes, model: dict, memo: dict[str, str]) -> str:
    """`` word word ... ``: the normalised words of a text, then what its suspicious spans stand for."""
    text = raw.decode("utf-8", "replace")
    words = b" ".join(normalise(raw)).decode("utf-8", "replace").lower()
    more = []
    for span in sorted(suspicious(text)):
        if len(span) > MEMO_SPAN:
            more.append(readings(span, model))
            continue
        if span not in memo:
            if len(memo) > 20_000:
                memo.clear()
            memo[span] = readings(span, model)
        more.append(memo[span])
    return f" {words} {' '.join(more)} "


# -- decision list -----------------------------------------------------------

def marks_of(text: str) -> set[str]:
    """Candidate marks of a restored text: `` word `` and `` beginning`` of each word."""
    out = set()
    for w in set(text.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in PREFIXES if k <= len(w))
    return out


def stands(mark: str, words: set[str]) -> bool:
    """Whether a mark may stand alone: a whole word, or a beginning that is itself one of ``words`` or has all the letters a beginning may have."""
    return mark.endswith(" ") or f"{mark} " in words or len(mark) > max(PREFIXES)


def choose_marks(toxic: list[set[str]], clean_counts: dict[str, int], n_clean: int, clean_weight: float, least: int = MIN_ROWS, precision: float = PRECISION) -> dict[str, float]:
    """Marks with their precision: all that are common among toxic rows, then a greedy cover of the rows left.

    A beginning must be a word of the toxic rows (`` moron`` also meets its inflections, `` mor`` meets other words);
    of common marks of the same rows the longest beginning stands for all, and the cover prefers it among equals.
    A mark's rows could all be toxic by chance with probability (share of toxic rows) ** rows; it counts only if that
    stays under ``FALSE_MARKS`` for all the given marks of ``least`` rows together.
    ``clean_weight``: how many clean rows of the labels a clean row of the sample stands for, per toxic row.
    """
    n_toxic = len(toxic)
    total = Counter(m for row in toxic for m in row)
    chance = -math.log(n_toxic / (n_toxic + n_clean))
    tried = {m: n for m, n in total.items() if n >= least and stands(m, total)}
    sure = math.log(max(1, len(tried)) / FALSE_MARKS)
    rows_of: dict[str, set[int]] = {}
    for i, row in enumerate(toxic):
        for m in row:
            if m in tried and tried[m] * chance >= sure and total[m] / (total[m] + clean_weight * clean_counts.get(m, 0)) >= precision:
                rows_of.setdefault(m, set()).add(i)
    score = {m: len(r) / (len(r) + clean_weight * clean_counts.get(m, 0) + 0.5) for m, r in rows_of.items()}
    out: dict[str, float] = {}
    first = lambda m: (m.endswith(" "), -len(m), m)
    common = sorted((m for m, r in rows_of.items() if len(r) >= COMMON_SHARE * n_toxic), key=lambda m: (-len(rows_of[m]), first(m)))
    seen: set[frozenset[int]] = set()
    for m in common:
        key = frozenset(rows_of[m])
        if key not in seen:
            seen.add(key)
            out[m] = score[m]
    done = {i for m in out for i in rows_of[m]}
    left = {m: r - done for m, r in rows_of.items()}
    while left:
        best = min(left, key=lambda m: (-len(left[m]) * score[m], first(m)))
        covered = left.pop(best)
        if len(covered) < least or len(covered) * chance < sure:
            break
        out[best] = score[best]
        left = {m: r - covered for m, r in left.items() if len(r - covered) >= least}
    return out


def learn_marks(docs: DataFrame, labels: DataFrame, model: dict, per_class: int = SAMPLE) -> dict[str, float]:
    """Marks and precisions from a bounded labelled sample; copies of a text count once, a text labelled both ways not at all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo: dict[str, str] = {}
        for rows, data, off in blocks(batches, "text"):
            raw = data.tobytes()
            found = [sorted(marks_of(restored_text(raw[off[i]: off[i + 1]], shared.value, memo))) for i in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(pa.string()))], names=["y", "marks"])

    given = labelled_sample(docs, labels, "toxic", per_class).groupBy("text").agg(F.min("y").alias("y"), F.max("y").alias("other"))
    sample = given.where("y = other").select("y", "text")
    rows = cut_lineage(sample.mapInArrow(run, "y int, marks array<string>"))
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return {}
    all_rows = {r["y"]: r["n"] for r in labels.groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    share = (all_rows[0] / sizes[0]) / (all_rows[1] / sizes[1])
    least = max(MIN_ROWS, math.ceil(MIN_ROWS_SHARE * sizes[1]))
    counts = (rows.select("y", F.explode("marks").alias("mark")).groupBy("mark").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
              .where((F.col("bad") >= least) & (F.col("bad") >= PRECISION * (F.col("bad") + share * F.col("good")))))
    kept = {r["mark"]: r["good"] for r in counts.collect()}  # each in at least ``least`` of the sample's rows
    names = docs.sparkSession.sparkContext.broadcast(set(kept))

    def pick(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[m for m in row if m in names.value] for row in batch.column(0).to_pylist()], pa.list_(pa.string()))], names=["marks"])

    toxic = [set(r["marks"]) for r in rows.where("y = 1").select("marks").mapInArrow(pick, "marks array<string>").collect()]
    return choose_marks(toxic, kept, sizes[0], share, least)


def with_toxicity(docs: DataFrame, model: dict, marks: dict[str, float], keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` (text only on demand), and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast((model, sorted(marks.items())))

    def run(batches):
        import ahocorasick

        letters, listed = shared.value
        machine = ahocorasick.Automaton()
        for mark, precision in listed:
            machine.add_word(mark, precision)
        machine.make_automaton()
        memo: dict[str, str] = {}
        for rows, data, off in blocks(batches, "text"):
            raw, out = data.tobytes(), np.full(rows.num_rows, BASE_SCORE)
            if listed:
                for i in range(rows.num_rows):
                    out[i] = max((p for _, p in machine.iter(restored_text(raw[off[i]: off[i + 1]], letters, memo))), default=BASE_SCORE)
            keep = [j for j, f in enumerate(rows.schema) if keep_text or f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(j) for j in keep), pa.array(out)], names=[*(rows.schema.names[j] for j in keep), "score"])

    schema = T.StructType([f for f in docs.schema if keep_text or f.name != "text"]).add("score", "double")
    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> tuple[dict, dict[str, float]]:
    """(character model of the corpus, decision list of the labelled rows)."""
    model = character_model(docs)
    return model, learn_marks(docs, labels, model, per_class)


def drop_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows that are not judged toxic, their columns as they were."""
    model, marks = fit(docs, labels)
    other = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[docs[c] for c in other]).alias("row"), docs["text"].alias("text"))
    kept = with_toxicity(rows, model, marks, keep_text=True).where(F.col("score") < cut)
    return kept.select(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])
