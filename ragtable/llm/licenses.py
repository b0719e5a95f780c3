"""License scans (operator 5).

A span of a text matches a template if at most ``1 - min_coverage`` of the
template's word count are edits (words changed, left out or put in). Templates
are cut into word pairs, of which winnowing keeps the least of every ``window``
neighbours; an inverted index maps these fingerprints to (template, place). A
text's pairs are looked up in it, hits on nearby diagonals pick candidate
places, and a banded alignment of the template's words with the words there
reports the matched share of the template (coverage) and the span.

No match is missed (``plan``): ``x`` edits leave a template of ``m`` words in at
most ``x + 1`` whole runs, which hold a least number of fingerprints, and all
places of a match lie on ``x + 1`` neighbouring diagonals. The window is the
widest that surely leaves two fingerprints, so ordinary prose makes few
candidates. Where no two words need stay together, single words are looked up.

Templates are a stated set (rows license_id, text and, if there, must: words a
match has to hold, or with a leading ``-`` must not hold); the index goes to every task and its size is checked.
Defined results: null or empty texts and templates without words match nothing;
an empty table gives no rows; a template's overlapping matches are reported
once, the least edits first; matches of different templates may overlap; texts
without a match have zero matches and an empty list; repeated rows are scanned
each; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import ALNUM_BYTES, Words, blocks, mix64, word_hashes
from .license_texts import TEMPLATES

MIN_COVERAGE = 0.8
MAX_TEMPLATE_BYTES = 64 << 20
_MATCH = pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
_MATCHES = "array<struct<license_id:string,coverage:double,start:long,end:long>>"
_EDIT, _MISS = np.int64(1) << np.int64(44), np.int64(1) << np.int64(22)


def _grams(hashes: np.ndarray, k: int) -> np.ndarray:
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out += hashes[j: j + n] * (np.uint64(0x9E3779B97F4A7C15) ** np.uint64(2 * j + 1))
    return mix64(out + np.uint64(k))


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the fingerprints: the rightmost least gram of every ``window`` neighbours."""
    if len(grams) <= window:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, window)[:, ::-1]
    return np.unique(np.arange(len(views)) + window - 1 - views.argmin(axis=1))


def plan(m: int, min_coverage: float = MIN_COVERAGE) -> tuple[int, int, int, int]:
    """(gram, window, least hits, edits) for a template of ``m`` words.

    With x edits the m - x words left lie in at most x + 1 runs; a run of n words holds n - gram + 1 grams and so
    floor((n - gram + 1) / window) fingerprints at least; F in all leave room for runs * (gram + window - 2) + F * window words.
    """
    edits = int((1 - min_coverage) * m + 1e-9)
    left, runs = m - edits, edits + 1
    gram = 2 if -(-left // runs) >= 2 else 1
    sure = lambda w: -(-(left - runs * (gram + w - 2)) // w)
    widest = range(max(1, -(-left // runs) - gram + 1), 0, -1)
    window = next((w for w in widest if sure(w) >= 2), 1)
    return gram, window, max(1, sure(window)), edits


def align(template: np.ndarray, words: np.ndarray, shift: int, band: int) -> tuple[int, int, int, int]:
    """(matched words, first, end, edits) of the alignment of the whole ``template`` with a span of ``words`` with the fewest edits, then
    the most matches, then the shortest span; template word i meets words i + shift - band to i + shift + band."""
    template, words = np.asarray(template), np.asarray(words)
    m, n, width = len(template), len(words), 2 * band + 1
    steps = np.arange(width, dtype=np.int64)
    lo = shift - band
    far = _EDIT * (m + width + 2)
    at = steps + lo
    best = np.where((at >= 0) & (at <= n), np.int64(n) - at, far)  # edits, unmatched, then n - first
    for i in range(m):
        at = steps + (i + lo)  # the text word that is met here
        inside = (at >= 0) & (at < n)
        same = np.zeros(width, dtype=bool)
        same[inside] = words[at[inside]] == template[i]
        met = np.where(inside, best + np.where(same, 0, _EDIT + _MISS), far)
        row = np.full(width, far)
        # place d of the next row stands behind word i + d + lo: after meeting it, or (from d + 1) after leaving template word i out
        row[:] = met
        row[:-1] = np.minimum(row[:-1], best[1:] + _EDIT + _MISS)
        row = np.minimum.accumulate(row - steps * _EDIT) + steps * _EDIT  # text words put in
        end = steps + (i + 1 + lo)
        row[(end < 0) | (end > n)] = far
        best = row
    d = int(np.argmin(best))
    edits, rest = divmod(int(best[d]), int(_EDIT))
    missed, back = divmod(rest, int(_MISS))
    return m - missed, n - back, d + m + lo, edits


class _Template(NamedTuple):
    name: str
    words: np.ndarray
    must: np.ndarray
    bar: np.ndarray
    need: int
    edits: int


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return word_hashes(raw, Words(raw, np.array([0, len(raw)]), ALNUM_BYTES))


class _Index:
    """Fingerprints of all templates of one gram length: sorted keys and their postings."""

    def __init__(self, gram: int, found: list[tuple[int, int, int]]):
        key, self.template, self.place = (np.array(x, dtype=t) for x, t in zip(zip(*sorted(found)), (np.uint64, np.int64, np.int64), strict=True))
        self.gram = gram
        self.keys, self.first, self.count = np.unique(key, return_index=True, return_counts=True)

    def hits(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, template, shift) of every hit in a block."""
        grams = _grams(hashes, self.gram)
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        pos = np.flatnonzero(self.keys[at] == grams)
        pos = pos[words.doc[pos] == words.doc[pos + self.gram - 1]] if len(pos) else pos
        n = self.count[at[pos]]
        posting = np.repeat(self.first[at[pos]], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        pos = np.repeat(pos, n)
        return words.doc[pos], self.template[posting], pos - self.place[posting]


def _compile(rows: list[tuple[str, str, str]], min_coverage: float) -> tuple[list[_Template], list[_Index]]:
    templates, found = [], {}
    for name, text, must in rows:
        words, named = _hashes(text), (must or "").split()
        if not len(words):
            continue
        gram, window, need, edits = plan(len(words), min_coverage)
        grams = _grams(words, gram)
        found.setdefault(gram, []).extend((int(grams[i]), len(templates), int(i)) for i in winnow(grams, window))
        templates.append(_Template(name, words, _hashes(" ".join(w for w in named if w[0] != "-")), _hashes(" ".join(w for w in named if w[0] == "-")), need, edits))
    return templates, [_Index(g, f) for g, f in found.items()]


def candidates(templates: list[_Template], indexes: list[_Index], words: Words, hashes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, template, shift, band): the places to align, nearby diagonals taken together."""
    parts = [x.hits(words, hashes) for x in indexes]
    doc, which, shift = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3
    order = np.lexsort((shift, which, doc))
    doc, which, shift = doc[order], which[order], shift[order]
    need, edits = np.array([t.need for t in templates], np.int64)[which], np.array([t.edits for t in templates], np.int64)[which]
    start = np.arange(len(doc))
    last = start + need - 1
    ok = last < len(doc)
    last = np.minimum(last, len(doc) - 1)
    ok &= (doc[last] == doc) & (which[last] == which) & (shift[last] - shift <= edits)
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    np.add.at(cover, start[ok], 1)
    np.add.at(cover, last[ok] + 1, -1)
    pick = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
    out: list[tuple[int, int, int, int]] = []
    for d, t, s in zip(doc[pick].tolist(), which[pick].tolist(), shift[pick].tolist(), strict=True):
        near = max(2, templates[t].edits // 2)
        if not out or out[-1][:2] != (d, t) or s - out[-1][2] > near:
            out.append((d, t, s + near, templates[t].edits + near))  # diagonals s to s + 2 * near, each with its own edits around it
    return out


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(license_id, text) of a folder of text files, one license each, named by its file."""
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("_metadata.file_path", "/"), -1)), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("license_id"), F.col("value").alias("text"))


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """doc_id, n_matches, matches (license_id, coverage, start, end as character offsets) for every row."""
    spark = docs.sparkSession
    if templates is None:
        rows = TEMPLATES
    else:
        size = templates.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > MAX_TEMPLATE_BYTES:
            raise ValueError(f"templates of {size} bytes; split them in sets of at most {MAX_TEMPLATE_BYTES}")
        must = F.col("must") if "must" in templates.columns else F.lit("")
        rows = [tuple(r) for r in templates.where("text IS NOT NULL").select("license_id", "text", must).collect()]
    shared = spark.sparkContext.broadcast(rows)

    def run(batches):
        table, indexes = _compile(shared.value, min_coverage)
        for batch, data, off in blocks(batches, "text"):
            words = Words(data, off, ALNUM_BYTES)
            hashes = word_hashes(data, words)
            found: dict[tuple[int, int], set] = {}
            for doc, t, shift, band in candidates(table, indexes, words, hashes) if len(hashes) else ():
                m = len(table[t].words)
                a, b = max(words.bounds[doc], shift - band), min(words.bounds[doc + 1], shift + m + band)
                n, first, end, edits = align(table[t].words, hashes[a:b], shift - a, band)
                span = hashes[a + first: a + end]
                if edits <= table[t].edits and np.isin(table[t].must, span).all() and not np.isin(table[t].bar, span).any():
                    found.setdefault((doc, t), set()).add((edits, -n, a + first, a + end))
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for (doc, t), spans in found.items():
                taken: list[tuple[int, int]] = []
                here = off[doc]
                lead = np.cumsum((data[here: off[doc + 1]] & 0xC0) != 0x80)
                for _, n, a, b in sorted(spans):
                    if all(b <= c or a >= d for c, d in taken):
                        taken.append((a, b))
                        start, end = int(words.start[a] - here), int(words.end[b - 1] - here)
                        out[doc].append({"license_id": table[t].name, "coverage": -n / len(table[t].words), "start": int(lead[start]) - 1, "end": int(lead[end - 1])})
            for one in out:
                one.sort(key=lambda r: (r["start"], r["end"], r["license_id"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in out], pa.int64()), pa.array(out, pa.list_(_MATCH))], names=["doc_id", "n_matches", "matches"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_matches long, matches {_MATCHES}")
