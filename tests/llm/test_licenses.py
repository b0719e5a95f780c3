"""The license scan against edit distances of every template with every span, and its defined results."""

import re

import numpy as np
import pytest

from ragtable.llm import licenses
from ragtable.llm.license_texts import NOTICES, TEMPLATES, WHOLE

WORDS = "the of and to a in this software license is under or any for copy use with provided work code value table of the".split()


def _words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def _least_edits(template, text):
    """Fewest edits of the whole template with any span of the text."""
    row = [0] * (len(text) + 1)
    for i, t in enumerate(template):
        new = [i + 1]
        for j, w in enumerate(text):
            new.append(min(row[j] + (t != w), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def _edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = int(rng.integers(0, len(words)))
        kind = int(rng.integers(0, 3))
        words[at: at + (kind != 1)] = [] if kind == 2 else [f"x{rng.integers(0, 99)}"]
    return words


def test_scan_finds_what_edit_distance_finds(spark):
    rng = np.random.default_rng(7)
    texts = []
    for name, text, _ in TEMPLATES:
        m = len(_words(text))
        for n in sorted({0, 1, m // 10, m // 5, m // 5 + 1}):
            fill = [" ".join(rng.choice(WORDS, int(rng.integers(0, 40)))) for _ in range(2)]
            texts.append(f"{fill[0]} {' '.join(_edited(rng, _words(text), n))}\n{fill[1]}")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    free = spark.createDataFrame([(n, t) for n, t, _ in TEMPLATES], "license_id string, text string")
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(docs, free).collect()}
    seen = 0
    for doc, text in enumerate(texts):
        words = _words(text)
        expected = {n for n, t, _ in TEMPLATES if _least_edits(_words(t), words) <= int(0.2 * len(_words(t)) + 1e-9)}
        assert {m.license_id for m in got[doc]} == expected
        for m in got[doc]:
            template = _words(dict((n, t) for n, t, _ in TEMPLATES)[m.license_id])
            span = _words(text[m.start: m.end])
            assert _least_edits(template, span) <= 0.2 * len(template) + 1e-9 and len(span) <= 1.2 * len(template) + 1e-9
            seen += 1
    assert seen > len(texts) // 2


def test_notices_need_their_naming_words(spark):
    texts = ["Released under an MIT License", "Released under the BSD License", "SPDX-License-Identifier: Apache-2.0", "Licensed under CC BY-NC 4.0",
             "This work is licensed under the GNU Lesser General Public License, version 3."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: {m.license_id for m in r.matches} for r in licenses.scan_licenses(docs).collect()}
    assert got == {0: {"MIT"}, 1: set(), 2: {"SPDX-Apache-2.0"}, 3: {"CC-BY-NC-4.0"}, 4: {"LGPL-3.0"}}


def test_defined_results(spark):
    mit = WHOLE[0][1]
    texts = [None, "", "mit " * 30000, "é " * 300 + mit + " ü " + mit, "under the " * 5000, mit, mit]
    docs = spark.createDataFrame([(i, t, "s", 0.0) for i, t in enumerate(texts)], "doc_id long, text string, license_id string, matches double")
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert [rows[i].n_matches for i in (0, 1, 2, 4)] == [0] * 4
    full = [m for m in rows[3].matches if m.license_id == "MIT-full"]
    assert [texts[3][m.start: m.end] + "." for m in full] == [mit, mit] and {m.coverage for m in full} == {1.0}
    assert rows[5].matches == rows[6].matches and {m.license_id for m in rows[5].matches} == {"MIT-full", "MIT-text"}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    none = spark.createDataFrame([("a", None), ("b", "..")], "license_id string, text string")
    assert {r.n_matches for r in licenses.scan_licenses(docs, none).collect()} == {0}


def test_templates_from_files(spark, tmp_path):
    for name, text, _ in NOTICES[:2]:
        (tmp_path / f"{name}.txt").write_text(text)
    got = licenses.read_templates(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted((n, t) for n, t, _ in NOTICES[:2])
    docs = spark.createDataFrame([(1, "So: " + NOTICES[0][1])], "doc_id long, text string")
    assert [m.license_id for m in licenses.scan_licenses(docs, got).first().matches] == [NOTICES[0][0]]


@pytest.mark.parametrize("m", [1, 2, 3, 4, 5, 7, 8, 12, 16, 33, 165, 5000])
def test_plan_is_no_stricter_than_the_worst_edits(m):
    gram, window, need, edits = licenses.plan(m)
    rng = np.random.default_rng(m)
    for _ in range(20):
        words = rng.integers(0, 1 << 60, m, dtype=np.uint64)
        places = licenses.winnow(licenses._grams(words, gram), window)
        runs = np.sort(rng.choice(m, edits, replace=False)) if _ else np.linspace(0, m - 1, edits + 2).astype(int)[1:-1]
        hurt = np.zeros(m, dtype=bool)
        hurt[runs] = True
        assert sum(not hurt[p: p + gram].any() for p in places) >= need
