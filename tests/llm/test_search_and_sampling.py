"""Operators 11 to 13 against brute force on small rows, with nulls, empty and long texts, ties, repeats and clashing columns."""

import math
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from ragtable.llm import neighbours, periodic, queries, resampling

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _runs(w):
    """All runs by their definition: every period, every maximal stretch, smallest period by trial."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            x = w[i: j + q]
            if j > i and len(x) >= max(6, 4 * q) and all(x[:-p] != x[p:] for p in range(1, q)):
                out.append((i, len(x), q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in out)


def _periodic_texts():
    rng = np.random.default_rng(4)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x " + "ab ab c " * 9 + "y", "A a " * 20, "é é " * 6]
    for k in range(60):
        w = rng.integers(0, 1 + k % 7, int(rng.integers(1, 150))).tolist()
        for _ in range(k % 4):
            s, p = int(rng.integers(0, len(w))), int(rng.integers(1, 12))
            for i in range(s, min(len(w), s + int(rng.integers(1, 80)))):
                w[i] = w[s + (i - s) % p]
        texts.append(" ".join(f"w{x}" for x in w))
    return [*texts, texts[7], " ".join(f"u{i % 300}" for i in range(9000)), " ".join(f"v{i}" for i in range(20000))]


def test_periodic_runs_brute_force(spark):
    texts = _periodic_texts()
    rows = [(i, t, "k", 7, i) for i, t in enumerate(texts)] + [(7, texts[7], None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, runs long, n_words long").repartition(3)
    got = periodic.periodic_runs(docs).collect()
    assert len(got) == len(rows) and got[0].__fields__ == [*docs.columns, "periodic"]
    small = {i: t for i, t in enumerate(texts) if len(t or "") < 4000}
    for r in got:
        w = WORDS.findall(r.text or "")
        found = [(x.start, x["length"], x.period) for x in r.periodic.runs]
        assert r.periodic.n_words == len(w)
        if r.doc_id in small:
            assert found == _runs(w), r.text
        drop = {i for s, n, q in found for i in range(s + q, s + n)}
        assert r.periodic.collapsed == " ".join(x for i, x in enumerate(w) if i not in drop)
    by_id = {r.doc_id: r for r in got}
    assert [(x.start, x["length"], x.period) for x in by_id[len(texts) - 2].periodic.runs] == [(0, 9000, 300)]
    assert by_id[len(texts) - 1].periodic.runs == []
    assert periodic.periodic_runs(spark.createDataFrame([], docs.schema)).count() == 0


def test_synchronising_positions_are_consistent_and_dense():
    rng = np.random.default_rng(8)
    n, t = 3000, 8
    words = rng.integers(0, 3, n)
    words[500:700] = [1, 2] * 100
    windows = {tuple(words[i: i + t].tolist()): np.uint64(rng.integers(1, 1 << 62)) for i in range(n - t + 1)}
    names = np.array([windows.get(tuple(words[i: i + t].tolist()), np.uint64(0)) for i in range(n)], dtype=np.uint64)
    flat = np.array([i + t <= n and any(all(words[i + j] == words[i + j + p] for j in range(t - p)) for p in (1, 2)) for i in range(n)])
    left = n - np.arange(n)
    got = set(periodic._synchronised(names, flat, left, t).tolist())
    by_context = {}
    for i in range(n - 2 * t + 1):
        by_context.setdefault(tuple(words[i: i + 2 * t].tolist()), set()).add(i in got)
    assert all(len(v) == 1 for v in by_context.values())  # the context alone decides
    for i in range(n - 3 * t):
        assert got & set(range(i, i + t)) or flat[i: i + 2 * t].all()


def test_repetitive_texts_follow_the_rule(spark):
    rows = [(i, " ".join(f"t{j}" for j in range(i % 40))) for i in range(200)] + [(None, "a b"), (11, None)]
    got = queries.repetitive_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    changed = 0
    for (i, text), r in zip(rows, got, strict=True):
        w, h = WORDS.findall(text or ""), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
            changed += 1
        assert WORDS.findall(r.text or "") == w
    assert changed > 10


def _features(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [zlib.crc32(" ".join(w[i: i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def test_resampling_brute_force(spark):
    rng = np.random.default_rng(3)
    prose = [" ".join(f"W{x}," for x in rng.integers(0, 300, int(rng.integers(15, 60)))) for _ in range(120)]
    texts = [None, "", "--- !!", "one", "Zoë ÄÖ x7", "a" * 70000 + " " + "b " * 30, *prose, prose[0], prose[0]]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, prose[1], "r", 1), (8, texts[8], "r", 1)]
    target = [("W1, W2, W3 W4",), (None,), ("Zoë " * 9,)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, rank int").repartition(4)
    aim = spark.createDataFrame(target, "text string")
    ours = Counter(b for _, t, *_ in rows for b in _features(t)[1])
    theirs = Counter(b for (t,) in target for b in _features(t)[1])
    s_all, t_all = sum(ours.values()), sum(theirs.values())
    gain = {b: math.floor(1000 * math.log((theirs[b] + 1) * (s_all + 10000) / ((ours[b] + 1) * (t_all + 10000)))) for b in range(10000)}
    want = []
    for i, t, *_ in rows:
        w, f = _features(t)
        h = int(sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        want.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0] is None, x[0] or 0, x[2], x[3]))
    draw = len(able) * 40 // 100
    ranked = Counter((*x, n + 1 if n < draw else None) for n, x in enumerate(able)) + Counter((*x, None) for x in want if x[1] < 20)
    got = resampling.resample(docs, aim, percent=40).collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r.rank) for r in got) == ranked
    none = resampling.resample(docs.limit(0), aim.limit(0))
    assert none.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"] and none.count() == 0


def test_words_with_offsets_and_crc_moves():
    text = "  Ünïcode, ÅB-c 12\n" + "lorem IPSUM 9 " * 400
    got = resampling.words_with_offsets(text)
    assert [w for w, _ in got] == _features(text)[0]
    low = text.translate({c: c + 32 for c in range(65, 91)})
    assert all(low[a:b] == w for w, (a, b) in got)
    for n in (0, 1, 2, 7, 63, 1000):
        a, b = b"some words", bytes(range(256))[:n % 200] * (1 + n // 200)
        moved = resampling._move(np.array([zlib.crc32(a)], dtype=np.uint32), resampling._moves(len(b)))[0]
        assert int(moved) ^ zlib.crc32(b) == zlib.crc32(a + b)


def _exact(rows, asked, k):
    out = {}
    for q, v in asked:
        s = sorted(((-float(v @ w) / (np.linalg.norm(v) * np.linalg.norm(w)), i) for i, w in rows if i != q))
        out[q] = [(i, -c) for c, i in s[:k]]
    return out


@pytest.mark.parametrize("n", [3, 700])
def test_neighbours_recall_and_scores(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 24))
    if n > 100:
        x[200:420] = x[200]  # a third of all rows alike
        x[420:520] = x[420] + 0.01 * rng.standard_normal((100, 24))
    rows = [(i, v.tolist(), "l") for i, v in enumerate(x)]
    odd = [(n + 1, None, "l"), (n + 2, [0.0] * 24, "l"), (n + 3, [float("nan")] * 24, "l"), (n + 4, [1.0, None] * 12, "l"), (n + 5, [1.0] * 23, "l"), (None, [1.0] * 24, "l"), rows[0]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, rank string").repartition(3)
    asked = table.where("vec_id % 20 = 0 or vec_id is null or vec_id > 600").selectExpr("vec_id as query_id", "embedding")
    got = neighbours.Index(table).search(asked, k=5).collect()
    pairs = [(i, v) for i, v in enumerate(x)]
    want = _exact(pairs, [(i, v) for i, v in pairs if i % 20 == 0 or i > 600], 5)
    found = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
        a, b = x[r.query_id], x[r.vec_id]
        assert abs(r.score - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-12
    assert set(found) == set(want) and all(len(v) == min(5, n - 1) for v in found.values())
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    if n > 100:  # ties among equal vectors go to the smaller vec_id
        assert [i for i, _ in found[200]] == [201, 202, 203, 204, 205] and [i for i, _ in found[400]] == [200, 201, 202, 203, 204]


def test_neighbours_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert neighbours.Index(none).search(none.withColumnRenamed("vec_id", "query_id")).count() == 0
