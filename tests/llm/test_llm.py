"""Training-data operators against brute force on small rows, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ragtable.llm import chat, decontam, licenses, line_rules, mixing, near_dedup, quality, suffix_dedup, toxicity, url_graph

WORD = r"[^\x20\x09-\x0D]+"
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, node long, rk long, score double, "
          "hits string, row string, spans string, size long, bucket string, comp long")


def _prose(seed, n, vocabulary=4000):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{i}" for i in rng.integers(0, vocabulary, n))


def _texts():
    base, other = _prose(1, 120), _prose(2, 300)
    shared = _prose(3, 110)
    near = [" ".join([*base.split()[:i], f"x{i}", *base.split()[i + 1:]]) for i in range(0, 100, 7)]
    return [None, "", "  \n\t ", "one", "ONE", "one two", base, base, base.upper(), *near, other, f"{_prose(4, 90)} {shared} tail", f"head {shared} {_prose(5, 60)}",
            "ab " * 400, "é" * 900, "é" * 900 + "x", _prose(6, 30000), "a\nb\nb\n\nb", "licence text. Released under the MIT License. ok"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", [None, "b", "B", "a"][i % 4], len(t or ""), i, -i, 0.5, "h", "r", "s", 3, "k", 9) for i, t in enumerate(_texts())]
    rows += [rows[9], (None, _texts()[6], "en", "b", 1, 0, 0, 0.1, "h", "r", "s", 3, "k", 9), (None, None, None, None, None, 0, 0, 0.1, "h", "r", "s", 3, "k", 9)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _sets(text, k):
    w = re.findall(WORD, (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute_force(docs, empty, k):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    known = [(i, _sets(t, k)) for i, t in rows if i is not None]
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(known)), 2):
        s, t = known[a][1], known[b][1]
        if s and 100 * len(s & t) >= 80 * len(s | t):
            x, y = find(a), find(b)
            root[max(x, y, key=lambda v: known[v][0])] = min(x, y, key=lambda v: known[v][0])
    want = Counter((i, len(s), known[find(n)][0]) for n, (i, s) in enumerate(known))
    got = near_dedup.near_duplicate_components(docs, k=k).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows) and near_dedup.near_duplicate_components(empty).count() == 0


def test_stage_keeps_one_of_each_component(spark, docs):
    rows = docs.where("doc_id is not null")
    known = sorted({(r.doc_id, r.text) for r in rows.collect()}, key=lambda r: r[0])
    sets = [_sets(t, 5) for _, t in known]
    comp = list(range(len(known)))
    for a, b in itertools.combinations(range(len(known)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            comp = [min(comp[a], comp[b]) if c in (comp[a], comp[b]) else c for c in comp]
    want = [known[i] for i in sorted(set(comp))]
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.remove_near_duplicates(spark, rows, "").collect()), key=lambda r: r[0])
    assert got == want and len(got) < len(known)


def test_blocks_find_links_between_components(spark):
    """A group of copies with one to eight edits: buckets with several components go through the blocks."""
    base = _prose(11, 150).split()
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.choice(150, 1 + i % 9, replace=False):
            w[p] = f"e{i}_{p}"
        rows.append((i, " ".join(w)))
    sets = [_sets(t, 2) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = near_dedup.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), k=2, block_bytes=20000)
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: find(i) for i in range(len(rows))}


def test_min_matches_bounds():
    least = near_dedup.min_matches(0.8)
    assert least == sorted(least) and least[-1] < 0.8 * 128 and near_dedup.min_matches(0.8, miss=1e-2)[-1] > least[-1]


def _repeats(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p: p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        m = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p: p + length]] > 1:
                m[p: p + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, m, strict=True) if not y)
        out.append((len(b), sum(m), len(re.findall(b"\1+", bytes(m))), hashlib.sha256(kept).hexdigest()))
    return out


def test_long_repeats_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *v) for (i, _), v in zip(rows, _repeats([t for _, t in rows], 400), strict=True))
    assert Counter(tuple(r) for r in suffix_dedup.repeat_digest(docs).collect()) == want
    assert suffix_dedup.repeat_digest(empty).count() == 0 and suffix_dedup.remove_repeats(empty).count() == 0
    cut = suffix_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect())


def test_passages_of_51_words_go_from_400_bytes_on(spark):
    """op7 counts bytes, not words: a repeated passage of 51 words stays up to 399 bytes and goes whole from 400 on."""
    rng = np.random.default_rng(77)
    rows, want = [], {}
    for k, n in enumerate([340, 399, 400, 401, 700]):
        letters = rng.integers(97, 123, n)
        letters[np.linspace(5, n - 6, 50).astype(int)] = 32
        passage = bytes(letters.tolist()).decode()
        assert len(passage.split()) == 51
        for i, edge in ((2 * k, "A"), (2 * k + 1, "B")):
            text = f"{_prose(200 + i, 90)}{edge}{passage}{edge}{_prose(300 + i, 30)}"
            rows.append((i, text))
            kept = text.replace(passage, "") if n >= 400 else text
            want[i] = (len(text), len(text) - len(kept), int(n >= 400), hashlib.sha256(kept.encode()).hexdigest())
    got = suffix_dedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want


def test_stage_cuts_passages_of_over_50_words(spark, docs):
    short = " ".join(f"s{i}" for i in range(51))  # under 400 bytes
    less = " ".join(f"l{i}" for i in range(50))
    long = _prose(50, 200)
    texts = [t for t in _texts()] + [f"{_prose(51, 30)} {short} {_prose(52, 9)}", f"{short.replace(' ', chr(10))}  end", f"{_prose(53, 80)} {less}", f"{less} {_prose(54, 80)}",
                                     f"{short} {long}", f"é {long} é", " ".join(["a"] * 52), " ".join(["a"] * 51), " ".join(["b"] * 51), f"x {_prose(55, 70)}", f"y\t{_prose(55, 70)} z"]
    rows = [(i, t, "en", "b", len(t or ""), 0, 0, 0.1, "h", "r", "s", 3, "k", 9) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in corpus_pipeline.remove_repeats(spark, spark.createDataFrame(rows, docs.schema), "").collect()}
    at = [[(m.start(), m.end(), m.group()) for m in re.finditer(WORD, t or "")] for t in texts]
    seen = Counter(tuple(x[2] for x in w[i: i + 51]) for w in at for i in range(len(w) - 50))
    for i, (t, w) in enumerate(zip(texts, at, strict=True)):
        cut = {x for j in range(len(w) - 50) if seen[tuple(x[2] for x in w[j: j + 51])] > 1 for x in range(j, j + 51)}
        gone = {k for x in cut for k in range(w[x][0], w[x + 1][0] if x + 1 in cut else w[x][1])}
        assert got[i] == "".join(c for k, c in enumerate(t or "") if k not in gone), i
    assert "s7" not in got[len(_texts())] and "l7" in got[len(_texts()) + 2]


def test_whole_characters():
    raw = "aéb".encode()
    assert suffix_dedup.whole_characters(raw, [(0, 2)]) == [(0, 1)] and suffix_dedup.whole_characters(raw, [(2, 4)]) == [(3, 4)]


def test_decontamination_brute_force(spark, docs, empty):
    base = _prose(1, 120).split()
    items = [(1, " ".join(base[5:40])), (2, "one two"), (3, None), (4, " .. "), (10, " ".join(base[20:33]).upper()), (11, "ééé w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        w, hit, names = words(r.text), set(), set()
        for i, t in items:
            v = words(t)
            n = min(13, len(v))
            wins = {tuple(v[j: j + n]) for j in range(len(v) - n + 1)} if v else set()
            for j in range(len(w) - n + 1):
                if tuple(w[j: j + n]) in wins:
                    hit.update(range(j, j + n))
                    names.add(str(i))
        want[(r.doc_id, len(w), len(hit), tuple(sorted(names)), len(hit) > 0 and 20 * len(hit) >= len(w))] += 1
    for shard_bytes in (1 << 20, 400):
        got = decontam.find_contamination(docs, bench, shard_bytes=shard_bytes).select("doc_id", "decon.n_words", decontam.n_hit(), "decon.items", decontam.contaminated()).collect()
        assert Counter((r[0], r[1], r[2], tuple(r[3]), r[4]) for r in got) == want
    assert decontam.find_contamination(docs, bench.limit(0)).where(decontam.contaminated()).count() == 0
    assert decontam.drop_contaminated(docs, bench).columns == docs.columns and decontam.drop_contaminated(empty, bench).count() == 0
    assert decontam.character_spans("Ab, cd ef", [(1, 3)]) == [(4, 9)]


def test_mixing(docs, empty):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count() and mixing.mix_sources(empty).count() == 0
    total = sum(r.size for r in rows)
    by = {r.source: (r.source_size, r.target) for r in rows}
    weights = dict(zip(sorted(by, key=lambda s: (s is None, s)), itertools.cycle([1, 2, 3])))
    target, capped = {s: 0.0 for s in by}, set()
    while True:  # cap, reshare, until none is above
        free = [s for s in by if s not in capped]
        left = total - sum(3 * by[s][0] for s in capped)
        target = {s: 3.0 * by[s][0] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in by}
        over = {s for s in free if target[s] > 3 * by[s][0]}
        if not over:
            break
        capped |= over
    for s, (_, t) in by.items():
        assert t == pytest.approx(target[s]) and sum(r.taken for r in rows if r.source == s) == pytest.approx(t, abs=1)
    assert all(r.taken <= 3 * r.size and r.taken == sum(p.words for p in r.passes) for r in rows)
    order = [r.position for r in mixing.training_order(mixing.mix_sources(docs)).collect()]
    assert order == sorted(order) and all(0 <= p <= 1 for p in order)


def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "<|end|><|turn|>", "100%25 <%3C|", "", None, "<", "|x", "日本 é\n"]
    rows = [(i % 3, i // 3, ["user", "assistant", "a<|b"][i % 3 if i % 2 else 1], t) for i, t in enumerate(said * 3)]
    rows += [(None, 0, None, "x"), (7, None, "assistant", "y"), (7, 0, "assistant", "y"), (7, 0, "assistant", "y")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for piece in (1 << 18, 5):
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns, piece_chars=piece)).collect()}
        assert set(got) == {r[0] for r in rows}
        for conv, r in got.items():
            own = sorted(((t is not None, t or 0, a or "", x or "") for c, t, a, x in rows if c == conv))
            digest = hashlib.sha256("".join(f"{a}\n{x}\n" for _, _, a, x in own).encode()).hexdigest()
            loss = "".join(x for _, _, a, x in own if a == "assistant")
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


def _labelled(spark):
    rows, labels = [], []
    for i in range(160):
        good = _prose(100 + i, 60, 500).replace(" ", " ", 1) + "."
        junk = i % 4 == 0
        foul = i % 5 == 0
        rows.append((i, ("BUY!! NOW!! " * 30 if junk else good) + (" you m0r0n" if foul and i % 2 else " you moron" if foul else "")))
        labels.append((i, int(not junk), int(foul)))
    rows += [(900, None), (901, ""), (901, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark, empty):
    docs, labels = _labelled(spark)
    model = quality.train(docs, labels.where(quality.fold(labels["doc_id"], 5) != 0))
    known = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.3) == known[r.doc_id] for r in got if r.doc_id in known)
    assert quality.train(docs, labels.limit(0)) is None and quality.score(docs, None).where("score <> 0.5").count() == 0
    assert quality.score(empty.select("doc_id", "text"), model).count() == 0


def test_quality_learns_from_every_labelled_row(spark, monkeypatch):
    """Means, pairs and threshold are those of all labelled rows, more than any sample, and the same however they are dealt."""
    texts = spark.range(9000).selectExpr("id AS doc_id", "IF(id % 9 = 0, repeat(concat('!! ', id % 7, ' '), 4), concat('plain words of text ', id % 11, '.')) AS text")
    labels = texts.selectExpr("doc_id", "IF(doc_id % 9 = 0, 0, 1) AS quality")
    model = quality.train(texts, labels)
    x = np.array([r.x for r in quality.with_features(texts).collect()])
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], x.std(axis=0) + 1e-3)
    rows = quality.labelled_features(texts, labels, "quality")
    dealt = quality._dealt(rows, {0: 1000, 1: 8000})
    assert dealt.select("doc_id").distinct().count() == 9000
    assert int(quality._summed(dealt, quality._loss_sums(np.zeros(x.shape[1]), model["mean"], model["scale"]))[0]) > 8000 * 32
    monkeypatch.setattr(quality, "NEAR", 100)
    scored = spark.range(5000).selectExpr("CAST(id % 2 AS INT) AS y", "CAST((id * 7919) % 5000 AS DOUBLE) AS s")
    assert abs(quality._threshold(scored, {0: 1 / 5000, 1: 1 / 5000}, 0.3) - 1499) <= 1
    assert quality._threshold(scored.withColumn("s", F.lit(2.0)), {0: 1 / 5000, 1: 1 / 5000}, 0.3) == 2.0


def test_toxicity_held_out(spark, empty):
    docs, labels = _labelled(spark)
    model, marks = toxicity.fit(docs, labels.where(quality.fold(labels["doc_id"], 3) != 1))
    assert [toxicity.restore(s, model) for s in ("m0r0n", "m o r o n", "moooron", "m.0.r.o.n")] == ["moron"] * 4
    known = {r.doc_id: r.toxic for r in labels.collect()}
    got = toxicity.with_toxicity(docs, model, marks).collect()
    assert all((r.score >= 0.7) == bool(known.get(r.doc_id)) for r in got) and len(got) == docs.count()
    kept = toxicity.drop_toxic(empty, labels)
    assert kept.columns == empty.columns and kept.count() == 0
    assert toxicity.learn_marks(docs, labels.limit(0), model) == {}


def test_labelled_sample_is_bounded(spark):
    """One row for each sampled id, however often it is repeated; ids labelled both ways, null ids and other labels are not learned from."""
    docs = spark.range(5000).selectExpr("1L AS doc_id", "concat('text ', id) AS text").union(spark.createDataFrame([(i, f"t{i}") for i in [*range(2, 30), None]], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 30)] + [(1, 1), (4, 1), (None, 1), (6, 7), (8, None)], "doc_id long, quality int")
    for bound in (5, 100):
        rows = quality.labelled_sample(docs, labels, "quality", bound).collect()
        by = Counter(r.y for r in rows)
        assert len({r.doc_id for r in rows}) == len(rows) and max(by.values()) <= bound
        assert all(r.y == r.doc_id % 2 and r.doc_id != 4 for r in rows)
        assert sorted(rows) == sorted(quality.labelled_sample(docs.repartition(3), labels.repartition(5), "quality", bound).collect())
    assert by == {1: 15, 0: 13}


def test_marks_are_words_not_fragments(spark):
    """Beginnings shared with plain words are no marks, though no labelled row shows it."""
    rows, labels = [], []
    for i in range(200):
        foul = i % 2
        rows.append((i, _prose(300 + i, 40, 500) + (f" you {['moron', 'pathetic idiot', 'disgusting clown'][i % 3]}" if foul else "")))
        labels.append((i, foul))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model, marks = toxicity.fit(docs, known)
    assert marks and all(toxicity.stands(m, {" moron ", " pathetic ", " idiot ", " disgusting ", " clown ", " you "}) for m in marks)
    plain = ["I would like more tea this morning", "She travelled by train to the district", "The path was closed, so we discussed it", "A clock and a closed idiom"]
    foul = ["those morons", "m0r0n!", "p a t h e t i c"]
    scores = {r.text: r.score for r in toxicity.with_toxicity(spark.createDataFrame([(t,) for t in plain + foul], "text string"), model, marks, keep_text=True).collect()}
    assert all(scores[t] < toxicity.CUT for t in plain) and all(scores[t] >= toxicity.CUT for t in foul)


def test_choose_marks_brute_force():
    toxic = [{" moron ", " mor", " moro", " moron", f" w{i} "} for i in range(30)] + [{" oaf ", " oaf", f" x{i} "} for i in range(10)]
    clean = {" oaf": 3}
    got = toxicity.choose_marks(toxic, clean, 40, 1.0)
    rows = {m: sum(m in r for r in toxic) for m in {m for r in toxic for m in r}}
    tried = [m for m in rows if rows[m] >= toxicity.MIN_ROWS and (m.endswith(" ") or f"{m} " in rows)]
    sure = [m for m in tried if 0.5 ** rows[m] * len(tried) <= toxicity.FALSE_MARKS and rows[m] / (rows[m] + clean.get(m, 0)) >= toxicity.PRECISION]
    assert sorted(sure) == [" moron", " moron ", " oaf "]
    assert got == {" moron": 30 / 30.5, " oaf ": 10 / 10.5}


def test_toxicity_long_and_spaced_spans(spark):
    docs, labels = _labelled(spark)
    model, marks = toxicity.fit(docs, labels)
    assert toxicity.readings("y o u m o r o n", model) == "you moron youmoron" and toxicity.readings("m o r o n", model) == "moron"
    spaced = " ".join("younow" * 30)  # over 80 characters
    texts = ["they say y o u m o r o n", "m" + "o" * 5000 + "ron", "M.0.r.o." * 1 + "n" * 60, f"{spaced} m o r o n", f"{spaced} n o w", "now " * 50, "m" + "0" * 50 + "r0n!"]
    got = {r.doc_id: r.score for r in toxicity.with_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, marks).collect()}
    assert [got[i] >= 0.7 for i in range(7)] == [True, True, True, True, False, False, True]


def test_split_words_brute_force():
    rng = np.random.default_rng(5)
    letters = "abc"
    for _ in range(60):
        grams = {x + y + z: -float(rng.uniform(0.2, 4)) for x in "^abc" for y in "^abc" for z in "abc$"}
        often = {"".join(rng.choice(list(letters), int(rng.integers(1, 4)))): -float(rng.uniform(1, 6)) for _ in range(5)}
        model = {"p": grams, "rest": {}, "none": -9.0, "words": often, "longest": 3}
        text = "".join(rng.choice(list(letters), 9))
        cuts = sorted(set(rng.integers(1, 9, 6).tolist()))

        def score(w):
            chain = f"^^{w}$"
            return max(often.get(w, -1e9), toxicity.UNKNOWN + sum(grams[chain[i: i + 3]] for i in range(len(chain) - 2)))  # noqa: B023

        def words(chosen):
            return [text[a:b] for a, b in itertools.pairwise([0, *chosen, 9])]  # noqa: B023

        every = [words(c) for k in range(len(cuts) + 1) for c in itertools.combinations(cuts, k)]
        assert sum(map(score, toxicity.split_words(text, cuts, model))) == pytest.approx(max(sum(map(score, w)) for w in every))


def test_viterbi_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        emit, move = rng.normal(size=7), rng.normal(size=(2, 2))
        score = lambda y: sum(e for e, v in zip(emit, y, strict=True) if v) + sum(move[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert tuple(line_rules.viterbi(emit, move)) == max(itertools.product((0, 1), repeat=7), key=score)


def test_line_rules(spark, docs, empty):
    known, labels = _labelled(spark)
    field = line_rules.train(known, labels)
    kept = {r.doc_id: r.kept for r in line_rules.line_rules(known, field).collect()}
    assert all(kept[r.doc_id] == bool(r.quality) for r in labels.collect()) and kept[900] is False
    for r, t in ((r, _texts()[r.doc_id]) for r in line_rules.line_rules(docs, None).collect() if r.doc_id is not None):
        w = re.findall(WORD, t or "")
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        wins = Counter(tuple(w[j: j + 5]) for j in range(len(w) - 4))
        cover = {x for j in range(len(w) - 4) if wins[tuple(w[j: j + 5])] > 1 for x in range(j, j + 5)}
        assert tuple(r)[1:7] == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover),
                                 len(w) < 10 or 100 * len(cover) > 20 * len(w))
    assert line_rules.line_rules(empty, field).count() == 0


def test_field_learns_from_all_lines(spark, monkeypatch):
    texts = ["\n".join(f"line {j} of some words here." for j in range(n)) for n in (3, 200, 201, 950)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(line_rules, "fit_field", lambda x, y: seen.extend(zip(x, y, strict=True)))
    line_rules.train(docs, labels)
    assert sorted((len(x), y) for x, y in seen) == sorted([(3, 0), (200, 1), (200, 0), (1, 0), *[(200, 1)] * 4, (150, 1)])
    every = [line_rules.line_table(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[1] for t in texts]
    assert sorted(map(tuple, np.concatenate([x for x, _ in seen]))) == sorted(map(tuple, np.concatenate(every)))


def test_licenses(docs, empty):
    found = [(m.license_id, _texts()[r.doc_id][m.start: m.end]) for r in licenses.scan_licenses(docs).collect() for m in r.matches]
    assert found == [("MIT", "Released under the MIT License")] and licenses.scan_licenses(empty).count() == 0
    assert licenses.align([1, 2, 3, 4], [9, 1, 2, 7, 3, 4, 9], 1, 3)[0] == 4


def test_url_rules_and_propagation(spark):
    pages = [(1, "http://A.net/x?y", '<a href="http://bad.io/">'), (2, "https://www.example.net/en/1", None), (3, "http://example.com/de/", ""), (4, "http://q.org/fr", "x"),
             (5, None, None), (6, "nothing", "y"), (7, "http://friend.io/a", '<a href="http://a.net/1"> <a href="/rel">'), (8, "http://a.net#z", ""), (8, "http://a.net#z", "")]
    got = {r.page_id: r for r in url_graph.judge_pages(spark.createDataFrame(pages, "page_id long, url string, html string"), threshold=0.05).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4, 5, 6)] == [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), (None, "allow"), (None, "allow"), (None, "allow")]
    assert (got[1].host, got[1].path, got[8].path, got[5].host) == ("a.net", "/x", "", "")
    assert got[7].distrust > 0 and got[7].verdict == "block"  # it links to a blocked host
    assert url_graph.judge_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_registered_threshold_with_links(spark):
    pages = [(1, "http://bad.net/", ""), (2, "http://bad.net?q", ""),  # fully blocked but for a page without a path
             (3, "http://farm.io/a", '<a href="//bad.net/x">'), (4, "http://farm.io/b", "<A class=x HREF=//BAD.net>"), (5, "http://fan.io/", '<a href="http://farm.io/">'),
             (6, "http://far.io/", '<a href="https://fan.io/">'), (7, "http://calm.io/", '<a href="/x"> <a href="//far.org/">'), (8, "http://far.org/fr/", "")]
    pages += [(10 + i, f"http://bad.net/{i}", None) for i in range(9)]
    tables = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in url_graph.judge_pages(tables).collect()}
    assert [got[i].verdict for i in range(1, 9)] == ["block", "block", "block", "block", "block", "block", "allow", "allow"]
    assert got[2].rule is None and got[2].distrust == pytest.approx(10 / 11) and got[8].trust == 1.0
    assert [got[i].distrust for i in (3, 5, 6)] == pytest.approx([10 / 11 * 0.85 ** k for k in (1, 2, 3)])
    assert {(r.src, r.dst, r.weight) for r in url_graph.links(tables).collect()} == {("farm.io", "bad.net", 2), ("fan.io", "farm.io", 1), ("far.io", "fan.io", 1), ("calm.io", "far.org", 1)}


def test_propagation_matches_power_iteration(spark):
    edges = [("a", "b", 1), ("b", "c", 2), ("b", "a", 1), ("c", "a", 1), ("a", "d", 3)]
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r.host: r for r in url_graph.propagate(seeds, spark.createDataFrame(edges, "src string, dst string, weight long"), rounds=8).collect()}
    for kind, list_, seed in (("trust", edges, {"a": 1.0}), ("distrust", [(b, a, w) for a, b, w in edges], {"d": 1.0})):
        out = Counter()
        for s, _, w in list_:
            out[s] += w
        rank = {h: seed.get(h, 0.0) for h in "abcd"}
        for _ in range(8):
            rank = {h: 0.15 * seed.get(h, 0.0) + 0.85 * (sum(rank[s] * w / out[s] for s, d, w in list_ if d == h) + (0 if out[h] else rank[h])) for h in "abcd"}
        assert all(got[h][kind] == pytest.approx(rank[h], abs=1e-8) for h in "abcd")


def test_pipeline_stages(spark, docs, empty):
    sf = "/root/testdata/sf0.001"
    for start in (docs, empty):
        cur = start
        for name, stage in corpus_pipeline.STAGES:
            nxt = stage(spark, cur, sf)
            if name != "mixing":
                assert nxt.columns == start.columns, name
            cur = nxt
        assert cur.count() <= start.count()
    first = sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect())
    assert first == sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) and first
