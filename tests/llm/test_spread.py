"""Hot keys dealt over tasks, components of a hub, names of keys that share a half."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragtable.llm import near_dedup
from ragtable.llm.graph import connected_components
from ragtable.llm.spread import hot_keys, spread_join


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_a_plain_join(spark, how):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(400)] + [(99, 1), (None, 2)], "k int, v int")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(7)], "k int, name string")
    hot = hot_keys(rows.groupBy("k").agg(F.count("*").alias("c")), ["k"], "c", 60)
    assert {(r.k, r._parts) for r in hot.collect()} == {(0, 3)}
    dealt = spread_join(rows, table, ["k"], hot, F.col("v"), how)
    assert dealt.columns == ["k", "v", "name"]
    assert sorted(map(str, dealt.collect())) == sorted(map(str, rows.join(table, "k", how).collect()))


@pytest.mark.parametrize("per_task", [10, 10**9])
def test_components_of_hubs_and_chains(spark, per_task):
    rng = np.random.default_rng(3)
    edges = [(50, i) for i in range(100)] + [(i, i + 1) for i in range(200, 260)] + [(int(a), int(b)) for a, b in rng.integers(300, 400, (60, 2))] + [(7, 7), (300, 300)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), edges_per_task=per_task).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_keys_that_share_a_half_get_names_of_their_own(spark):
    rows = [(1, 1), (1, 2), (1, 3), (2, 1), (3, 9)]
    got = near_dedup.own_names(spark.createDataFrame(rows, "half1 long, half2 long")).collect()
    assert sorted((r.half1, r.half2) for r in got) == rows and len({r.node for r in got}) == len(rows)
    assert {r.node for r in got if r.half1 != 1} == {2, 3}


def test_near_duplicates_of_hot_keys_are_the_same(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 300, 80)]
    rows = [(i, " ".join(base)) for i in range(40)]  # copies
    for i in range(40, 80):  # near copies of one text: one bucket, one hub
        words = list(base)
        words[int(rng.integers(0, 80))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(i, " ".join(f"y{j}" for j in rng.integers(0, 10**6, 30))) for i in range(80, 100)] + [(100, None), (101, ""), (None, " ".join(base)), (3, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain, dealt = (sorted(map(str, near_dedup.near_duplicate_components(docs, k=2, per_task=n).collect())) for n in (10**9, 5))
    assert plain == dealt and len(plain) == len(rows)
    kept = {r.doc_id for r in near_dedup.near_duplicate_components(docs, k=2).collect() if r.kept}
    assert kept == {0, *range(80, 102)}


def test_the_lighter_block_is_sent(spark):
    weights = spark.createDataFrame([(1, 900), (2, 10), (3, 10), (4, 500)], "block long, bytes long")
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (1, 1), (2, 4)], "x long, y long")
    got = near_dedup.lighter_first(pairs, weights)
    assert got.columns == ["x", "y"] and sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (2, 3), (2, 4), (4, 1)]


@pytest.mark.parametrize("block_bytes", [2 << 20, 4000])
def test_components_whichever_block_is_sent(spark, block_bytes):
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(4000)]
    texts = []
    for base in range(12):  # chains of near copies, so that a bucket holds more than its hub reaches at once
        row = [words[i] for i in rng.integers(0, 4000, 60)]
        for _ in range(12):
            texts.append(" ".join(row))
            row = row.copy()
            row[int(rng.integers(0, 60))] = words[int(rng.integers(0, 4000))]
            row[int(rng.integers(0, 60))] = words[int(rng.integers(0, 4000))]
    sets = [{tuple(t.split()[i: i + 2]) for i in range(len(t.split()) - 1)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicate_components(docs, 2, 80, block_bytes=block_bytes).collect()}
    assert got == dict(enumerate(root))
