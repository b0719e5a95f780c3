"""Exact nearest neighbours by blocks against NumPy, both ways of the join, ids of any type."""

import numpy as np
import pytest

from ragtable.operators.vectors import knn


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("block,limit", [(1024, 1 << 20), (7, 0)])
def test_knn_brute_force(spark, metric, block, limit):
    rng = np.random.default_rng(1)
    v = rng.integers(-3, 4, (400, 6)).astype(float)  # small numbers: many ties
    v[5] = 0
    q = np.vstack([v[:20], rng.standard_normal((10, 6))])
    vectors = spark.createDataFrame([(f"v{i:03d}", x.tolist()) for i, x in enumerate(v)] + [("null", None)], "chunk_id string, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)] + [(99, None)], "query_id int, embedding array<float>").repartition(3)
    q = q.astype(np.float32).astype(float)
    got = {}
    for r in knn(queries, vectors, 4, metric, query_block=block, broadcast_bytes=limit).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.chunk_id))
    for i, x in enumerate(q):
        if metric == "l2":
            d = np.sqrt(((v - x) ** 2).sum(axis=1))
        else:
            n = np.linalg.norm(v, axis=1) * np.linalg.norm(x)
            d = 1 - np.where(n == 0, 0, v @ x / np.where(n == 0, 1, n))
        want = sorted((round(float(a), 6), f"v{j:03d}") for j, a in enumerate(d))[:4]
        assert [c for _, c in got[i]] == [c for _, c in want] and np.allclose([a for a, _ in got[i]], [a for a, _ in want], atol=2e-6)
    assert set(got) == set(range(30))
    assert knn(queries.limit(0), vectors, 4).count() == 0 and knn(queries, vectors.limit(0), 4).count() == 0
