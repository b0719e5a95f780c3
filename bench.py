"""Headline benchmark: prints ONE JSON line.

Runs the index build, BM25 batch retrieval, exact kNN, fusion + metrics,
chunking and HTML-to-text over the whole tables at $BENCH_SF_DIR
(default /root/testdata/sf0.1) on local[$BENCH_CPUS]. Each query is forced
with a ``noop`` write (full execution, no driver collect).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ragtable.plans import registry  # noqa: E402
from ragtable.session import build_session  # noqa: E402

HEADLINE = [
    "bm25_postings",
    "bm25_top5",
    "knn_l2_top5",
    "rrf_fusion",
    "retrieval_metrics_at_k",
    "chunk_character_windows",
    "chunk_ids",
    "semantic_chunks",
    "recursive_chunks",
    "html_to_text",
    "answer_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="ragtable-bench")
    registry.load_all()
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()  # building a query may run jobs too
        df = registry.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
