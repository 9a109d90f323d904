"""Benchmark the headline queries.

Runs on ``local[$BENCH_CPUS]`` against ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) and prints one JSON line.  Each query is executed in
full (``noop`` sink, nothing collected); the reported time per query is the
median of ``$BENCH_REPS`` runs (default 3) after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans import q_index, registry  # noqa: E402
from quarry.session import build_session  # noqa: E402

HEADLINE = {
    "exact_search": "R1_exact_search_top100",
    "flagship_recall": "flagship_recall_at_50",
    "bm25_plus": "R9_bm25_plus_top10",
    "rrf_fusion": "R12_rrf_over_runs",
    "mean_recall": "M4_mean_recall_limit_k",
    "rerank_all": "R13_rerank_all",
    "keyword_search": "C23_keyword_search",
    "screening_curve": "F7_screening_curve",
}
# Answers from kept indexes, reported beside the total; building the indexes is timed by itself.
FROM_INDEX = {"bm25_from_index": "R9_from_index", "keyword_from_index": "C23_from_index"}


def run_once(spark, fn, sf_dir) -> float:
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus), app_name="quarry-bench")
    registry.load_all()
    times = {}
    for label, name in HEADLINE.items():
        fn = registry.QUERIES[name]
        run_once(spark, fn, sf_dir)  # warm-up (JIT, Python workers, file listing)
        times[label] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(reps)), 3)
    t0 = time.perf_counter()
    q_index.text_index(spark, sf_dir)
    q_index.works_index(spark, sf_dir)
    indexed = {"index_build": round(time.perf_counter() - t0, 3)}
    for label, name in FROM_INDEX.items():
        fn = registry.QUERIES[name]
        run_once(spark, fn, sf_dir)
        indexed[label] = round(statistics.median(run_once(spark, fn, sf_dir) for _ in range(reps)), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "median_query_seconds_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "kept_indexes": indexed, "sf": sf, "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
