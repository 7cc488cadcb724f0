"""Benchmark: run the headline catalogue queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and print one JSON line.

Each query is executed in full with the ``noop`` sink (no collect to the
driver); the time per query is the median of $BENCH_REPS runs after one
warm-up run of the whole set. ``--all`` runs every registered key.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verdict.plans.registry import all_queries  # noqa: E402
from verdict.session import build_session  # noqa: E402

HEADLINE = [
    "verify_claims", "vector_topk", "image_retrieval", "two_stage_retrieval", "hit_at_k",
    "retrieval_prf_map", "classification_metrics", "claim_verdict", "majority_vote",
    "windowed_metrics", "lexical_pair_score", "detect_language", "ensemble_grid",
    "profile_text_lengths", "enrich_text", "parse_answers",
]


def run_once(q, spark, sf_dir) -> float:
    t0 = time.perf_counter()
    q.build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "1"))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    qs = all_queries()
    names = list(qs) if "--all" in sys.argv else [n for n in HEADLINE if n in qs]
    for n in names:  # warm-up: JVM, Python workers, file listing
        run_once(qs[n], spark, sf_dir)
    times = {}
    for n in names:
        times[n] = round(statistics.median(run_once(qs[n], spark, sf_dir) for _ in range(reps)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "catalogue_total_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
