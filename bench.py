"""Headline queries on one machine; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1):
each query runs once to warm up, then BENCH_RUNS times; the median counts. The time covers
building the query (stage tables included) and reading every row of its result.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketloom.catalog import QUERIES  # noqa: E402
from marketloom.session import drop_stages, local_session  # noqa: E402

HEADLINE = (
    "a14_bars_week",
    "q3_features",
    "m1_standardised_features",
    "q5_forecast",
    "r2_liquidity_scaled_covariance",
    "r3_a17_candidate_scores",
    "j8_parameter_sweep",
    "u2_greedy_dedup",
    "r9_policy_evaluation",
    "q1_institutional_flow",
    "t3_stream_bars_day",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, memory="12g")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
            drop_stages(spark)
        took[name] = round(statistics.median(times[1:]), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
