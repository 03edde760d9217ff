"""Headline queries, timed: ``python bench.py`` prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results are written to a
sink that discards them, so every row and column is computed and nothing is fetched.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from plumbline.plans.catalog import QUERIES
from plumbline.session import build_session

HEADLINE = (
    "D04_ordered",
    "D06_unordered",
    "D07_unordered_tolerant",
    "D08_keyed",
    "D03_scalar",
    "F05_number_support",
    "F09_verify_claims",
    "B03_upstream",
    "B06_relations",
    "C04_scope",
    "C13_verdict",
    "E03_trace",
    "E09_verify_live",
    "A14_validate_cases",
    "G03_test_health",
    "Q06_group_by",
    "Q09_window",
    "Q02_inner_join",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.log.level": "OFF",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_median_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
