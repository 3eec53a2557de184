"""Headline queries at BENCH_SF_DIR on local[BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then BENCH_RUNS times; its median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from barloom.plans.catalog import QUERIES
from barloom.session import local_session

HEADLINE = [
    "bars_daily",
    "bars_hourly",
    "bars_wide",
    "coerce_money_dates",
    "dedupe_first",
    "fill_interpolate",
    "iqr_cap",
    "price_features",
    "macd",
    "tick_features",
    "full_pipeline",
    "pipeline_wide",
    "describe_lineitem",
    "corr_matrix",
    "isolation_forest_wide",
    "lof_exact",
    "recon_pca",
    "explain_top",
    "metrics_by_model",
    "stream_hourly_bars",
]


def seconds(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(spark, sf_dir, name)
        times[name] = round(statistics.median(seconds(spark, sf_dir, name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
