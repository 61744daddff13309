"""Headline-query benchmark.

Runs the headline registered queries on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) in one ``local[$BENCH_CPUS]`` session: one warm-up pass,
then the median of ``$BENCH_REPS`` (default 3) timed runs per query. Each run
executes the full plan into Spark's ``noop`` sink (no driver collect).
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from timefuse.registry import QUERIES  # noqa: E402
from timefuse.session import get_spark  # noqa: E402

HEADLINE = [
    "load_and_combine", "daily_mean", "daily_mean_by_category", "align_left_join", "multi_left_join",
    "standardize_time", "parse_multi_format", "target_describe", "target_correlations", "mode_value",
    "null_ratio", "tfidf", "category_codes", "forward_fill", "fill_both", "impute_regression",
    "fit_linear_multi", "predict_linear", "roc_auc", "forecast_periods", "forecast_horizon",
]


def run_once(spark, key: str, sf: str) -> float:
    t0 = time.perf_counter()
    QUERIES[key](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    reps = int(os.environ.get("BENCH_REPS", "3"))
    keys = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus)
    times: dict[str, float] = {}
    for k in keys:  # warm-up: JIT, codegen caches, file listing
        run_once(spark, k, sf)
    for k in keys:
        times[k] = round(statistics.median(run_once(spark, k, sf) for _ in range(reps)), 3)
    sf_name = os.path.basename(sf.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_name, "cpus": cpus, "reps": reps}))


if __name__ == "__main__":
    main()
