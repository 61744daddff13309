"""Summarise the final (AQE) physical plan of registered queries.

For each query: scans (with pushed filters), exchanges by kind, joins by
strategy, windows, and whether any exchange gathers to a single partition.
Writes a markdown table to stdout.

    python tools/plan_report.py [sf_dir] [key ...]
"""
from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from timefuse.registry import QUERIES  # noqa: E402
from timefuse.session import get_spark  # noqa: E402


def summarize(plan: str) -> dict:
    def n(pat):
        return len(re.findall(pat, plan))
    return {
        "scans": n(r"FileScan parquet") + n(r"FileScan csv"),
        "pushed": n(r"PushedFilters: \[[^\]]+\]"),
        "shuffles": n(r"Exchange hashpartitioning") + n(r"Exchange rangepartitioning") + n(r"Exchange RoundRobin"),
        "single": n(r"Exchange SinglePartition"),
        "bhj": n(r"BroadcastHashJoin"),
        "bnlj": n(r"BroadcastNestedLoopJoin"),
        "smj": n(r"SortMergeJoin"),
        "windows": n(r"\bWindow \["),
        "checkpointed": n(r"Scan ExistingRDD"),
    }


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    keys = sys.argv[2:] or sorted(QUERIES)
    spark = get_spark("local[8]", 8)
    print("| query | scans | pushed filters | shuffles | single-partition exch. | BHJ | BNLJ | SMJ | windows | checkpointed inputs |")
    print("|---|---|---|---|---|---|---|---|---|---|")
    for k in keys:
        df = QUERIES[k](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        s = summarize(df._jdf.queryExecution().executedPlan().toString())
        print(f"| {k} | {s['scans']} | {s['pushed']} | {s['shuffles']} | {s['single']} | {s['bhj']} | {s['bnlj']} | "
              f"{s['smj']} | {s['windows']} | {s['checkpointed']} |")


if __name__ == "__main__":
    main()
