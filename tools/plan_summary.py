"""Summarise the physical plans of registered queries (operators that cost
shuffles or single tasks), for review. Usage:
``python tools/plan_summary.py [sf_dir] > PLANS.md``"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bench import HEADLINE  # noqa: E402
from ledgerlint.plans.queries import queries  # noqa: E402
from ledgerlint.session import get_spark  # noqa: E402

WATCH = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange RoundRobinPartitioning",
         "Exchange SinglePartition", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "Expand", "ArrowEvalPython"]


def summary(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = {w: plan.count(w) for w in WATCH}
    scans = re.findall(r"FileScan parquet \[([^\]]*)\].*?Location: \w+\(\d+ paths\)\[[^\]]*/(\w+)\.parquet\]", plan)
    return {"counts": {k: v for k, v in counts.items() if v}, "scans": scans}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    print("# Physical plan summary (headline queries)\n")
    print(f"Input `{sf}`; counts of plan operators before AQE re-planning "
          "(AQE may still turn a sort-merge join into a broadcast join at runtime).\n")
    print("| Query | Shuffles and joins | Aggregates / windows | Scanned columns |")
    print("| --- | --- | --- | --- |")
    for name in HEADLINE:
        s = summary(queries()[name](spark, sf))
        c = s["counts"]
        joins = ", ".join(f"{k.replace('Exchange ', 'X ')} {v}" for k, v in c.items()
                          if "Exchange" in k or "Join" in k)
        aggs = ", ".join(f"{k} {v}" for k, v in c.items() if "Aggregate" in k or k in ("Window", "Expand", "ArrowEvalPython"))
        scans = "; ".join(f"{t}: {len(cols.split(','))}" for cols, t in s["scans"])
        print(f"| {name} | {joins} | {aggs} | {scans} |")


if __name__ == "__main__":
    main()
