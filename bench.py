"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised with the ``noop`` sink (every row and
column computed, nothing collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "full_audit", "audit_summary", "missing_report", "rule_set", "price_validity",
    "row_uniqueness", "positive_report", "format_report", "distinct_counts",
    "full_repair", "impute_generic", "cap_outliers", "weekly_features",
    "describe", "quantiles", "column_profile", "chi_square", "one_hot",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from ledgerlint.plans.queries import queries
    from ledgerlint.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    reg = queries()
    names = [n for n in (sys.argv[1:] or HEADLINE) if n in reg]
    # warm-up: JVM, parquet footers, codegen caches
    reg["missing_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings = {}
    for n in names:
        t0 = time.time()
        reg[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[n] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_wall_time_headline_queries", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
