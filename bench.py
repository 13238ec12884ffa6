"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2, after
one run to warm up), BENCH_QUERIES (comma-separated names, or `all`).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from sluice import build_session
from sluice.queries import QUERIES

HEADLINE = [
    "a1_csv", "a17_discover", "a23_bucketed_join", "b2_filter", "b11_keep_last_days", "c1_inner_join", "c2_full_join",
    "c3_anti_join", "d8_count_distinct", "d9_statistics", "d11_many_measures", "d12_pivot", "e8_normalize",
    "f11_assess", "f15_profile_lineitem", "f19_deduplicate", "g1_row_number_big_groups", "g3_lag_big_groups",
    "g5_partition_total", "h1_sort", "h3_top_k_per_group", "j7_match_columns", "k4_percentile_all_time", "k8_k9_alerts",
    "k3_k17_stream_windows", "l1_operation_list", "l6_tag_requests",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
