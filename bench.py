"""Wall time of the headline queries: one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    measured runs per query after one warm-up (default 5)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

import pyspark

from tidelog.plans import QUERIES
from tidelog.session import session

HEADLINE = [
    "search_page",
    "search_token",
    "search_fuzzy",
    "facets",
    "build_index",
    "validate_events",
    "rule_engine",
    "sequence_issues",
    "dedup_first",
    "alert_auth",
    "lockout",
    "latency_report",
    "pointer_velocity",
    "move_stats",
    "focus_changes",
    "page_numbers",
    "verify_files",
    "screen_text",
    "write_events_roundtrip",
    "export_csv",
    "stream_ingest",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    names = sys.argv[1:] or HEADLINE
    spark = session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            begin = time.perf_counter()
            QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median wall seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
                "cores": int(cpus),
                "runs": runs,
                "spark": pyspark.__version__,
                "shuffle_partitions": int(cpus),
                "driver_memory": "8g",
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
