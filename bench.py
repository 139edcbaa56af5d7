"""Time the driver queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Each query is run once to warm up and then BENCH_RUNS times
(default 1), its whole result going to a no-op sink; the median counts.  Streams
and file round trips write for real and are timed once.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from labtables.plans.bindings import QUERIES
from labtables.session import build_session

ONCE = (
    "flowcell_ready_stream",
    "latest_doc_stream",
    "routed_stream",
    "project_stream",
    "project_stream_rejects",
    "status_stream",
    "rollup_stream",
    "changes_since",
    "dispatch",
    "write_stats_tsv",
    "write_barcode_list",
    "write_libraries",
    "write_multi_sheet",
    "write_tracking",
    "read_long_stats",
    "log_facts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or list(QUERIES)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds: dict[str, float] = {}
    for name in names:
        if name in ONCE:
            seconds[name] = round(timed(name), 3)
        else:
            timed(name)
            seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total time of the driver queries (median per query)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
