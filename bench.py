"""Time the registered reports; prints one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per report after one warm-up run (default 3, the median counts)
BENCH_QUERIES  comma-separated report names (default: all reports)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from stockaudit.plans.registry import queries  # noqa: E402
from stockaudit.session import build_session  # noqa: E402
from stockaudit.sources import derived  # noqa: E402


def seconds(report, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    report(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    reports = queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    wanted = chosen.split(",") if chosen else list(reports)
    spark = build_session(
        "stockaudit-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Deriving and writing the six input tables, which reports then only read.
    start = time.perf_counter()
    derived.land_all(spark, sf_dir)
    load = round(time.perf_counter() - start, 3)
    # One pass over all reports first, so that no report pays for loading classes.
    for name in wanted:
        seconds(reports[name], spark, sf_dir)
    times = {
        name: round(statistics.median(seconds(reports[name], spark, sf_dir) for _ in range(runs)), 3)
        for name in wanted
    }
    spark.stop()
    print(json.dumps({
        "metric": f"total seconds of {len(times)} reports, warm, median of {runs}",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "load_tables": load,
        "value_with_load": round(sum(times.values()) + load, 3),
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
