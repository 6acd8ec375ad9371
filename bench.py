"""Times of the headline queries: one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and then three times into Spark's no-op sink; its figure is
the median.
"""

from __future__ import annotations

import json
import os
import statistics
import time

os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"

from tarnflow import catalog  # noqa: E402
from tarnflow.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_hourly_activity", "filter_orders", "map_orders", "flatmap_rows", "aggregate_group", "aggregate_distinct", "aggregate_listagg",
    "window_tumble", "window_slide", "window_session", "window_session_global", "window_top_n", "dedup_first", "top_n_rows", "window_functions",
    "join_inner", "join_anti", "join_multi", "interval_inner", "interval_bucketed", "as_of", "validated", "cdc_fold", "merge_partial_update", "pattern_fixed", "report_pipeline",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
