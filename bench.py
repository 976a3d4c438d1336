"""Benchmark the headline queries.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3). Each query runs once to warm up, then BENCH_REPEAT
times; the median wall time is reported. Results are materialised with the
``noop`` sink, so the whole plan executes but nothing is collected.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "r13_pos_by_region",
    "r41_inv_by_sku",
    "a27_pos_sku_region_pivot",
    "a42_sensor_value_histogram",
    "w01_dispatch_rolling",
    "w02_route_zscore",
    "m05_isolation_forest_scores",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from larder.session import get_spark
    import larder.plans as P

    spark = get_spark(f"local[{cpus}]", max(cpus, 8))
    times = {}
    for name in HEADLINE:
        fn = P.QUERIES.get(name)
        if fn is None:
            continue

        def run():
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        samples = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            run()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_wall",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else None,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
