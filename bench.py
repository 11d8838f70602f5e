"""Time every query three times on warm workers and take the median; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wayfreight.plans.catalogue import QUERIES  # noqa: E402
from wayfreight.session import local_session  # noqa: E402

ROUNDS = 3


def main() -> None:
    data_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="wayfreight-bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, data_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for warm in ("sales_kpis", "manifest_catalog"):
        run(warm)
    seconds = {name: round(statistics.median(run(name) for _ in range(ROUNDS)), 3) for name in QUERIES}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "all_queries_median_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(data_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
