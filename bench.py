"""Benchmark the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS
(default 8), BENCH_RUNS (default 5).  Each query runs once to warm up, then
BENCH_RUNS times; the median wall time is reported.  Execution is forced with
the ``noop`` sink, so the whole plan runs but nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessera.plans import context, driver, reports  # noqa: E402
from tessera.session import local_session  # noqa: E402

HEADLINE = {
    "sales_by_month": driver.sales_by_month,            # B-12
    "state_performance": driver.state_performance,      # B-13
    "sales_by_category": driver.sales_by_category,      # B-14
    "top_k_concentration": driver.top_k_concentration,  # C-02
    "context_per_group": context.context_per_group,     # A-21 per group
    "markdown_blocks": reports.markdown_blocks,         # A-33
    "kpi_cuts": driver.kpi_cuts,                        # B-16
    "report": reports.report,                           # C-10
}


def _run(make) -> float:
    """Seconds from the call on: some queries write a stored fact when they are called."""
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=max(2 * cpus, 8), app="tessera-bench")
    times = {}
    for name, fn in HEADLINE.items():
        # the bench's table of documents is one row group: spread it over the cores
        more = {"partitions": cpus} if name == "markdown_blocks" else {}
        _run(lambda: fn(spark, sf_dir, **more))  # warm-up (JIT, file listing cache)
        samples = [_run(lambda: fn(spark, sf_dir, **more)) for _ in range(runs)]
        times[name] = round(statistics.median(samples), 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_median", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}))


if __name__ == "__main__":
    main()
