"""Headline benchmark: prints one JSON line with per-query seconds.

    BENCH_SF_DIR   driver tables (default /root/testdata/sf0.1)
    BENCH_CPUS     local[N] (default 8)

Each query runs over the whole tables; results go to Spark's ``noop`` sink
(every row is produced, nothing is collected), except the model fits, whose
output is a handful of coefficients.  Before timing, every headline query runs
once on the smallest driver tables (BENCH_WARMUP_DIR), so the timings measure a
warm JVM (generated code compiled), as on a long-running cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pathweave.plans.catalog import QUERIES  # noqa: E402
from pathweave.plans.q_design import _manifest  # noqa: E402
from pathweave.session import get_session  # noqa: E402

HEADLINE = {
    "orderings": "p1_all_orderings",
    "paths": "p13_generate_paths",
    "manifest": _manifest,  # every row of it; the registered query sums them by condition
    "condition_summary": "g1_condition_summary",
    "cell_variance": "g4_cell_variance",
    "two_proportion_z": "s1_two_proportion_z",
    "pairwise_power": "s7_pairwise_power",
    "effects_ranked": "g15_effects_ranked",
    "quality_report": "dq12_violation_report",
    "cache_keys": "t4_cache_keys",
    "ledger_state": "l4_apply_updates",
    "logistic": "r1_logistic_fixed_effects",
    "mixed_model": "r4_random_slope_fixed",
    "stream_rates": "st3_daily_rates",
}


def run(query, spark, sf_dir):
    return (query if callable(query) else QUERIES[query])(spark, sf_dir)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="pathweave-bench", **{
        "spark.sql.shuffle.partitions": str(max(8, 2 * cpus)),
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
    })
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if warm and os.path.isdir(warm):
        for query in HEADLINE.values():  # warm-up, not timed
            run(query, spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for key, query in HEADLINE.items():
        t0 = time.time()
        df = run(query, spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - t0, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
