"""Benchmark of the headline queries.  Prints one JSON line.

Every query starts from the source tables: staged inputs are forgotten before each run and
results go to the no-op sink, so timings include all reading, staging and computing."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tessella.plans import load_catalog  # noqa: E402
from tessella.session import local_session, scratch  # noqa: E402
from tessella.sources.domain import Domain, forget_staged  # noqa: E402

HEADLINE = [
    "A03_dedup_last",  # de-duplicate raw bars
    "B04_screen",  # baseline screen
    "C03_eligible",  # point-in-time eligibility join
    "C04_strict_merge",  # eligible-price materialisation (the published wall clock)
    "C05_asof_interval_join",  # as-of sector
    "E10_roll_mdd",  # heaviest rolling window
    "E21_residual_targets",  # flagship: residual panel
    "D01_feature_summary",  # daily feature refresh
    "G01_flip_corr",  # similarity of all entities
    "L01_auc_per_date",  # daily ranking metric
    "M06_sleeve_replay",  # portfolio replay after costs
    "P02_lifecycle",  # universe audit
    "Q02_evaluate_outcomes",  # barrier outcomes
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # small inputs: let AQE keep enough partitions for all local cores
    spark = local_session(cpus, "tessella-bench", **{"spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k"})
    catalog = load_catalog()
    only = sys.argv[1:]
    Domain(spark, sf_dir).prices().count()  # start the JVM paths once
    times = {}
    for key in [k for k in HEADLINE if not only or k in only]:
        forget_staged()
        with scratch(spark):
            t0 = time.time()
            catalog[key].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[key] = round(time.time() - t0, 3)
        print(f"{key} {times[key]}", file=sys.stderr)
    rows = Domain(spark, sf_dir).prices().count()
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")), "price_rows": rows}
    if "C04_strict_merge" in times:
        out["merge_rows_per_sec"] = round(rows / times["C04_strict_merge"])
    print(json.dumps(out))


if __name__ == "__main__":
    main()
