"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and cores;
keys on the command line, or "all", choose other queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

from wakeline.catalog import QUERIES
from wakeline.session import build_session

HEADLINE = [
    "dedup_keep_first", "duplicate_rows", "missing_ge", "rated_range", "min_history_filter", "missing_ratio",
    "quantile_trim", "join_register_left", "voyage_interval_join", "voyage_numbering", "gap_hours", "continuous_runs",
    "run_change_band", "split_last_fold", "feature_table", "corr_per_ship", "knn_outlier_score", "knn_outlier_1d",
    "standardize_fit_apply", "ridge_baseline", "ship_classes", "metrics_by_run", "metrics_by_class", "assemble_results",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = list(QUERIES) if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times: dict[str, float] = {}
    for key in keys:
        start = time.time()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
