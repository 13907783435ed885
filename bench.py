"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads (default 8). Each query runs
twice, results going to a sink that discards them, and the better time counts, so that the start of the
JVM is not what is measured. Names on the command line restrict the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from clickloom.plans.queries import PLAIN

HEADLINE = [
    "count_stats",
    "count_stats_items",
    "count_encode",
    "explode_features",
    "hash_vector",
    "hash_vector_positional",
    "onehot_vector",
    "auc_rank",
    "eval_report",
    "rank_rows",
    "argsort_by_group",
    "progressive_loss",
    "ftrl_step",
    "ftrl_score",
    "ftrl_fit_epochs",
    "ftrl_fit_by_segment",
    "leaf_file_rows",
    "ftrl_fit_leaf",
    "gbdt_fit_score",
    "ftrl_stream",
    "ctr_two_stage_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("clickloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in [n for n in HEADLINE if n in sys.argv[1:] or len(sys.argv) == 1]:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            PLAIN[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
        print(f"{name} {[round(r, 2) for r in runs]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "master": f"local[{cpus}]",
            }
        )
    )


if __name__ == "__main__":
    main()
