"""Headline queries, timed: one JSON line with seconds per query, the median of warmed runs."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

HEADLINE = (
    "q1_pricing q3_shipping q5_regional q6_revenue agg_count_sum_avg_min_max agg_count_distinct agg_stddev_var join_inner join_three_way join_self "
    "win_row_number win_rank_dense_rank win_running_sum win_sliding_rows win_count_distinct topk union_distinct distinct_rows filter_three_valued int_division fn_string count_star"
).split()
#: Runs of a query before the timed ones (compilation, files' metadata), and timed ones.
WARM, TIMED = 1, 3


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quernflow.operators.queries import queries

    known, took = queries(), {}
    for name in HEADLINE:
        runs = []
        for _ in range(WARM + TIMED):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(median(runs[WARM:]), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
