"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds, the median of three warm runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillon import catalogue

HEADLINE = "tpch_like_q1 tpch_like_q3 tpch_like_q6 join_inner_equi join_inner_multi_key join_left semi_exists correlated_scalar_count agg_group agg_count_distinct topk distinct_rows except_all knn_topk knn_filtered vec_distance fn_math top_per_key".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, found = catalogue.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        found[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
