"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from panelforge.plans.registry import QUERIES

HEADLINE = ("feat_returns", "feat_rolling_std", "feat_robust_z", "topn_by_date", "percentile_composite", "rank_ic_by_date", "fast_screen_summary", "corr_pairs", "asof_members", "backtest_metrics")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 2)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
