"""Time the headline queries and print one JSON line.

Each query runs once, from reading the tables to a discarded full result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from strandframe.plans.catalog import load  # noqa: E402

HEADLINES = [
    "agg3_prefix_collapse", "agg3_prefix_collapse_documents", "agg20_read_statistics", "prj1_reverse_complement_pairs",
    "prj6_longest_valid_run", "agg22_posting_counts", "jn1_naive_best_hits", "jn4_triple_best_hits", "jn8_scored_neighbours",
    "agg6_exact_evaluation", "gr1_supply_components", "agg14_mass_quantile", "agg17_insert_size_stats",
    "agg29_clustered_points", "gr16_merged_positions", "fn7_half_banded_tau3", "gr19_estimated_distances",
    "win4_top_four_hits",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINES
    spark.range(1000).selectExpr("sum(id)").collect()  # session start is not part of a query
    times = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
