"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from deltagraph import catalogue

HEADLINE = [
    "pagerank", "pagerank_users", "pagerank_hub_split", "connected_components", "sssp", "katz", "adsorption", "simrank",
    "priority_round", "termination_diff", "progress_log", "emit_messages", "out_degree", "accumulate_sum", "scalar_edge_features",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.queries()["out_degree"](spark, sf).count()  # start the JVM's compilers
    took = {}
    for name in HEADLINE:
        began = time.time()
        catalogue.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
