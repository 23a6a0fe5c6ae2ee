"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from foliant.plans.catalogue import QUERIES
from foliant.plans.collection import Collection
from foliant.sources.clustered import ClusteredIndex

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["eq_range_and", "find_one", "in_list", "in_null", "exists", "lookup_left", "lookup_orders", "sort_skip_limit", "set_inc", "push_pull_addtoset", "diff", "fold_replay", "snapshot_delta", "observer_events"]
RUNS = 3


def lookups(spark: SparkSession) -> dict[str, float]:
    """A field lookup without and with an index that is there already, each the median of several."""
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")
    out = {}
    for name, indexes in (("lookup_scan", []), ("lookup_index", [ClusteredIndex("l_partkey", key="l_orderkey")])):
        c = Collection(lines, key="l_orderkey", indexes=indexes)
        c.find({"l_partkey": 1}).to_df().write.format("noop").mode("overwrite").save()  # builds the index
        took = []
        for part in (7, 70, 700, 77, 170):
            began = time.time()
            c.find({"l_partkey": part}).to_df().write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        out[name] = round(sorted(took)[len(took) // 2], 4)
    return out


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            began = time.time()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(sorted(took)[RUNS // 2], 4)
    times |= lookups(spark)
    print(json.dumps({"metric": "total median query time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
