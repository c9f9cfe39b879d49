"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import importlib
import json
import os
import time

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ["append_assign_lsn", "roll_by_records", "roll_by_bytes", "block_stats", "partition_heads", "replay_range", "fetch_point", "seek_timestamp",
            "list_segments_page", "leaf_pages", "locate_records", "audit_lsn_gaps", "audit_segment_contiguity", "retention_effective_floor",
            "gc_budgeted", "scrub_orphan_segments", "projection_latest_state", "order_timelines", "lineitem_segment_rollup",
            "source_records", "source_replay_range", "source_fetch", "source_seek", "source_segments"]


def main() -> None:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = importlib.import_module("__spark_entry__").queries(), {}
    for name in HEADLINE:
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()  # compiles code, warms the file cache
        began = time.perf_counter()
        queries[name](spark, SF).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
