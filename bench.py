"""Time the headline queries and print one line of JSON.

BENCH_SF_DIR is the folder of the tables (default /root/testdata/sf0.1) and
BENCH_CPUS the number of local cores (default 8). Each query is run once to
warm up and then timed over BENCH_RUNS runs (default 1), of which the best
counts; rows go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from registered import QUERIES

HEADLINE = [
    "search_topn", "search_topn_interactive", "search_ci", "search_cs", "search_root", "search_in_paths",
    "search_overlap", "search_non_ascii", "search_multiline", "search_pages", "search_conversations",
    "search_count", "lang_stats", "lang_totals", "stats_json", "ignore_filter", "ignore_negation",
    "ignore_sources", "ignore_parse", "ignore_translate", "binary_sniff", "decode_text", "text_hash",
    "line_count", "detect_language", "filter_descendants", "sync_diff", "sync_counters", "roots_register",
    "index_sync", "file_source", "file_tree",
]


def timed(spark: SparkSession, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("codequarry-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        timed(spark, name, folder)
        seconds[name] = round(min(timed(spark, name, folder) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(folder)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
