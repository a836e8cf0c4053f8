"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = (
    "embedding_cost",
    "table_estimates",
    "doc_tokens",
    "piece_tokens",
    "all_documents",
    "hashes_lineitem",
    "table_snapshot",
    "chunk_estimates",
    "merge_chunks",
    "table_catalog",
    "provider_report",
    "progress_snapshot",
    "running_progress",
)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("inktally")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from workloads.queries import queries

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark, known, times = session(), queries(), {}
    # One untimed run on the smallest tables starts the JVM's compiler and the Python workers.
    small = os.path.join(os.path.dirname(folder.rstrip("/")), "sf0.001")
    known["embedding_cost"](spark, small if os.path.isdir(small) else folder).collect()
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.perf_counter()
            # Every column of every row is computed, none is kept.
            known[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(min(runs), 3)
    line = {
        "metric": "headline queries, total wall time, better of two runs each",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
