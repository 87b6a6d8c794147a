"""Times the headline queries and prints one JSON line.

The tables are first written anew in as many files as there are cores.  Every query runs
once to warm up and once for the figure; results are computed whole and thrown away.
Building and planning are timed apart.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from pagetables.plans.catalog import QUERIES

HEADLINES = (
    "traffic_mix",
    "route_requests",
    "route_requests_asof",
    "warmup_queue",
    "link_graph",
    "html_tables",
    "page_metadata",
    "structured_entities",
    "render_markdown",
    "build_documents",
    "latest_resources",
    "stream_crawl",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds in all, and for building and planning."""
    start = time.perf_counter()
    frame = QUERIES[name](spark, sf_dir)
    frame._jdf.queryExecution().executedPlan()
    planned = time.perf_counter() - start
    frame.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start, planned


def spread_tables(spark: SparkSession, sf_dir: str, files: int) -> str:
    """The tables in ``files`` files each: a table of one row group is read by one core."""
    folder = tempfile.mkdtemp(prefix="pagetables-bench-")
    for name in ("pages", "events"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagetables-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = spread_tables(spark, sf_dir, spark.sparkContext.defaultParallelism)
    seconds, planning = {}, {}
    for name in HEADLINES:
        run(spark, name, tables)
        total, planned = run(spark, name, tables)
        seconds[name], planning[name] = round(total, 3), round(planned, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "planning": planning,
                "sf": sf_dir.rstrip("/").rsplit("/sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
