"""Times headline queries; prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` choose data and
cores. Every query computes its whole result; nothing is cached between queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from basewise.queries import QUERIES  # noqa: E402

HEADLINE = [
    "demux_summary", "transpose_cycles", "to_read_pairs", "to_fastq", "trim_adapter", "demux_match", "enumerate_kmers",
    "parse_prq", "count_windows", "map_reads", "sam_records", "containers_by_count", "containers_by_coordinate",
    "coverage", "mismatch_track", "stream_count_windows", "roundtrip_diff",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basewise-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # A few megabytes of reads are seconds of work: keep them on all cores.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    picked = sys.argv[1:] or HEADLINE
    # Start the Python workers and warm the compiler on a small plan.
    QUERIES["decode_index"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in picked:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
