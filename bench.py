"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` a
comma-separated choice of queries (or ``all``).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from hearthline.session import tune  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "price_categories",
    "summary",
    "top_neighbourhoods",
    "room_type_breakdown",
    "full_report",
    "data_quality",
    "row_accounting",
    "cleaned_listings",
    "typed_listings",
    "typed_raw_listings",
    "bad_rows",
    "clean_document_text",
    "clean_conversation_text",
    "clean_numbers",
    "clean_dates",
    "price_per_guest",
    "replicate",
    "scale_summary",
    "sequence",
    "insert_new_only",
    "upsert",
    "load_manifest",
    "decode_datetimes",
    "counter_deltas",
    "transform_job",
    "load_job",
    "three_stage_report",
    "csv_round_trip",
]
# Read in splits as a file of many gigabytes is.
SMALL_SPLITS = {"csv_round_trip": "4m"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if wanted == "all" else wanted.split(",") if wanted else HEADLINE
    spark = tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("hearthline-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the JVM's readers
    seconds: dict[str, float] = {}
    for name in names:
        if name in SMALL_SPLITS:
            spark.conf.set("spark.sql.files.maxPartitionBytes", SMALL_SPLITS[name])
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    result = {
        "metric": "total time of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
