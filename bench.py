"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time
from statistics import median

from tierglass.plans import seeds
from tierglass.plans.queries import QUERIES
from tierglass.session import local_session

HEADLINE = "f8_classify"
TIMED = (
    "f8_classify",
    "f8_classify_with_answers",
    "f9_engine",
    "e10_signals_table",
    "p2_assemble_pages",
    "p3_metadata",
    "m17_reasoning",
    "m9_cache_misses",
    "v1_evidence_entries",
    "v1_evidence_with_images",
    "s10_appended_records",
    "j4_streamed_classification",
    "v4_history_by_source",
    "h4_label_statistics",
    "h5_recalibration",
    "q7_benchmark",
    "j2_task_status",
    "j3_task_results",
)
RUNS = 3


TABLES = ("documents", "labels", "conversations", "pages", "events", "customer")


def spread_over_files(spark, sf: str, files: int, folder: str) -> str:
    """The given tables in as many files as there are cores.

    The given ones are one row group each, which a single task reads; larger tables are stored in many.
    """
    for name in TABLES:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(files).write.parquet(f"{folder}/{name}.parquet")
    return folder


def median_time(spark, sf: str, name: str) -> float:
    """Median of a few complete runs, plan building included."""
    times = []
    for _ in range(RUNS):
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - started)
    return round(median(times), 3)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        tables = spread_over_files(spark, sf, cores, folder)
        # One run to load classes; the timed ones follow in the given order.
        QUERIES[HEADLINE](spark, tables).write.format("noop").mode("overwrite").save()
        timings = {name: median_time(spark, tables, name) for name in TIMED}
        documents = seeds.seeded(spark, tables).count()
    print(
        json.dumps(
            {
                "metric": "classify documents end to end",
                "value": timings[HEADLINE],
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "documents": documents,
                "documents_per_sec": round(documents / timings[HEADLINE]),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
