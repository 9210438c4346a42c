"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default: all) choose
data and cores. Every query runs completely (noop sink); the second of two runs
counts, the first one also compiles code.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = (
    "suite_results",
    "suite_results_unfused",
    "unique_lineitem",
    "duplicate_rows_topk",
    "not_null_keys",
    "freshness_events",
    "rule_total",
    "rule_condition",
    "fk_orphans",
    "fk_composite",
    "fact_coverage",
    "agg_match_group",
    "profile_orders",
    "key_candidates",
    "category_psi",
    "late_running_max",
    "scd2_intervals",
    "snapshot_compare",
    "json_valid",
    "json_type",
    "json_unique",
    "json_child_fk",
    "json_drift",
    "txspec_apply",
    "evidence_reconcile",
    "evidence_batches",
    "evidence_checksum",
    "pii_scan_documents",
    "redact_documents",
    "redact_text",
    "catalog_signature",
    "proposals",
    "run_summaries",
    "stream_windows",
    "stream_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablecheck-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    from workload import QUERIES

    seconds: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(os.path.normpath(folder)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_warm_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
