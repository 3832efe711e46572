"""Wall seconds of the headline queries.  Prints one JSON line.

BENCH_SF_DIR: folder of the given tables (default /root/testdata/sf0.1)
BENCH_CPUS:   local cores (default 8)
"""

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINES = [
    "b1_dedup_latest",
    "b3_validate_telemetry",
    "b3_validate_warranty",
    "b8_quarantine_by_rule",
    "b17_unsupported_diagnostics",
    "b18_unsupported_claims",
    "d8_surrogate_keys",
    "d12_fact_telemetry",
    "e1_trip_sessions",
    "e5_component_failures",
    "e9_vehicle_health_daily",
    "e10_component_failure_risk",
    "e11_warranty_cost_analysis",
    "e12_dealer_operational_summary",
    "f9_failure_cohorts",
    "f12_fault_windows",
    "f17_demand_series",
    "f18_component_stats",
    "f23_split_by_position",
    "g3_classification_metrics",
    "g6_iforest_score",
    "g13_outlier_rank",
    "g23_drift_report",
    "c1_telemetry_contract",
    "c7_compaction",
    "c11_streak_alerts",
    "h2_rule_severe_dtc",
    "h6_append_unseen",
    "i1_vehicle_page",
    "i9_fleet_overview",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")

    from motorlake.catalog import load  # noqa: F401
    from motorlake.catalog.registry import QUERIES
    from motorlake.catalog.scoring import sensor_forest
    from motorlake.plans.warehouse import TABLES, open_warehouse

    times: dict[str, float] = {}

    def timed(name, fn):
        start = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    timed("load_warehouse", lambda: open_warehouse(spark, sf_dir, *TABLES))
    timed("train_sensor_forest", lambda: sensor_forest(spark, sf_dir))
    for name in HEADLINES:
        timed(name, lambda: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())

    print(
        json.dumps(
            {
                "metric": "total wall seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
