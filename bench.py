"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import SparkSession  # noqa: E402

from loglane.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "render drift_uniq drift_uniq_doc_lines drift_fuzzy drift_fuzzy_logs_msg filter_incl_excl grep level_filter since gate head "
    "last_n sample_overall dedupe suppress debounce normalize mask redact truncate byte_offset line_number "
    "sequence columns extract_kv extract_json json_pretty service_index window_counts line_counts top_lines "
    "alerts alert_counts table_alerts rolling_count join_runs multiline coalesce_bursts reorder batch_size batch_interval "
    "pace baseline_drift two_service_diff route"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        spent = []
        # One warm-up, then the median.
        for i in range(runs + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if i:
                spent.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(spent), 4)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
