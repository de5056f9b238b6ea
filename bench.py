"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "E01_count_rows",
    "E03_sum",
    "E07_grouped_measure",
    "E08_spec_aggregate",
    "E14_trend",
    "E16_value_distribution",
    "C01_lookup",
    "C04_filter_range",
    "D01_inner_join",
    "D02_bridge_join",
    "E22_column_top_values",
    "E23_table_profile",
    "E28_pairwise_correlation",
    "E30_histogram",
    "F04_fixed_window_segments",
    "G01_dense_topk",
    "G06_lexical_score",
    "H01_merge_ranges",
    "I01_user_stats",
    "I05_active_run_per_file",
    "I15_job_dedup",
    "I21_metrics_snapshot",
    "J14_history_window",
    "K07_latency_p95",
    "L01_stream_metric_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from granary.plans import load_all
    from granary.plans.registry import REGISTRY, Tables
    from granary.session import build_session

    load_all()
    spark = build_session(
        "granary-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    tables.lineitem.count()
    timings: dict[str, float] = {}
    for name in HEADLINE:
        # The noop sink runs the whole plan without moving the rows to the driver.
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            REGISTRY[name].plan(tables).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        timings[name] = round(best, 4)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 4),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
