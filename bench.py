"""Headline queries: median of warm runs at $BENCH_SF_DIR on local[$BENCH_CPUS], one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarrylens.queries import load_all  # noqa: E402
from quarrylens.session import drop_scratch, get_session  # noqa: E402

HEADLINE = (
    "a8_parquet_scan b8_coerce_numeric b10_impute_median b12_drop_outliers b16_smart_merge "
    "c2_detect_roles c3_quality c4_fingerprint c7_smart_stats c16_relationships "
    "d1_kpi d4_kpi_trend d7_value_counts d11_target_by d14_corr_matrix d18_histogram d20_moving_avg "
    "d24_chart_box e1_ols e3_anova e5_kaplan_meier e6_spearman e7_describe e12_mutual_information "
    "q2_xbar_chart q4_acf q6_holt q7_periodogram f1_npv f3_npv_curve f4_return_covariance "
    "f5_portfolio_search g3_search g4_route_documents g5_codon_counts m1_standardize m3_kmeans_sizes "
    "s3_pricing_summary s6_inner_join s9_range_join s10_asof_join s15_correlated_subquery "
    "s16_rank_large_groups s17_frames_large_groups"
).split()


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "480"))  # past it, one warm run per query
    began = time.perf_counter()
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = get_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "12g",
            # the test tables are single small files: cut them so that all cores read
            "spark.sql.files.maxPartitionBytes": "4m",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_all()
    seconds = {}
    for name in names:
        times = []
        for run in range(runs + 1):  # the first run warms up
            if run > 1 and time.perf_counter() - began > budget:
                break
            start = time.perf_counter()
            queries[name](spark, directory).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        drop_scratch(spark)
    print(
        json.dumps(
            {
                "metric": "sum of median warm query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": directory.rstrip("/").rsplit("/", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
