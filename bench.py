"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) select data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidegate import catalog
from tidegate.session import build_session

HEADLINE = [
    # whole-table decisions and panels
    "run_counters", "session_totals", "verdict_breakdown", "flows_over_time", "flow_rate_5s", "top_attackers",
    "proba_histogram", "threshold_whatif", "ground_truth_eval", "rule_apply",
    # event log
    "flow_to_features", "join_alerts", "decision_batch_job",
    # preparation, sampling, exploration
    "drop_duplicates", "prepare", "stratified_split", "eda_label_correlation", "eda_outlier_summary",
    "eda_per_class_stats", "eda_boxplot_stats",
    # evaluation and models
    "roc_auc", "pr_curve", "evaluate_models", "fit_feature_pipeline", "smote", "isolation_forest_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark_sql_shuffle_partitions=cpus, spark_ui_enabled="false",
        spark_driver_memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.load()
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
