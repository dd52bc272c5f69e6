"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

from cohortmill.queries.catalog import QUERIES
from cohortmill.session import tuned_session

HEADLINE = [
    "first_value_features", "stat_and_first_features", "median_features", "interval_join_rows", "first_features_by_encounter",
    "measurement_stats", "measurement_median", "qualified_visits", "code_cohort_similar_controls", "list_cohort",
    "emergency_controls", "latest_row_per_subject", "first_nonnull_per_subject", "grouped_split", "control_downsample",
    "crosstab_cube", "overlap_summary", "subject_summary", "item_prevalence", "label_distributions", "model_matrix",
    "category_codes", "threshold_table", "summary_scores_by_group", "operating_points", "calibration", "decision_curve",
    "topk_workload", "subgroup_ap", "bootstrap_ap", "text_positive_not_negated", "proxy_times", "drug_features", "combine_notes",
    "json_validate_split", "ingest_results", "event_table_roundtrip",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = sys.argv[1:] or HEADLINE
    spark = tuned_session("bench", f"local[{cpus}]", {
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # One pass over a small query starts the executor threads and the code generator.
    QUERIES["event_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in chosen:
        begin = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - begin, 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
