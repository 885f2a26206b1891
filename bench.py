"""Bench of the headline queries: prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Rows go
to the no-op sink, so that every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from quillworks.registry.all_checks import QUERIES
from quillworks.session import local_session

HEADLINE = [
    "a1_engagement_overview",
    "a2_engagement_by_platform",
    "a3_status_breakdown",
    "a7_status_tabs",
    "a8_posts_per_draft",
    "a9_platform_mean_engagement",
    "a11_scheduled_per_brand",
    "a14_best_platform",
    "a16_weekly_best_platform",
    "a17_published_report",
    "w1_top_posts",
    "w2_latest_remarks",
    "w3_latest_snapshot",
    "w5_latest_recommendation",
    "j2_review_queue",
    "j8_posts_with_schedule",
    "j9_brand_access",
    "j15_week_engagement",
    "u1_brand_list",
    "q3_reference_report",
    "q4_uniqueness_report",
    "u2_all_row_checks",
    "g1_prompts",
    "g3_parsed_answers",
    "g5_house_rule_scan_recommendations",
    "m1_posts_after_decisions",
    "m2_schedule_outcomes",
    "m10_tables_after_draft_deletes",
]
RUNS = 3


def run(spark, folder: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", cores, shuffle_partitions=8 if cores == "*" else int(cores))
    times = {}
    for name in names:
        run(spark, folder, name)
        times[name] = round(statistics.median(run(spark, folder, name) for _ in range(RUNS)), 4)
    print(
        json.dumps(
            {
                "metric": "total_median_seconds",
                "value": round(sum(times.values()), 4),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cores": cores,
                "runs": RUNS,
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
