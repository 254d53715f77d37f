"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores  (default 8)
BENCH_RUNS    timed runs per query; the median counts (default 3)
BENCH_QUERIES comma-separated names, or "all" (default: the headline list)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import QUERIES  # noqa: E402
from tidemark.session import local_session, scratch  # noqa: E402

HEADLINE = [
    "m03_monthly_revenue",
    "m04_top_countries",
    "m05_monthly_active_customers",
    "m09_label_user_type",
    "m10_revenue_by_user_type",
    "m11_new_customer_ratio",
    "m12_activation_rate",
    "m15_monthly_retention",
    "m17_streak_cohort",
    "m19_first_purchase_cohort",
    "s05_order_cluster",
    "s06_rfm_scores",
    "s06_rfm_scores_fitted",
    "s09_describe",
    "l03_ltv_table",
    "l04_trim_upper",
    "l08_train_test_split",
    "l09_train_multiclass",
    "c03_rate_by_categories",
    "c08_numeric_groups",
    "c09_encode_categoricals",
    "c15_score",
    "f03_add_lags",
    "f07_forecast_next_by_store",
    "u01_campaign_uplift",
    "u12_train_uplift",
    "u15_high_uplift_targeting",
    "x01_t_test",
    "x04_stratified_split",
    "x06_anova_oneway",
    "x07_anova_twoway",
]


def run(query, spark, sf_dir: str) -> float:
    with scratch(spark):
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    run(QUERIES["m03_monthly_revenue"], spark, sf_dir)
    seconds = {n: round(statistics.median(run(QUERIES[n], spark, sf_dir) for _ in range(runs)), 3) for n in names}
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median per query, warm session)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
