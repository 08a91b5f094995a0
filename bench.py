"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line.

Each query runs to completion (noop sink: every row is computed, nothing is collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "latest_fetch_wins",
    "prices",
    "power_hourly",
    "desk_daily",
    "wind_versions",
    "forecast_vs_imbalance",
    "decision_hours",
    "snapshot_diff",
    "version_convergence",
    "asof_backward",
    "active_interval_counts",
    "interval_overlap_join",
    "exact_quantiles",
    "spearman_correlation",
    "trailing_stats_28_days",
    "trailing_rank",
    "trailing_mean_of_public_rows",
    "newest_public_vintage",
    "visible_and_held_back",
    "zone_slot_features",
    "storm_score",
    "gap_by_error_decile",
    "stationary_bootstrap_means",
    "rule_nets_by_year",
    "pair_rule_ledger",
    "performance_by_year",
    "trailing_setting_choice",
    "random_days_placebo",
    "walk_forward_linear",
    "live_hourly_mean",
    "walk_forward_trees",
    "event_probability_trees",
    "configuration_neighbours",
    "pooled_rolling_cut",
    "rolling_cut_filter",
    "rolling_pool_rank_size",
    "permuted_days_placebo",
    "static_pairs",
    "available_at_each_deadline",
)


def main() -> None:
    from gridtide.session import local_session
    from gridtide.workload import queries

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    qs = queries()
    only = sys.argv[1:] or HEADLINE
    qs["power_hourly"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up is not part of any query
    times = {}
    for name in only:
        t = time.time()
        qs[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(
        json.dumps(
            {"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
