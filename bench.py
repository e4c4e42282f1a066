"""Seconds per headline query, after one warm-up run; BENCH_RUNS timed runs (median). Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from meshledger import catalog
from meshledger.session import build_session

HEADLINE = (
    "weekly_category_bytes", "hourly_traffic_stats", "weekday_mean_bytes", "weekly_protocol_bytes",
    "rolling_directions", "org_top_n", "hourly_active_users", "user_counts_over_time",
    "user_activity", "category_share_per_quantile", "uplink_ratio_per_user", "log_gaps",
    "purchase_sessions", "currency_ledger", "credit_time_share", "revenue_series", "arpu",
    "spend_inequality", "classified_flows", "flows_with_domain", "dedup_rows", "data_balance",
    "call_trace_one_minute", "price_distribution", "dns_coverage",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(
        "meshledger-bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    for name in HEADLINE:
        times = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "1")) + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
