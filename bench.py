"""Time the reports on $BENCH_SF_DIR with local[$BENCH_CPUS]; one JSON line on the last line of output."""
from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES
from pagetally.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
ROUNDS = int(os.environ.get("BENCH_ROUNDS", "3"))

HEADLINES = [
    "scan_events_v5", "scan_by_key", "rollup_pageviews", "rollup_checkpoints", "global_row_number", "p75_exact",
    "dashboard", "dashboard_rising", "pageviews_hour", "pageviews_day", "pageviews_month", "pageviews_filtered",
    "pageviews_pivot", "sources_aggregated", "sources_by_url", "sources_targets", "targets_split", "not_found",
    "checkpoint_urls", "checkpoint_funnel", "bounces", "bundles", "content_requests_month", "content_requests_year",
    "forms", "experiments", "intervals", "vitals_correlation", "experience_score", "domain_list", "golive_hints",
    "dev_urls", "guess_hostname", "rotate_keys", "upsert_domain_info", "add_audit_scores", "csv_export",
]


def main() -> None:
    builder = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
    )
    spark = configure(builder).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    best: dict[str, float] = {}
    # the first round warms the JVM; the best of the rounds counts
    for _ in range(ROUNDS):
        for name in HEADLINES:
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best[name] = round(min(took, best.get(name, took)), 3)
    found = re.search(r"sf([\d.]+)", SF_DIR)
    print(json.dumps({
        "metric": "report_seconds_total", "value": round(sum(best.values()), 3), "unit": "sec", "queries": best,
        "sf": float(found.group(1)) if found else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
