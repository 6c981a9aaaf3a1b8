"""Headline queries, one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES change what runs."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "p_clean_http", "j_service", "j_building", "w_sessionize", "w_ua_sessions", "w_association_sessions", "w_ip_sessions",
    "w_location_intervals", "j_attach_ip", "j_attach_account", "j_locate_requests", "j_match_flows", "j_tag_protocol", "j_tag_device",
    "a_protocol_breakdown", "a_direction_totals", "a_metric_rollup_days", "a_evaluate_forest", "g_referrer_forest", "g_activity_forest",
    "s_http_log", "s_wifi_syslog", "t_sessionize", "job_wifi_sessions", "job_http_context", "job_http_sessions", "job_flow_merge",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from airtrail import checks
    from airtrail.session import configure

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("airtrail-bench").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="airtrail-bench-")).config("spark.ui.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    wanted = os.environ.get("BENCH_QUERIES")
    queries = checks.all_queries()
    spark.range(1000).groupBy().count().collect()
    times = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
