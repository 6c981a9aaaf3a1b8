"""Sessions times profiles: cells of a bounded size, outputs in order without a shuffle of the product."""

import glob
import os

from pyspark.sql import functions as F

from airtrail.operators import lookups
from airtrail.plans import jobs
from airtrail.session import scratch
from airtrail.sources import sinks


def people(spark, accounts):
    rows = [(a, f"p{i}", "F", "1980", "2013") for i, a in enumerate(accounts)]
    return spark.createDataFrame(rows, "account string, id string, sex string, birth string, eduy string")


def context(spark, accounts):
    rows = [(a, "B", 1000 - i, 5, None, [("s", None, f"h{i}", 7, 1)]) for i, a in enumerate(accounts)]
    return spark.createDataFrame(rows, "account string, location string, stime long, sdur long, mobile string, services array<struct<sp string, scat string, host string, bytes long, requests long>>")


def plain(sessions, profiles):
    return sorted((p["id"], s["stime"]) for s in sessions for p in profiles if s["account"] is not None and s["account"] == p["account"])


def test_hot_account_lies_in_many_tasks_without_broadcast(spark):
    """One account holds nearly all rows: its pairs are dealt over all tasks, also if no side may be sent whole."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sessions = spark.range(300).select(F.when(F.col("id") < 290, "u").when(F.col("id") < 295, "v").alias("account"), "id")
        profiles = spark.range(210).select(F.when(F.col("id") < 200, "u").when(F.col("id") < 205, "w").alias("account"), F.col("id").alias("p"))
        joined = lookups.join_profiles(sessions, profiles)
        assert joined.columns == ["account", "id", "p"]
        per_task = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        assert sum(per_task) == joined.distinct().count() == 290 * 200
        assert len(per_task) == 4 and max(per_task) < 290 * 200 / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_publish_keeps_rows_and_order_without_a_copy_of_the_product(spark):
    sessions = context(spark, ["a"] * 40 + ["b"] * 3 + [None, "nobody"] + ["a"] * 2)
    profiles = people(spark, ["a", "b", "a", None, "unused"] * 9)
    profiles = profiles.unionAll(profiles.limit(2))  # a profile that stands there twice
    want = plain(sessions.collect(), profiles.collect())
    for limit in ("10MB", "-1"):
        old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            rows = jobs.publish_rows(sessions, profiles, by="id")
            plan = rows.orderBy("id", "stime")._jdf.queryExecution().executedPlan().toString()
            path = scratch(spark, "published")
            acc, traffic = sinks.publish(rows, path)
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        if limit != "-1":  # only the profiles are put in ranges
            assert plan.count("rangepartitioning") == 1
        assert not os.path.exists(path + ".joined")
        lines = [line for f in sorted(glob.glob(traffic + "/part-*")) for line in open(f).read().splitlines()]
        got = [(c[0], int(c[2])) for c in (line.split(",") for line in lines)]
        assert got == sorted(got) and got == want
        ids = [r[0].split(",")[0] for r in spark.read.text(acc).collect()]
        assert sorted(ids) == sorted({i for i, _ in want})
