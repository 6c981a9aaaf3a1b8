"""Covering spans are found by all tasks, however few files hold the two sides."""

from pyspark.sql import functions as F

from airtrail.operators import matching


def test_pairs_of_one_address_lie_in_many_tasks(spark):
    points = spark.range(400).coalesce(1).select(F.col("id").alias("seq"), F.lit("a").alias("ip"), (F.col("id") * 600_000).alias("t_ms"))
    spans = spark.range(400).coalesce(1).select(F.lit("a").alias("ip"), F.col("id").cast("string").alias("mac"), (F.col("id") * 600_000).alias("atime"), (F.col("id") * 600_000 + 2_400_000).alias("rtime"))
    found = matching.mac_by_ip(points, spans)
    got = sorted((r["seq"], int(r["mac"])) for r in found.collect())
    assert got == [(p, s) for p in range(400) for s in range(400) if s * 600_000 - 120_000 <= p * 600_000 <= s * 600_000 + 2_520_000]
    per_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("task")).count().collect()]
    assert len(per_task) == 4 and max(per_task) < len(got) / 2
