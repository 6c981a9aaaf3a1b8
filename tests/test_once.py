"""Rows that several steps need are made once."""

from pyspark.sql import functions as F

from airtrail.operators import matching
from airtrail.sources import sinks


def counted(spark, df):
    """The same rows, and an accumulator of how many were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema), made


def test_attach_ip_makes_its_sides_once(spark):
    moves = spark.createDataFrame([("m", 100 * i, 100 * i + 40, "a") for i in range(20)] + [(None, 1, 2, "b"), ("m", 50, 20, "a")], "mac STRING, s_ms LONG, e_ms LONG, ap STRING")
    held = spark.createDataFrame([("m", 90 * i, 90 * i + 60, f"ip{i}") for i in range(15)], "mac STRING, s_ms LONG, e_ms LONG, ip STRING")
    (some, n_moves), (known, n_held) = counted(spark, moves), counted(spark, held)
    want = sorted(map(str, matching.attach_ip(moves, held, 30).collect()))
    assert sorted(map(str, matching.attach_ip(some, known, 30).collect())) == want and len(want) == 22
    assert (n_moves.value, n_held.value) == (22, 15)


def test_flow_block_rows_are_made_once(spark, tmp_path):
    rows = [("b#1", "tcp", 1, "f1"), ("b#1", "http", 2, "h2"), ("b#1", "http", 1, "h1"), ("flow#7", "tcp", 7, "f7"), ("b#2", "http", 3, "h3")]
    blocks, made = counted(spark, spark.createDataFrame(rows, "block STRING, side STRING, pos LONG, line STRING"))
    sinks.write_flow_blocks(blocks, str(tmp_path / "blocks"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "blocks")).orderBy(F.input_file_name(), F.monotonically_increasing_id()).collect()]
    assert lines == ["TCP: f1", "HTTP: h1", "HTTP: h2", "TCP: -", "HTTP: h3", "TCP: f7", "HTTP: -"]
    assert made.value == len(rows)
