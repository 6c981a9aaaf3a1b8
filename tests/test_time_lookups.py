"""Skew-safe primitives against brute force, for several chunk widths."""

import random

import pytest
from pyspark.sql import functions as F

from airtrail.checks.tables import SUFFIXES
from airtrail.operators.matching import cover_all
from airtrail.operators.nearest import first_cover, first_within
from airtrail.operators.ordered import mark_gap_sessions, with_islands, with_previous, with_running

R = random.Random(1)
POINTS = [(i, R.choice("aaab"), R.randint(0, 3000)) for i in range(300)]
EVENTS = [(R.choice("aaab"), R.randint(0, 3000), i) for i in range(100)]
SPANS = [(R.choice("aaab"), s, s + R.randint(0, 200), i) for i, s in enumerate(R.randint(0, 3000) for _ in range(60))]


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(POINTS, "id INT, k STRING, t LONG").repartition(4)


@pytest.mark.parametrize("below,above", [(59, 59), (5, 0), (0, 7), (20, 3)])
def test_first_within(spark, points, below, above):
    events = spark.createDataFrame(EVENTS, "k STRING, a LONG, o INT")
    got = {r.id: r.hit and r.hit.o for r in first_within(points, events, ["k"], "t", "a", ["o"], ["a"], below, above).collect()}
    want = {i: min((o for q, a, o in EVENTS if q == k and t - below <= a <= t + above), default=None) for i, k, t in POINTS}
    assert got == want


@pytest.mark.parametrize("tol,chunk,exact", [(0, 100, True), (50, 37, True), (50, 5000, True), (50, 100, False)])
def test_first_cover(spark, points, tol, chunk, exact):
    spans = spark.createDataFrame(SPANS, "k STRING, s LONG, e LONG, i INT")
    got = {r.id: r.hit and r.hit.i for r in first_cover(points, spans, ["k"], "t", "s", "e", ["i"], ["i"], tol, chunk, exact_first=exact).collect()}

    def best(k, t, slack):
        return min(((s, i) for q, s, e, i in SPANS if q == k and s - slack <= t <= e + slack), default=None)

    want = {i: (exact and best(k, t, 0)) or best(k, t, tol) for i, k, t in POINTS}
    assert got == {i: w and w[1] for i, w in want.items()}


def test_cover_all(spark, points):
    spans = spark.createDataFrame([(k, s * 1000, e * 400_000, i) for k, s, e, i in SPANS], "k STRING, s LONG, e LONG, i INT")
    wide = points.withColumn("t", F.col("t") * 100_000)
    got = sorted((r.id, r.i) for r in cover_all(wide, spans, ["k"], "t", "s", "e", 500).collect())
    want = sorted((p, i) for p, k, t in POINTS for q, s, e, i in SPANS if q == k and s * 1000 - 500 <= t * 100_000 <= e * 400_000 + 500)
    assert got == want


@pytest.mark.parametrize("chunk", [1, 77, 10_000])
def test_chunks_equal_whole_window(points, chunk):
    def run(c):
        a = with_previous(points, ["k"], ["t", "id"], ["t"], c)
        a = with_running(a, ["k"], ["t", "id"], F.col("t"), "top", c, "max", inclusive=False)
        a = with_running(a, ["k"], ["t", "id"], F.col("id"), "sum", c)
        return with_islands(a, ["k"], ["t", "id"], ["t"], lambda p: F.col("t") - p["t"] > 10, c, "run").orderBy("id").collect()

    assert run(chunk) == run(None)


@pytest.mark.parametrize("strict", [False, True])
def test_gap_sessions(points, strict):
    got = {r.id: r.session_start for r in mark_gap_sessions(points, ["k"], "t", 10, strict).collect()}
    for key in "ab":
        start = last = None
        for t, i in sorted((t, i) for i, k, t in POINTS if k == key):
            if last is None or (t - last >= 10 if strict else t - last > 10):
                start = t
            last = t
            assert got[i] == start


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_hot_key_is_spread(spark, uncoalesced):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.col("id"))
    events = spark.range(0, 4000, 7).select(F.lit("hot").alias("k"), F.col("id").alias("a"), F.col("id").alias("o"))
    spans = events.select("k", F.col("a").alias("s"), (F.col("a") + 3).alias("e"), "o")
    for out in (
        with_islands(rows, ["k"], ["t", "id"], ["t"], lambda p: F.col("t") - p["t"] > 10, 100, "run"),
        first_within(rows, events, ["k"], "t", "a", ["o"], [], 20, 20),
        first_cover(rows, spans, ["k"], "t", "s", "e", ["o"], ["o"], 0, 100),
    ):
        used = F.max(F.hash(out.columns[-1]))  # keeps the optimizer from dropping the work
        sizes = [r.n for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), used).collect()]
        assert sum(sizes) == 4000 and len(sizes) >= 8 and max(sizes) < 1600


def test_broken_and_very_long_spans(spark):
    """A span whose end is far beyond any time, and one of ten years, fill only the blocks between the points."""
    from airtrail.operators import matching
    from airtrail.operators.nearest import first_cover

    year = 365 * 86_400_000
    points = spark.createDataFrame([(1, "k", 1_000), (2, "k", 5 * year), (3, "j", 2_000)], "seq LONG, k STRING, t LONG")
    spans = spark.createDataFrame([("k", 0, 9_000_000_000_000_000_000 // 1000, "broken"), ("j", 0, 10 * year, "long")], "k STRING, lo LONG, hi LONG, v STRING")
    got = {r.seq: r.hit.v for r in first_cover(points, spans, ["k"], "t", "lo", "hi", ["hi"], ["v"]).collect()}
    assert got == {1: "broken", 2: "broken", 3: "long"}
    sessions = spark.createDataFrame([("m", 0, 10 * year, "A", "i", "acc")], "mac STRING, s_ms LONG, e_ms LONG, ap STRING, ip STRING, account STRING")
    asks = spark.createDataFrame([(1, "i", 3 * year + 5, "h.example"), (2, "i", 3 * year + 86_400_000, "h.example")], "seq LONG, ip STRING, stime LONG, host STRING")
    assert {r.seq: r.location for r in matching.locate_requests(asks, sessions, SUFFIXES, span_days=True).collect()} == {1: "A", 2: "A"}
