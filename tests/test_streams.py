"""Streams over several batches."""

from pyspark.sql import functions as F

from airtrail.streaming import jobs


def test_sessions_and_late_rows(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    batches = [[("k", 0, 1), ("k", 200, 2)], [("k", 450, 3), ("k", 5000, 4)], [("k", 10, 99), ("k", 90_000, 5)]]
    stream = jobs.stream_logs(spark, str(source), "k STRING, s LONG, size LONG", ",")
    stream = stream.withColumn("ts", F.timestamp_seconds("s"))
    out = jobs.stream_sessionize(stream, "k", gap="300 seconds", delay="60 seconds")
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k STRING, s LONG, size LONG").coalesce(1).write.mode("append").csv(str(source))
        jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.requests, r.bytes) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 4), (3, 6)]


def test_best_matches(spark):
    """All transfers of a finished hour stay; each connection takes its flow."""
    rows = [(1, "s", 1_000_000, 5, "s", "start", 900_000, 1_000_000), (1, "s", 1_000_000, 6, "s", "continue", None, 1_100_000), (1, "s", 1_000_000, 7, "s", "last", None, 1_200_000),
            (2, "t", 5_000_000, None, None, None, None, None), (None, None, None, 9, "u", "unique", 1_000_000, 1_000_000)]
    pairs = spark.createDataFrame(rows, "flow_id LONG, tcp_socket STRING, t_us LONG, seq LONG, http_socket STRING, connection STRING, conn_us LONG, req_us LONG")
    got = sorted((r.block, r.side, r.pos, r.matched) for r in jobs.best_matches(pairs).collect())
    assert got == [("flow#2", "tcp", 2, False), ("s#1", "http", 5, True), ("s#1", "http", 6, True), ("s#1", "http", 7, True), ("s#1", "tcp", 1, True), ("u#1", "http", 9, False)]


def test_merge_blocks_over_many_batches(spark, tmp_path):
    """Blocks of streams that come in pieces equal the batch, whatever the pieces; nothing waits longer than it must."""
    import random

    from airtrail.operators.matching import merge_flows
    from airtrail.operators.sessions import http_connections
    from airtrail.streaming.flows import stream_merge_blocks

    rng = random.Random(7)
    second = 1_000_000
    sent = [(i, f"s{rng.randrange(4)}", rng.choice(["start", "continue", "last", "unique", "other"]), rng.randrange(3600 * second)) for i in range(400)]
    sent = [(i, s, k, r - rng.randrange(40 * second) if k in ("start", "unique") else None, r) for i, s, k, r in sent]
    flows = [(i, f"s{rng.randrange(5)}", rng.randrange(3600 * second)) for i in range(300)]
    tcp = spark.createDataFrame(flows, "flow_id LONG, socket STRING, t_us LONG")
    http = spark.createDataFrame(sent, "seq LONG, socket STRING, connection STRING, conn_us LONG, req_us LONG")
    want = merge_flows(tcp, http_connections(http, "socket", "req_us", "connection", "seq"), 30 * second)
    names = ["block", "side", "pos", "matched"]
    want = sorted(map(tuple, want.select(names).collect()))

    inputs = {"tcp": (tcp, "t_us", "flow_ts"), "http": (http, "req_us", "http_ts")}
    streams = {}
    for name, (df, at, ts) in inputs.items():
        (tmp_path / name).mkdir()
        rows = df.withColumn(ts, F.timestamp_micros(at))
        streams[name] = spark.readStream.schema(rows.schema).parquet(str(tmp_path / name))
    out = stream_merge_blocks(streams["tcp"], streams["http"], 30 * second, "10 seconds", 60 * second, 7200 * second)
    for piece in range(4):
        for name, (df, at, ts) in inputs.items():
            part = df.where(F.floor(F.col(at) / (900 * second)) == piece).withColumn(ts, F.timestamp_micros(at))
            if piece == 3:
                marker = part.limit(1).withColumns({ts: F.timestamp_seconds(F.lit(4_000_000_000)), "socket": F.lit("marker")})
                part = part.unionByName(marker)
            part.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        jobs.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
        if piece == 1:
            early = spark.read.parquet(str(tmp_path / "out")).count()
    got = spark.read.parquet(str(tmp_path / "out")).where("socket <> 'marker'")
    assert sorted(map(tuple, got.select(names).collect())) == want
    assert early > 100


def test_stream_pairs_against_all_pairs(spark, tmp_path):
    import collections
    import random
    import time

    rng = random.Random(3)
    minute = 60_000_000
    flows = [(i, rng.choice(["a", "b", None]), rng.randrange(600) * minute) for i in range(150)] + [(900, "z", 10**12)]
    sent = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(600) * minute) for i in range(150)] + [(901, "y", 10**12)]
    # two files of each side, so that pairs also meet through the state; a late marker lets everything end
    sides = []
    for name, rows, ts, no in (("f", flows, "flow_ts", "flow_id"), ("h", sent, "http_ts", "seq")):
        for part in (0, 1):
            some = [r for r in rows[:150] if (r[2] >= 300 * minute) == part] + rows[150:] * part
            spark.createDataFrame(some, f"{no} LONG, socket STRING, us LONG").select(no, "socket", F.timestamp_micros("us").alias(ts)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)  # files are read in the order of their times
        sides.append(spark.readStream.schema(f"{no} LONG, socket STRING, {ts} TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    pairs = jobs.stream_merge_flows(*sides, tol="3 minutes", delay="700 minutes")
    jobs.run_available(pairs, str(tmp_path / "out"), str(tmp_path / "state"))
    got = collections.Counter((r.flow_id, r.seq) for r in spark.read.parquet(str(tmp_path / "out")).collect() if {r.flow_id, r.seq}.isdisjoint({900, 901}))
    met = [(a[0], b[0]) for a in flows[:150] for b in sent[:150] if a[1] == b[1] and abs(a[2] - b[2]) < 3 * minute]
    alone = [(a[0], None) for a in flows[:150] if a[0] not in {m[0] for m in met}] + [(None, b[0]) for b in sent[:150] if b[0] not in {m[1] for m in met}]
    assert got == collections.Counter(met + alone)
