"""Work that stays spread out, state that goes on, rules as tables: against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from airtrail.operators import lookups, ordered, sessions, stats
from airtrail.sources import lines, tables
from airtrail.streaming import jobs


def plain_sessions(times: list, gap: int) -> dict:
    out, start, before = {}, None, None
    for t in sorted(times):
        if before is None or t - before > gap:
            start = t
        out[t], before = start, t
    return out


@pytest.mark.parametrize("fan,levels", [(4, 1), (3, 2), (2, 4), (4096, 1)])
def test_gap_sessions_of_one_key_in_blocks_of_cells(spark, monkeypatch, fan, levels):
    """A constant key and a short gap: blocks of few cells, a tree of blocks, null keys beside it."""
    monkeypatch.setattr(ordered, "FAN", fan)
    rng = random.Random(fan)
    times, t = [], 0
    for _ in range(700):
        t += rng.choice([0, 1, 900, 1000, 1001, 1002, 5000, 40_000])
        times.append(t)
    rows = [("k", t) for t in times] + [(None, t + 7) for t in times[::2]]
    df = spark.createDataFrame(rows, "k STRING, t LONG").repartition(5)
    cells = ordered.gap_cells(df, ["k"], "t", 1000, {"n": (F.lit(1), "count")}, levels=levels)
    for key, some in (("k", times), (None, [t + 7 for t in times[::2]])):
        want = plain_sessions(some, 1000)
        got = {r._lo: r.session_start for r in cells.where(F.col("k").eqNullSafe(key)).collect()}
        assert got == {t: want[t] for t in got} and sum(r.n for r in cells.where(F.col("k").eqNullSafe(key)).collect()) == len(some)


@pytest.mark.parametrize("levels", [1, 3])
def test_runs_and_sums_of_null_keys_in_a_tree_of_chunks(spark, monkeypatch, levels):
    monkeypatch.setattr(ordered, "FAN", 3)
    rng = random.Random(2)
    rows = [(k, i * 10 + rng.randrange(10), rng.choice("ab")) for k in ("x", None) for i in range(200)]
    df = spark.createDataFrame(rows, "k STRING, t LONG, v STRING").repartition(4)
    runs = ordered.with_islands(df, ["k"], ["t"], ["v"], lambda prev: F.col("v") != prev["v"], 25, "run", levels)
    runs = ordered.with_running(runs, ["k"], ["t"], F.col("t"), "total", 25, "sum", levels=levels)
    runs = ordered.with_running(runs, ["k"], ["t"], F.col("t") % 37, "low", 25, "min", levels=levels)
    got = {(r.k, r.t): (r.run, r.total, r.low, r.prev and r.prev.v) for r in ordered.with_previous(runs, ["k"], ["t"], ["v"], 25, levels=levels).collect()}
    for key in ("x", None):
        run = total = 0
        low, before = None, None
        for k, t, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            run, total, low = run + (v != before), total + t, t % 37 if low is None else min(low, t % 37)
            assert got[k, t] == (run, total, low, before)
            before = v


def test_no_task_holds_most_cells_of_a_constant_key(spark):
    """One million seconds of one key: every window task gets a block of cells."""
    df = spark.range(0, 1_000_000, 1).select((F.col("id") * 1000).alias("t"), F.lit(0).alias("k"))
    cells = ordered.gap_cells(df, ["k"], "t", 1000, {"n": (F.lit(1), "count")})
    per_block = cells.groupBy(F.floor(F.col("_cell") / ordered.FAN).alias("b")).count().agg(F.max("count")).first()[0]
    assert per_block <= ordered.FAN and cells.select("session_start").distinct().count() == 1


def test_location_days_one_by_one(spark):
    """Five days in turn equal all at once, late recycles and untouched addresses included."""
    rng = random.Random(11)
    hour = 3_600_000
    log, t = [], 0
    for i in range(600):
        t += rng.randrange(hour)
        log.append((f"ip{rng.randrange(4)}", rng.choice(["m1", "m2", "m3"]), t, rng.choice(["alloc", "alloc", "recycle"]), i))
    df = spark.createDataFrame(log, "ip STRING, mac STRING, t_ms LONG, kind STRING, seq LONG")
    want = sorted(map(tuple, sessions.location_intervals(df, limit=6 * hour).collect()))
    state, step = None, t // 5 + 1
    for day in range(5):
        rows = df.where(F.floor(F.col("t_ms") / step) == day)
        state = sessions.location_state(rows, limit=6 * hour) if state is None else sessions.extend_locations(state, rows, limit=6 * hour)
        state = spark.createDataFrame(state.collect(), state.schema)
    assert sorted(map(tuple, state.select("ip", "mac", "atime", "rtime").collect())) == want
    assert state.where("last").groupBy("ip", "mac").count().where("count > 1").count() == 0


@pytest.mark.parametrize("accuracy", [10, 1000])
def test_percentiles_are_exact_however_coarse_the_sketch(spark, accuracy):
    rng = random.Random(3)
    rows = [(b, rng.choice([None, rng.randrange(50), rng.randrange(10**6)]), rng.gauss(0, 1)) for b in (1, 1, 1, 2) for _ in range(1500)] + [(3, None, 1.0)]
    df = spark.createDataFrame(rows, "b INT, v LONG, w DOUBLE").repartition(4)
    got = {r.b: r for r in stats.exact_percentiles(df, ["b"], {"v": [1, 50, 90, 95, 100], "w": [50]}, accuracy).collect()}
    for b in (1, 2, 3):
        for name, at, ps in (("v", 1, (1, 50, 90, 95, 100)), ("w", 2, (50,))):
            values = sorted(r[at] for r in rows if r[0] == b and r[at] is not None)
            for p in ps:
                assert got[b][f"{name}_prc{p}"] == (values[max(1, -(-len(values) * p // 100)) - 1] if values else None)


def test_suffix_rules_as_a_table(spark, tmp_path):
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.dat").write_text("// comment\ncom\nco.uk\nuk\n")
    (tmp_path / "rules" / "b.dat").write_text("*.ck\n!www.ck\n\nXN--P1AI rest\n")
    rules = tables.read_suffix_rules(spark, str(tmp_path / "rules"))
    hosts = {"http://www.a.com/x": "a.com", "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.y.ck": "x.y.ck", "z.x.y.ck": "x.y.ck", "www.ck": "www.ck", "a.www.ck": "www.ck",
             "10.0.0.1": "10.0.0.1", "Q.Example.COM:80": "Example.COM", "a.b.xn--p1ai": "b.xn--p1ai", "localhost": "localhost", None: None}
    df = spark.createDataFrame([(h,) for h in [*hosts, "a.b.co.uk"]], "url STRING")
    got = [(r.url, r.domain) for r in lookups.add_domain(df, "url", rules).collect()]
    assert len(got) == len(hosts) + 1 and dict(got) == hosts
    listed = tables.read_lookup(spark, "suffixes", str(tmp_path / "rules" / "*.dat"))
    assert {"com", "co.uk", "uk", "xn--p1ai"} == set(listed.plain) and listed.wildcards == ("ck",) and listed.exceptions == ("www.ck",)
    with pytest.raises(ValueError, match="2 files"):
        tables.read_lookup(spark, "services", str(tmp_path / "rules" / "*.dat"))


def test_trace_lines_go_on_over_files_and_splits(spark, tmp_path):
    want = []
    for name in ("t3.log", "t1.log", "t2.log"):
        body = [f"{name} line {i} " + "x" * (i % 50) for i in range(400)]
        (tmp_path / name).write_text("\n".join(body) + "\n")
        want.append((name, body))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = sorted((r.line_no, r.value) for r in lines.trace_lines(spark, str(tmp_path)).collect())
        assert lines.ordered_lines(spark, str(tmp_path)).select("file", "split").distinct().count() > 6
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == list(enumerate(v for _, body in sorted(want) for v in body))


def test_landing_again_changes_nothing(spark, tmp_path):
    import shutil

    source, path, notes = (str(tmp_path / x) for x in ("in", "out", "notes"))
    spark.range(100).select((F.col("id") * 600_000).alias("t")).repartition(3).write.parquet(source)
    stream = spark.readStream.schema("t LONG").option("maxFilesPerTrigger", 1).parquet(source)

    def land() -> list:
        jobs.land_stream(stream, path, F.timestamp_millis("t"), notes)
        return sorted(r.t for r in spark.read.parquet(path).collect())

    want = [i * 600_000 for i in range(100)]
    assert land() == want and land() == want
    shutil.rmtree(f"{notes}/commits")
    assert land() == want  # the ledger knows the batches
    shutil.rmtree(f"{notes}/commits")
    shutil.rmtree(f"{path}.ledger")
    assert land() == want  # they replace their folders
