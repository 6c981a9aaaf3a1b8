"""Pairs of streams: a busy key is cut into cells of time, and its pairs are not sent one by one."""

import collections
import random
import time

from pyspark.sql import functions as F

from airtrail.streaming import flows, jobs


class Handle:
    """State of one cell without Spark."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        pass


def opened(records):
    """Pairs and lone rows of what ``Pairs`` sends for sides of one column each."""
    for r in records:
        if not (r._l0 and r._r0):
            yield from [(a, None) for a in r._l0 or []] + [(None, b) for b in r._r0 or []]
        else:
            assert len(r._l0) <= flows.SPAN and len(r._r0) <= flows.SPAN
            yield from [(a, b) for a, first, many in zip(r._l0, r._first, r._many) for b in r._r0[first:first + many]]


def test_a_busy_cell_sends_rows_by_its_rows_not_its_pairs():
    rng = random.Random(9)
    at = {side: [rng.randrange(4_000) for _ in range(1_500)] for side in (0, 1)}
    rows = {side: [(i, t, t % 5 > 0, False) for i, t in enumerate(times)] for side, times in at.items()}
    cell = flows.Pairs(2_000, ["LONG"], ["LONG"], [[0], [0]], [0, 0])
    cell.init(Handle())
    parts = [[rows[side][:700], rows[side][700:]] for side in (0, 1)]
    sent = [r for calls in ((parts[0][0], parts[1][0]), (parts[0][1], parts[1][1])) for r in cell.advance(calls, 0)] + list(cell.advance(([], []), 10**9))
    want = [(i, k) for i, a, own, _ in rows[0] for k, b, _, _ in rows[1] if own and abs(a - b) < 2_000]
    assert collections.Counter(opened(sent)) == collections.Counter(want) and cell.state.get() is None
    assert len(want) > 100_000 and len(sent) < 50


def test_pairs_across_cells_equal_all_pairs(spark, tmp_path):
    """Rows at and around the edges of cells, null keys, rows that come twice, partners that wait in the state."""
    rng = random.Random(4)
    second, width = 1_000_000, flows.CELL_TOLERANCES
    edge = [k * width * second + d for k in (1, 2, 3) for d in (-second, -second + 1, -1, 0, 1, second - 1, second)]
    def some(n):
        return [(i, rng.choice(["a", "b", None]), rng.choice([rng.choice(edge), rng.randrange(4 * width * second), rng.randrange(width * second, width * second + 9 * second)])) for i in range(n)]
    sides, rows = [], {}
    for name, no, ts in (("f", "flow_id", "flow_ts"), ("h", "seq", "http_ts")):
        rows[name] = some(250)
        rows[name] += rows[name][:5]
        for part in (0, 1):
            half = rows[name][part::2] + [(900, name, 10**13)] * part
            spark.createDataFrame(half, f"{no} LONG, socket STRING, us LONG").select(no, "socket", F.timestamp_micros("us").alias(ts)).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
            time.sleep(1.1)  # files are read in the order of their times
        sides.append(spark.readStream.schema(f"{no} LONG, socket STRING, {ts} TIMESTAMP").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name)))
    pairs = jobs.stream_merge_flows(*sides, tol="1 seconds", delay="3 hours")
    assert pairs.columns == ["flow_id", "tcp_socket", "flow_ts", "seq", "http_socket", "http_ts"]
    jobs.run_available(pairs, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).select("flow_id", "tcp_socket", F.unix_micros("flow_ts"), "seq", "http_socket", F.unix_micros("http_ts")).collect()
    met = [(*a, *b) for a in rows["f"] for b in rows["h"] if a[1] == b[1] and abs(a[2] - b[2]) < second]
    lone = [(*a, None, None, None) for a in rows["f"] if a not in {m[:3] for m in met}] + [(None, None, None, *b) for b in rows["h"] if b not in {m[3:] for m in met}]
    assert collections.Counter(tuple(r) for r in got if 900 not in (r[0], r[3])) == collections.Counter(met + lone)
    assert len(met) > 200 and len(lone) > 20
