"""Stateful operators against plain sequential models and hand-made cases."""

import random

import pytest
from pyspark.sql import functions as F

from airtrail.operators import sessions


def merged(raw, gap):
    """Raw (s, e, place) in order -> cut and merged sessions."""
    out = []
    for s, e, place in raw:
        if out:
            silence = s - out[-1][1]
            if silence < 0:
                out[-1][1] = s
            if out[-1][2] == place and silence < gap:
                out[-1][1] = e
                continue
        out.append([s, e, place])
    return [tuple(x) for x in out]


def walk_associations(events, gap):
    open_at, before, raw = {}, object(), []
    for t, code, ap in events:
        if code in (0, 2):
            if ap not in open_at or before != ap:
                open_at[ap] = t
        elif ap in open_at:
            raw.append((open_at.pop(ap), t, ap))
        before = ap
    return merged(raw, gap)


def walk_addresses(events, gap):
    held, raw = {}, []
    for t, code, ip in events:
        if code == 5:
            held[ip] = (held.get(ip, (t, t))[0], t)
        elif ip in held:
            raw.append((held.pop(ip)[0], t, ip))
    raw += [(a, b, ip) for ip, (a, b) in held.items()]
    return merged(sorted(raw), gap)


@pytest.mark.parametrize("chunk", [500, 86_400_000])
def test_associations_match_walk(spark, chunk):
    r, rows = random.Random(3), []
    for mac in range(40):
        t = 0
        for _ in range(r.randint(1, 40)):
            t += r.randint(1, 60)
            rows.append((f"m{mac if mac % 3 else 0}x{mac % 3 and 1}", t * 40 + mac, r.choice([0, 1, 2, 3]), r.choice(["A", "B", "C", None]), len(rows)))
    df = spark.createDataFrame(rows, "mac STRING, t_ms LONG, code INT, ap STRING, seq LONG")
    got = sorted((tuple(x) for x in sessions.association_sessions(df, 100, chunk=chunk).collect()), key=str)
    want = []
    for mac in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == mac), key=lambda x: (x[1], x[4]))
        want += [(mac, s, e, a) for s, e, a in walk_associations([(t, c, a) for _, t, c, a, _ in mine], 100)]
    assert got == sorted(want, key=str)


def test_addresses_match_walk(spark):
    r, rows = random.Random(4), []
    for mac in range(20):
        t = 0
        for _ in range(r.randint(1, 30)):
            t += r.randint(1, 60)
            rows.append((f"m{mac}", t, r.choice([5, 5, 6]), r.choice(["x", "y"]), len(rows)))
    df = spark.createDataFrame(rows, "mac STRING, t_ms LONG, code INT, ip STRING, seq LONG")
    got = sorted(tuple(x) for x in sessions.ip_sessions(df, 10, chunk=50).collect())
    want = []
    for mac in {x[0] for x in rows}:
        want += [(mac, s, e, ip) for s, e, ip in walk_addresses([(t, c, ip) for m, t, c, ip, q in rows if m == mac], 10)]
    assert got == sorted(want)


@pytest.mark.parametrize("events,want", [
    ([(0, 0, "A"), (10, 1, "A"), (15, 0, "A"), (30, 1, "A")], [(0, 30, "A")]),
    ([(0, 0, "A"), (10, 1, "A"), (20, 0, "A"), (30, 1, "A")], [(0, 10, "A"), (20, 30, "A")]),
    ([(0, 0, "A"), (5, 0, "B"), (8, 1, "A"), (20, 1, "B")], [(0, 5, "A"), (5, 20, "B")]),
    ([(4, 1, "A")], []),
])
def test_association_cases(spark, events, want):
    rows = [("m", t * 1000, c, a, i) for i, (t, c, a) in enumerate(events)]
    df = spark.createDataFrame(rows, "mac STRING, t_ms LONG, code INT, ap STRING, seq LONG")
    got = sorted((x.s_ms // 1000, x.e_ms // 1000, x.ap) for x in sessions.association_sessions(df).collect())
    assert got == want


def test_context_cases(spark):
    rows = [("u", "A", 0, 1), ("u", "B", 10, 2), ("u", "B", 20, 3), (None, "B", 20, 4), ("u", "B", 400_000, 5), ("u", "B", 86_400_000, 6)]
    df = spark.createDataFrame(rows, "account STRING, location STRING, stime LONG, seq LONG")
    got = {x.seq: x.sid for x in sessions.context_sessions(df, chunk=15).collect()}
    assert got[2] == got[3] and len({got[i] for i in (1, 2, 4, 5, 6)}) == 5


def test_gap_equal_to_limit_stays(spark):
    df = spark.createDataFrame([("k", 0), ("k", 300), ("k", 601)], "k STRING, t LONG")
    assert [r.session_start for r in sessions.sessionize(df, ["k"], "t", 300).orderBy("t").collect()] == [0, 0, 601]


def test_clicks_keep_the_last(spark):
    df = spark.createDataFrame([(0,), (900,), (1900,), (5000,)], "t LONG")
    assert sorted((r.click, r.events) for r in sessions.screen_clicks(df, "t").collect()) == [(0, 2), (1900, 1), (5000, 1)]


def walk_locations(rows, limit):
    spans = []
    for t, kind in rows:
        if kind == "alloc":
            if spans and not spans[-1][2]:
                spans[-1][1] = t
            else:
                spans.append([t, t, False])
        else:
            for span in reversed(spans):
                if 0 <= t - span[0] <= limit:
                    span[1], span[2] = t, True
                    break
    return [(a, b) for a, b, _ in spans]


def test_location_intervals_match_walk(spark):
    r, rows = random.Random(5), []
    for mac in range(60):
        t = 0
        for _ in range(r.randint(1, 12)):
            t += r.randint(1, 60)
            rows.append(("ip", f"m{mac}", t, r.choice(["alloc", "recycle"]), len(rows)))
    df = spark.createDataFrame(rows, "ip STRING, mac STRING, t_ms LONG, kind STRING, seq LONG")
    got = sorted((x.mac, x.atime, x.rtime) for x in sessions.location_intervals(df, chunk=40, limit=70).collect())
    want = sorted((m, a, b) for m in {x[1] for x in rows} for a, b in walk_locations([(t, k) for _, mm, t, k, _ in rows if mm == m], 70))
    assert got == want


def test_connections_reset_after_close(spark):
    kinds = ["start", "continue", "last", "continue", "unique", "start", "continue"]
    df = spark.createDataFrame([("s", i, k) for i, k in enumerate(kinds)], "socket STRING, t LONG, kind STRING").withColumn("seq", F.col("t"))
    got = [r.conn_no for r in sessions.http_connections(df, "socket", "t", "kind", "seq", 2).orderBy("t").collect()]
    assert got == [1, 1, 1, 2, 3, 4, 4]
