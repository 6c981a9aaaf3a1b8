"""Joins by key and time: hand-made cases."""

import random

from pyspark.sql import functions as F

from airtrail.checks.tables import SUFFIXES
from airtrail.functions.times import DAY_MS
from airtrail.operators import lookups, matching

MOVE = "mac STRING, s_ms LONG, e_ms LONG, ap STRING"
MIN = 60_000


def test_attach_ip_exact_then_fuzzy(spark):
    moves = spark.createDataFrame([("m", 10 * MIN, 20 * MIN, "A"), ("m", 60 * MIN, 70 * MIN, "B"), ("m", 300 * MIN, 310 * MIN, "C"), ("m", 300 * MIN, 310 * MIN, "C")], MOVE)
    ips = spark.createDataFrame([("m", 5 * MIN, 30 * MIN, "old"), ("m", 12 * MIN, 15 * MIN, "new"), ("m", 40 * MIN, 57 * MIN, "first"), ("m", 73 * MIN, 80 * MIN, "second")],
                                "mac STRING, s_ms LONG, e_ms LONG, ip STRING")
    got = sorted((r.ap, r.ip) for r in matching.attach_ip(moves, ips, cell=7 * MIN).collect())
    assert got == [("A", "new"), ("B", "first"), ("C", None), ("C", None)]


def test_attach_account_drops_mismatch(spark):
    rows = [("a", 0, 1, "A", "x"), ("b", 0, 1, "A", "x"), ("c", 0, 1, "A", "x"), ("d", 0, 1, "A", None)]
    moves = spark.createDataFrame(rows, MOVE + ", ip STRING")
    auths = spark.createDataFrame([("a", 5, "ann", "y"), ("b", 5, "bob", "0.0.0.0"), ("d", 5, "dan", "z")], "mac STRING, t_ms LONG, account STRING, ip STRING")
    assert sorted((r.mac, r.account) for r in matching.attach_account(moves, auths).collect()) == [("b", "bob"), ("c", None)]


def test_locate_requests_earliest_session(spark):
    http = spark.createDataFrame([(1, "i", 15 * MIN, "www.a.com"), (2, "i", 34 * MIN, "b.com"), (3, "i", 60 * MIN, "c.com")], "seq LONG, ip STRING, stime LONG, host STRING")
    moves = spark.createDataFrame([("m", 10 * MIN, 20 * MIN, "A", "i", "u"), ("n", 12 * MIN, 30 * MIN, "B", "i", "v")], MOVE + ", ip STRING, account STRING")
    got = sorted((r.seq, r.location, r.host) for r in matching.locate_requests(http, moves, SUFFIXES).collect())
    assert got == [(1, "A", "a.com"), (2, "B", "b.com")]


def test_flow_tolerance_is_strict(spark):
    flows = spark.createDataFrame([(1, "s", 179_999_999, "x"), (2, "s", 180_000_000, "y"), (3, "q", 0, "z")], "flow_id LONG, socket STRING, t_us LONG, line STRING")
    sent = spark.createDataFrame([("s", 1, 7, "unique", 0, 10, "h")], "socket STRING, conn_no LONG, seq LONG, connection STRING, conn_us LONG, req_us LONG, line STRING")
    sent = sent.withColumn("conn_us", F.lit(None).cast("long")).withColumn("req_us", F.lit(0).cast("long"))
    got = sorted((r.block, r.side, r.matched) for r in matching.merge_flows(flows, sent).collect())
    assert got == [("flow#2", "tcp", False), ("flow#3", "tcp", False), ("s#1", "http", True), ("s#1", "tcp", True)]


def test_protocol_first_in_order(spark):
    flows = spark.createDataFrame([(1, "s", 60_000_000), (2, "s", 200_000_000)], "flow_id LONG, socket STRING, t_us LONG")
    dpi = spark.createDataFrame([("s", 1, "TCP", "1/late", 2), ("s", 119_999_999, "TCP", "2/first", 1), ("s", 0, "TCP", "3/edge", 0), ("s", 60_000_000, "UDP", "4/udp", -1)],
                                "socket STRING, dpi_us LONG, l4 STRING, detected STRING, dpi_no LONG")
    assert sorted((r.flow_id, r.protocol) for r in matching.tag_protocol(flows, dpi).collect()) == [(1, "2/first"), (2, "N/A")]


def test_ap_by_ip_prefers_device_with_ap(spark):
    ips = spark.createDataFrame([("i", "m", 0, 10), ("i", "n", 5, 20), ("j", "o", 0, 10), ("j", "p", 1, 10)], "ip STRING, mac STRING, atime LONG, rtime LONG")
    aps = spark.createDataFrame([("n", "A", 0, 100)], "mac STRING, ap STRING, start LONG, end LONG")
    asks = spark.createDataFrame([(1, "i", 8), (2, "j", 8), (3, "k", 8)], "seq LONG, ip STRING, t_ms LONG")
    got = {r.seq: (r.found_mac, r.found_ap) for r in matching.ap_by_ip(asks, ips, aps, tol=0).collect()}
    assert got == {1: ("n", "A"), 2: ("p", None), 3: (None, None)}


def test_ap_by_ip_builds_no_pairs(spark):
    # one address that many devices hold all the time: every point meets each of them, but no row stands for such a pair
    n, day = 400, DAY_MS
    ips = spark.range(n).select(F.lit("i").alias("ip"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("mac"), F.col("id").alias("atime"), F.lit(day).alias("rtime"))
    aps = spark.createDataFrame([("m7", "late", day // 2, day), ("m9", None, 0, day), ("m11", "A", 500, 700), ("m11", "B", 600, 900)], "mac STRING, ap STRING, start LONG, end LONG")
    asks = spark.range(n).select(F.col("id").alias("seq"), F.lit("i").alias("ip"), (F.col("id") * (day // n) + 650).alias("t_ms"))
    df = matching.ap_by_ip(asks, ips, aps, tol=0)
    got = {r.seq: (r.found_mac, r.found_ap) for r in df.collect()}
    assert got[0] == ("m11", "A") and got[1] == (f"m{n - 1}", None) and got[n - 1] == ("m7", "late") and len(got) == n
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert not any("_q_ip" in line or "_g" in line for line in joins) and "MapInArrow" in plan


def test_ap_by_ip_against_all_pairs(spark):
    rng = random.Random(5)
    ips = [(f"i{rng.randrange(3)}", rng.choice([None, "a", "b", "c", "ab"]), s, s + rng.randrange(-3, 40)) for s in (rng.randrange(200) for _ in range(150))]
    aps = [(rng.choice(["a", "b", "c", "ab"]), rng.choice([None, "P", "Q"]), s, s + rng.randrange(-3, 12)) for s in (rng.randrange(200) for _ in range(60))]
    asks = [(k, rng.choice([None, "i0", "i1", "i2", "i3"]), rng.choice([None, *range(-5, 230)])) for k in range(400)]
    least = lambda v: (v is not None, v or "")  # noqa: E731  nulls first

    def place(mac, t):
        met = [(s, e, least(p), p) for m, p, s, e in aps if m == mac and e >= s and s - 2 <= t <= e + 2]
        return min(met)[3] if met else None

    want = {}
    for k, ip, t in asks:
        met = [] if t is None else [(a, r, least(m), m, place(m, t)) for i, m, a, r in ips if i == ip and a - 2 <= t <= r + 2]
        on = [h[:4] + (h[4],) for h in met if h[4] is not None]
        want[k] = min(on)[3:] if on else (max(h[:4] for h in met)[3], None) if met else (None, None)
    frames = [spark.createDataFrame(rows, ddl) for rows, ddl in ((asks, "seq LONG, ip STRING, t_ms LONG"), (ips, "ip STRING, mac STRING, atime LONG, rtime LONG"),
                                                                (aps, "mac STRING, ap STRING, start LONG, end LONG"))]
    for cell in (7, 1000):
        assert {r.seq: (r.found_mac, r.found_ap) for r in matching.ap_by_ip(*frames, tol=2, cell=cell).collect()} == want


def test_click_window(spark):
    rows = spark.createDataFrame([("x", 1, 0, 1000), ("x", 1, 0, 1500), ("x", 2, 0, 3000), ("y", 3, 0, 2999)], "agent STRING, tree LONG, trace INT, t LONG")
    clicks = spark.createDataFrame([(0, 1000)], "trace INT, click LONG")
    got = sorted((r.agent, r.tree) for r in matching.click_match(rows, clicks, ["trace"], ["agent", "tree"], "t", "click").distinct().collect())
    assert got == [("x", 1), ("x", 1), ("y", 3)]


def test_host_rules_lowest_number_wins(spark):
    hosts = spark.createDataFrame([("mail.shop.example",), ("ashopxexample",), ("zzz",)], "host STRING")
    rules = [(1, r"mail\.shop\.example", "mail"), (2, r"shop\.example", "site"), (3, "shop.example$", "any")]
    assert {r.host: r.category for r in lookups.classify_hosts(hosts, "host", rules).collect()} == {"mail.shop.example": "mail", "ashopxexample": "any", "zzz": None}


def test_building_longest_code(spark):
    aps = spark.createDataFrame([("MH-XLIB2-3F-01",), ("LIB-1F-1",), ("NONE",), (None,)], "ap STRING")
    codes = spark.createDataFrame([("LIB", "Library", "t", "u", 1.0, 2.0), ("LIB2", "Library 2", "t", "u", 1.0, 2.0)], "code STRING, name STRING, type STRING, user STRING, lon DOUBLE, lat DOUBLE")
    got = {r.ap: r.building_name for r in lookups.add_building(aps, "ap", codes).collect()}
    assert got == {"MH-XLIB2-3F-01": "Library 2", "LIB-1F-1": "Library", "NONE": None, None: None}


def test_unmatched_blocks_as_text(spark, tmp_path):
    from airtrail.operators.sessions import flow_blocks
    from airtrail.sources import lines, sinks

    rows = [("b1", "tcp", 1, "t1"), ("b1", "http", 5, "h5"), ("b1", "http", 4, "h4"), ("b2", "tcp", 2, "t2"), ("b3", "http", 6, "h6")]
    path = str(tmp_path / "blocks")
    sinks.write_flow_blocks(spark.createDataFrame(rows, "block STRING, side STRING, pos LONG, line STRING").coalesce(1), path)
    read = flow_blocks(lines.ordered_lines(spark, path)).orderBy("file", "split", "pos").collect()
    assert [r.value for r in read] == ["TCP: t1", "HTTP: h4", "HTTP: h5", "TCP: t2", "HTTP: -", "TCP: -", "HTTP: h6"]


def plain_addresses(sessions: list, addresses: list, shift: int) -> list:
    """Every pair of a device and day."""
    out = []
    for mac, s, e, ap in sessions:
        held = [(a, b, ip) for m, a, b, ip in addresses if mac is not None and m == mac and b >= a and a // DAY_MS == s // DAY_MS]
        exact = [x for x in held if x[0] <= e and x[1] >= s]
        near = [x for x in held if x[0] - shift <= e and x[1] + shift >= s]
        out.append((mac, s, e, ap, max(exact)[2] if exact else min(near)[2] if near else None))
    return sorted(out, key=str)


def test_attach_ip_equals_pairs(spark):
    """Nested, equal, broken and day-long address sessions, null devices, repeated rows."""
    rng = random.Random(1)
    moves, held = [], []
    for _ in range(1500):
        s = rng.randrange(0, 2 * DAY_MS)
        e = s + int(rng.paretovariate(0.5) * 1000) % (DAY_MS // 2) if rng.random() > 0.2 else s - rng.randrange(2_000_000)
        moves.append((rng.choice(["hot", "hot", "a", "b", None]), s, e, rng.choice(["x", "y"])))
    for _ in range(800):
        s = rng.randrange(0, 2 * DAY_MS)
        e = s + int(rng.paretovariate(0.4) * 500) % (3 * DAY_MS) if rng.random() > 0.1 else s - 10 * rng.randrange(2)
        held.append((rng.choice(["hot", "hot", "a", "b", None]), s, e, f"i{rng.randrange(9)}"))
    moves, held = moves + moves[:20], held + held[:20]
    left = spark.createDataFrame(moves, MOVE).repartition(3)
    right = spark.createDataFrame(held, "mac STRING, s_ms LONG, e_ms LONG, ip STRING").repartition(3)
    got = matching.attach_ip(left, right).select("mac", "s_ms", "e_ms", "ap", "ip").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_addresses(moves, held, 300_000)


def test_attach_ip_makes_no_pairs(spark):
    """One device with 3,000 address sessions and 3,000 sessions that overlap all of them: rows stay linear."""
    left = spark.range(3000).select(F.lit("hot").alias("mac"), F.col("id").alias("s_ms"), (F.col("id") + 40_000_000).alias("e_ms"), F.lit("A").alias("ap"))
    right = spark.range(3000).select(F.lit("hot").alias("mac"), (F.col("id") * 2).alias("s_ms"), (F.col("id") * 2 + 50_000_000).alias("e_ms"), F.col("id").cast("string").alias("ip"))
    found = matching.attach_ip(left, right)
    assert found.select("ip").distinct().collect() == [("2999",)] and found.count() == 3000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_profiles_spread_over_tasks(spark):
    # one file of sessions and one account: the pairs are made by all tasks all the same
    sessions = spark.range(40).coalesce(1).select(F.lit("u").alias("account"), "id")
    profiles = spark.range(50).select(F.lit("u").alias("account"), F.col("id").alias("p"))
    joined = lookups.join_profiles(sessions, profiles)
    per_task = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(per_task) == 4 and sum(r["count"] for r in per_task) == 2000
