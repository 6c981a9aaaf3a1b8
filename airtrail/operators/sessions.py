"""Sessions, event pairs and runs inside a key. Times are whole numbers (ms unless said otherwise)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.spans import classify_pair
from ..functions.times import DAY_MS, day_of_ms
from ..session import settle
from .ordered import gap_sessions, mark_gap_sessions, null_safe, with_islands, with_previous, with_running

NO_AP = ""  # stands for an unknown access point while grouping


def _merge_and_cut(raw: DataFrame, order: list[str], place: str, gap: int, chunk: int) -> DataFrame:
    """Join neighbours (in ``order``) at the same place closer than the gap, then end each run where the next starts.

    ``raw`` has mac, s, e, the place and the order columns.
    """
    def opens(prev):
        return ~((F.col(place) == prev[place]) & (F.col("s") - prev["e"] < gap))

    runs = with_islands(settle(raw, "raw-sessions"), ["mac"], order, [place, "s", "e"], opens, chunk, "island")
    at = F.struct(*order)
    whole = runs.groupBy("mac", "island").agg(
        F.min_by("s", at).alias("s"), F.max_by("e", at).alias("e"), F.first(place).alias(place))
    back = whole.withColumn("_back", -F.col("island"))
    nxt = with_previous(back, ["mac"], ["_back"], ["s"], 100_000, "_next")
    return nxt.select("mac", F.col("s").alias("s_ms"), F.least("e", "_next.s").alias("e_ms"), place)


def association_sessions(events: DataFrame, merge_gap: int = 10_000, tie: str = "seq", chunk: int = DAY_MS) -> DataFrame:
    """Wireless sessions (mac, s_ms, e_ms, ap) from association events (mac, t_ms, code, ap and a tie-breaker).

    An authentication or association request opens its access point if that is not open or the device's last
    event was elsewhere; a deauthentication or disassociation of an open one ends a session. A session that
    starts before the previous end cuts it; neighbours on one access point closer than ``merge_gap`` are one.
    """
    ev = events.where(F.col("code").isin(0, 1, 2, 3)).select(
        "mac", "t_ms", F.col(tie).alias("seq"), F.coalesce("ap", F.lit(NO_AP)).alias("ap"),
        F.col("code").isin(0, 2).alias("opens"),
    )
    ev = with_previous(ev, ["mac"], ["t_ms", "seq"], ["ap"], chunk, "prev")
    ev = with_running(ev, ["mac", "ap"], ["t_ms", "seq"], (~F.col("opens")).cast("long"), "epoch", chunk, inclusive=False)
    moved = ~F.col("prev.ap").eqNullSafe(F.col("ap"))
    pairs = ev.groupBy("mac", "ap", "epoch").agg(
        F.min(F.when(F.col("opens"), F.col("t_ms"))).alias("_first"),
        F.max(F.when(F.col("opens") & moved, F.col("t_ms"))).alias("_moved"),
        F.max(F.when(~F.col("opens"), F.struct("t_ms", "seq"))).alias("_end"),
    ).where(F.col("_first").isNotNull() & F.col("_end").isNotNull())
    raw = pairs.select("mac", "ap", F.greatest("_first", "_moved").alias("s"), F.col("_end.t_ms").alias("e"), F.col("_end.seq").alias("seq"))
    done = _merge_and_cut(raw, ["e", "seq"], "ap", merge_gap, chunk)
    return done.withColumn("ap", F.nullif("ap", F.lit(NO_AP)))


def ip_sessions(events: DataFrame, merge_gap: int = 10_000, tie: str = "seq", chunk: int = DAY_MS) -> DataFrame:
    """Address sessions (mac, s_ms, e_ms, ip): first allocation to recycle, or to the last allocation when it never is.

    A recycle without allocation is left out. Overlaps are cut, neighbours with the same address merged.
    """
    ev = events.where(F.col("code").isin(5, 6) & F.col("ip").isNotNull()).select(
        "mac", "ip", "t_ms", F.col(tie).alias("seq"), (F.col("code") == 6).alias("ends"))
    ev = with_running(ev, ["mac", "ip"], ["t_ms", "seq"], F.col("ends").cast("long"), "epoch", chunk, inclusive=False)
    raw = ev.groupBy("mac", "ip", "epoch").agg(
        F.min(F.when(~F.col("ends"), F.col("t_ms"))).alias("s"),
        F.coalesce(F.max(F.when(F.col("ends"), F.col("t_ms"))), F.max("t_ms")).alias("e"),
    ).where(F.col("s").isNotNull())
    return _merge_and_cut(raw, ["s", "e", "ip"], "ip", merge_gap, chunk)


def context_sessions(df: DataFrame, gap: int = 300_000, tie: str = "seq", chunk: int = 3_600_000) -> DataFrame:
    """Add ``sid``: per account and day a session ends after a silence over ``gap`` or when the location changes.

    Rows without account belong to their address (``ip``, where the rows have one), not to one common session.
    """
    other = F.coalesce(F.col("ip"), F.lit("")) if "ip" in df.columns else F.lit("")
    rows = df.withColumns({
        "_acc": F.coalesce(F.col("account"), other), "_anon": F.col("account").isNull(),
        "_day": day_of_ms(F.col("stime")), "_loc": F.coalesce("location", F.lit("")),
    })
    numbered = with_islands(
        rows, ["_acc", "_anon", "_day"], ["stime", tie], ["stime", "_loc"],
        lambda prev: (F.col("stime") - prev["stime"] > gap) | (F.col("_loc") != prev["_loc"]), chunk, "_n")
    sid = F.sha2(F.concat_ws("|", F.col("_acc"), F.col("_anon").cast("string"), F.col("_day").cast("string"), F.col("_n").cast("string")), 256)
    return numbered.select(*df.columns, sid.alias("sid"))


def sessionize(df: DataFrame, keys: list[str], ts: str, gap: int = 300_000) -> DataFrame:
    """Add ``session_start``: a silence over ``gap`` starts a new session of the key."""
    return mark_gap_sessions(df, keys, ts, gap)


def ua_sessions(http: DataFrame, agent: str, domain: str, ts: str, timeout: int = 60_000, extra: list[str] = []) -> DataFrame:
    """Add ``activity`` (the user agent, or the domain of requests without one), ``has_ua`` and ``session_start``.

    ``extra`` names further key columns, e.g. the source address, where one user agent has many users.
    """
    rows = http.withColumns({"activity": F.coalesce(agent, domain), "has_ua": F.col(agent).isNotNull()})
    return mark_gap_sessions(rows, ["has_ua", "activity", *extra], ts, timeout)


def http_connections(http: DataFrame, socket: str, ts: str, kind: str, tie: str, chunk: int = 300_000_000) -> DataFrame:
    """Add ``conn_no`` per socket: ``start``/``unique`` opens a connection, a row after ``last``/``unique`` opens one too."""
    return with_islands(
        http, [socket], [ts, tie], [kind],
        lambda prev: F.col(kind).isin("start", "unique") | prev[kind].isin("last", "unique"), chunk, "conn_no")


def flow_blocks(lines: DataFrame) -> DataFrame:
    """Number the blocks of ordered lines (file, split, pos, value): a ``TCP`` line starts one, ``HTTP`` lines follow."""
    opens = F.col("value").startswith("TCP").cast("long")
    return with_running(lines, ["file"], ["split", "pos"], opens, "block", 1)


def screen_clicks(events: DataFrame, t: str, trace: list[str] = [], gap: int = 1000) -> DataFrame:
    """Clicks: events closer than the gap are one, at the first time."""
    keyed = events.withColumn("_trace", F.lit(0)) if not trace else events
    clicks = gap_sessions(keyed, trace or ["_trace"], t, gap, {"events": (F.lit(1), "count")}, strict=True)
    return clicks.select(*trace, F.col("session_start").alias("click"), "events")


def truth_trees(http: DataFrame, agent: str, ts: str, gap: int = 3000) -> DataFrame:
    """Add ``tree``: start of the burst of a user agent's requests a request belongs to."""
    return mark_gap_sessions(http, [agent], ts, gap).withColumnRenamed("session_start", "tree")


def packet_bursts(packets: DataFrame, trace: str, t: str, tie: str, gap: int = 500_000, chunk: int = 60_000_000) -> DataFrame:
    """Add ``burst``: 1 when the trace's previous TCP packet is closer than the gap. Other packets are left out."""
    tcp = packets.where(F.col("is_tcp"))
    seen = with_previous(tcp, [trace], [t, tie], [t], chunk, "_prev")
    near = F.coalesce(F.col(t) - F.col(f"_prev.{t}") < gap, F.lit(False))
    return seen.withColumn("burst", near.cast("int")).drop("_prev")


def classify_against_previous(http: DataFrame, keys: list[str], order: list[str], chunk: int = 3_600_000_000) -> DataFrame:
    """Add ``pair_class`` of each request against the one before it in its session (null on the first).

    ``http`` has start, end, duration (seconds) and domain; ``chunk`` is in the unit of the first order column (microseconds).
    """
    names = ["start", "end", "duration", "domain"]
    seen = with_previous(http, keys, order, names, chunk, "_prev")
    found = classify_pair(F.col("_prev"), F.struct(*names))
    return seen.withColumn("pair_class", F.when(F.col("_prev").isNotNull(), found)).drop("_prev")


def location_intervals(log: DataFrame, tie: str = "seq", chunk: int = DAY_MS, limit: int = DAY_MS) -> DataFrame:
    """Address spans (ip, mac, atime, rtime) from allocation and recycle rows.

    Allocations of an unrecycled span extend it. A recycle within ``limit`` of the span's start closes it, and the
    next allocation opens a new one. A span whose first recycle comes later than that is never closed again.
    """
    return location_state(log, tie, chunk, limit).select("ip", "mac", "atime", "rtime")


def location_state(log: DataFrame, tie: str = "seq", chunk: int = DAY_MS, limit: int = DAY_MS) -> DataFrame:
    """Address spans as a table that later days extend: ip, mac, atime, rtime, and last (the address's newest span of the device), allocated (its
    latest allocation), recycled (its first recycle), closed (its latest recycle in time)."""
    rows = log.where(F.col("kind").isin("alloc", "recycle")).select(
        "ip", "mac", "t_ms", F.col(tie).alias("seq"), (F.col("kind") == "alloc").alias("gives"))
    runs = with_islands(rows, ["ip", "mac"], ["t_ms", "seq"], ["gives"],
                        lambda prev: F.col("gives") & ~prev["gives"], chunk, "n")
    runs = settle(runs, "address-runs")
    begun = runs.groupBy("ip", "mac", "n").agg(
        F.min(F.when(F.col("gives"), F.col("t_ms"))).alias("a0"), F.max(F.when(F.col("gives"), F.col("t_ms"))).alias("a1"),
        F.min(F.when(~F.col("gives"), F.col("t_ms"))).alias("r0"),
    )
    # recycles before any allocation form run 1 without a0
    begun = begun.where(F.col("a0").isNotNull()).withColumn("late", F.col("r0") - F.col("a0") > limit)
    first_late = begun.where("late").groupBy("ip", "mac").agg(F.min("n").alias("n_late"))
    spans = begun.join(first_late, ["ip", "mac"], "left").withColumn("n", F.least("n", "n_late"))
    in_time = runs.where(~F.col("gives")).select("ip", "mac", F.col("n").alias("_n"), "t_ms")
    good = (
        begun.select("ip", "mac", F.col("n").alias("_n"), "a0").join(in_time, ["ip", "mac", "_n"])
        .where(F.col("t_ms") - F.col("a0") <= limit).groupBy("ip", "mac", F.col("_n").alias("n")).agg(F.max("t_ms").alias("closed"))
    )
    newest = begun.groupBy("ip", "mac").agg(F.max("n").alias("_newest"))
    joined = spans.groupBy("ip", "mac", "n", "n_late").agg(
        F.min("a0").alias("atime"), F.max("a1").alias("_a1"), F.max("r0").alias("_r0"), F.bool_or(F.coalesce("late", F.lit(False))).alias("_open"))
    return joined.join(good, ["ip", "mac", "n"], "left").join(newest, ["ip", "mac"]).select(
        "ip", "mac", "atime",
        F.when(F.col("_open"), F.col("_a1")).otherwise(F.coalesce("closed", "_a1")).alias("rtime"),
        (F.col("n") == F.least("_newest", "n_late")).alias("last"), F.col("_a1").alias("allocated"),
        F.when(F.col("_open"), F.greatest("_r0", "_a1")).otherwise(F.col("_r0")).alias("recycled"), F.when(~F.col("_open"), F.col("closed")).alias("closed"))


def extend_locations(state: DataFrame, log: DataFrame, tie: str = "seq", chunk: int = DAY_MS, limit: int = DAY_MS) -> DataFrame:
    """``location_state`` of all days from that of the days before and the rows of a new one, which are later than all of them.

    Only the newest span of an address and device can still change. Its four known times stand in for its rows and meet the new
    ones; all other spans, and those of addresses without new rows, stay as they are.
    """
    keys = log.where(F.col("kind").isin("alloc", "recycle")).select("ip", "mac").distinct().withColumn("_new", F.lit(True))
    marked = null_safe(state, keys, ["ip", "mac"])
    moving = F.col("last") & F.col("_new").isNotNull()
    times = F.array(*[F.struct(F.col(c).alias("t_ms"), F.lit(kind).alias("kind"), F.lit(i - 4).alias("seq"))
                      for i, (c, kind) in enumerate((("atime", "alloc"), ("allocated", "alloc"), ("recycled", "recycle"), ("closed", "recycle")))])
    held = marked.where(moving).select("ip", "mac", F.explode(times).alias("_t")).select("ip", "mac", "_t.*").where(F.col("t_ms").isNotNull())
    rows = log.select("ip", "mac", "t_ms", "kind", F.col(tie).alias("seq"))
    after = location_state(held.select("ip", "mac", "t_ms", "kind", F.col("seq").cast(rows.schema["seq"].dataType).alias("seq")).unionByName(rows), "seq", chunk, limit)
    return marked.where(~moving).drop("_new").unionByName(after)
