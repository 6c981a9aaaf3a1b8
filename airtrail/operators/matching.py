"""Joins by key and time between sessions, requests, flows and locations."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.net import local_side_ip
from ..functions.times import DAY_MS, day_of_ms
from ..functions.url import Suffixes
from ..session import settle
from .lookups import with_domain
from .nearest import first_cover, first_within, last_around, last_cover, unbeaten
from .ordered import null_safe, with_running

MISSING = "N/A"
HOUR_MS = 3_600_000
CELLS = [900_000 * 4**k for k in range(12)]  # widths of the grids of cover_all, 15 min to 119 years in ms


def attach_ip(sessions: DataFrame, addresses: DataFrame, shift: int = 300_000, cell: int = HOUR_MS) -> DataFrame:
    """Add the address of wireless sessions (mac, s_ms, e_ms, ...) from address sessions of the same device and UTC day
    of start: the latest-started one that overlaps; else, with the address sessions widened by ``shift`` on both
    sides, the earliest-started one that does; else null. An address session that ends before it begins overlaps nothing; a
    session that does (cut by an earlier one) overlaps what covers both its times.

    No pair is built. The latest-started one begins inside the session, then it is the last one begun by the session's end; or it covers
    the session's start (``last_cover``). The earliest-started one in reach is the earliest of all that end late enough, if
    that begins early enough: later ones begin later still. Both are running folds over chunks of ``cell``, so a busy device-day is
    spread out. Equal sessions are counted, looked up once and repeated.
    """
    cols = [c for c in sessions.columns if c != "ip"]
    # both sides are read by every lookup below
    left = settle(sessions.groupBy(*cols).agg(F.count("*").alias("_n")).withColumn("_day", day_of_ms(F.col("s_ms"))), "counted-sessions")
    held = settle(addresses.where((F.col("e_ms") >= F.col("s_ms")) & F.col("mac").isNotNull()).select(
        "mac", day_of_ms(F.col("s_ms")).alias("_day"), F.col("s_ms").alias("_s"), F.col("e_ms").alias("_e"), F.col("ip").alias("_ip")), "held-addresses")
    keys, sound = ["mac", "_day"], F.col("mac").isNotNull() & F.col("e_ms").isNotNull() & F.col("s_ms").isNotNull()

    def folded(rows: DataFrame, at: Column, ends: Column, how: str, into: str) -> DataFrame:
        """Rows with the fold of the address sessions that stand at or before them."""
        asked = rows.select(*keys, at.alias("_x"), F.lit(1).alias("_kind"), F.struct(*rows.columns).alias("_p"))
        known = held.select(*keys, ends.alias("_x"), F.lit(0).alias("_kind"), F.struct("_s", "_e", "_ip").alias("_a"))
        ran = with_running(asked.unionByName(known, allowMissingColumns=True), keys, ["_x", "_kind"], F.col("_a"), into, cell, how)
        return ran.where(F.col("_kind") == 1).select("_p.*", into)

    begun = folded(left.where(sound), F.col("e_ms"), F.col("_s"), "max", "_last")
    found = settle(folded(begun, shift - F.col("s_ms"), -F.col("_e"), "min", "_early"), "address-folds")
    inner, near = F.col("_last._s") >= F.col("s_ms"), F.col("_early._s") - shift <= F.col("e_ms")
    direct = found.where(inner).select(*cols, "_n", F.col("_last._ip").alias("ip"))
    # a session without any address session in reach has none that overlaps either
    reach = found.where(~F.coalesce(inner, F.lit(False)) & near)
    order, turned = ["_e", "_ip"], F.col("e_ms") < F.col("s_ms")
    covered = last_cover(reach.where(~turned), held, keys, "s_ms", "_s", "_e", order, until=(F.col("_day") + 1) * DAY_MS)
    asked = reach.where(turned)
    around = last_around(asked, held.join(asked.select(*keys).distinct(), keys, "left_semi"), keys, "e_ms", "s_ms", "_s", "_e", order, F.col("_day") * DAY_MS, chunk=cell)
    rest = covered.unionByName(around).select(*cols, "_n", F.when(F.col("hit").isNotNull(), F.col("hit._ip")).otherwise(F.col("_early._ip")).alias("ip"))
    none = F.lit(None).cast(addresses.schema["ip"].dataType).alias("ip")
    without = found.where(~F.coalesce(inner, F.lit(False)) & ~F.coalesce(near, F.lit(False))).select(*cols, "_n", none)
    broken = left.where(~F.coalesce(sound, F.lit(False))).select(*cols, "_n", none)
    whole = direct.unionByName(rest).unionByName(without).unionByName(broken)
    return whole.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_i", "_n")


def attach_account(sessions: DataFrame, auths: DataFrame) -> DataFrame:
    """Add accounts of sessions (mac, s_ms, ip, ...) from authentications (mac, t_ms, account, ip) of the same device
    and UTC day. An authentication with a valid address goes to sessions with that address only. A session with
    authentications on its day but none that fits is left out; one without any keeps a null account. Distinct rows.
    """
    ip = F.when(F.col("ip").isNotNull() & (F.col("ip") != "0.0.0.0"), F.col("ip"))
    known = auths.select("mac", day_of_ms(F.col("t_ms")).alias("_day"), F.col("account"), ip.alias("_ip")).distinct()
    rows = sessions.drop("account").withColumn("_day", day_of_ms(F.col("s_ms")))
    cols = [c for c in rows.columns if c != "_day"]
    sure = known.where(F.col("_ip").isNotNull()).withColumnRenamed("_ip", "ip")
    fits = rows.join(sure, ["mac", "_day", "ip"]).select(*cols, "account")
    any_ip = rows.join(known.where(F.col("_ip").isNull()), ["mac", "_day"]).select(*cols, "account")
    alone = rows.join(known.select("mac", "_day"), ["mac", "_day"], "left_anti").select(*cols, F.lit(None).cast("string").alias("account"))
    return fits.unionByName(any_ip).unionByName(alone).distinct()


def locate_requests(http: DataFrame, sessions: DataFrame, suffixes: Suffixes | DataFrame, tol: int = 300_000, span_days: bool = False,
                    chunk: int = HOUR_MS) -> DataFrame:
    """Requests (ip, stime, host, ...) with location and account of the session of the same address and UTC day of start
    that contains the start: the earliest-started one, exactly or else within ``tol``. Unmatched requests are left
    out. The host becomes its registered domain. ``span_days`` lets a session count on every day it touches on which
    there are requests.
    """
    day = day_of_ms(F.col("s_ms"))
    days = day
    if span_days:
        asked = http.agg(F.struct(F.min("stime").alias("lo"), F.max("stime").alias("hi"))).scalar()
        sessions = sessions.withColumn("_asked", asked)
        first = F.greatest(day, day_of_ms(F.col("_asked.lo")))
        last = F.least(F.greatest(day, day_of_ms(F.col("e_ms"))), day_of_ms(F.col("_asked.hi")))
        days = F.explode(F.when(first <= last, F.sequence(first, last)))
    spans = sessions.select("ip", "s_ms", "e_ms", "mac", F.col("ap").alias("location"), "account", days.alias("_day"))
    rows = http.withColumn("_day", day_of_ms(F.col("stime")))
    hit = first_cover(rows, spans, ["ip", "_day"], "stime", "s_ms", "e_ms", ["e_ms", "mac", "location"], ["location", "account"], tol, chunk,
                      bounds=(F.col("_day") * DAY_MS, (F.col("_day") + 1) * DAY_MS - 1))
    cols = [F.col(c) if c != "host" else F.col("_domain").alias("host") for c in http.columns]
    return with_domain(hit.where(F.col("hit").isNotNull()), "host", suffixes, "_domain").select(*cols, "hit.location", "hit.account")


def match_flows(flows: DataFrame, connections: DataFrame, tol: int = 180_000_000) -> DataFrame:
    """Flows (socket, t_us, ...) with the connection they carry: same undirected socket and less than ``tol`` apart.

    A flow goes to one connection: closed ones first, then by first request time. ``conn_no`` is null without one.
    """
    ranked = connections.withColumn("_late", (~F.col("closed")).cast("int"))
    hit = first_within(flows, ranked, ["socket"], "t_us", "align_us", ["_late", "first_us", "conn_no"], [], tol - 1, tol - 1)
    return hit.withColumn("conn_no", F.col("hit.conn_no")).drop("hit")


def connection_table(transfers: DataFrame) -> DataFrame:
    """One row per connection from numbered transfers (socket, conn_no, seq, connection, conn_us, req_us)."""
    at = F.struct("req_us", "seq")
    opens = F.col("connection").isin("start", "unique") & F.col("conn_us").isNotNull() & (F.col("conn_us") != 0)
    return transfers.groupBy("socket", "conn_no").agg(
        F.min_by(F.when(opens, F.col("conn_us")).otherwise(F.col("req_us")), at).alias("align_us"),
        F.min("req_us").alias("first_us"), F.bool_or(F.col("connection").isin("last", "unique")).alias("closed"),
        F.count("*").alias("transfers"),
    )


def merge_flows(tcp: DataFrame, transfers: DataFrame, tol: int = 180_000_000) -> DataFrame:
    """Full outer match of TCP flows and request transfers, as rows of blocks.

    ``tcp`` has flow_id, socket, t_us; ``transfers`` the columns of ``connection_table``; both may have src_ip and dst_ip. Result:
    block, side (``tcp``/``http``), pos, matched, socket, flow_id, seq, t_us, src_ip, dst_ip. A matched block holds the flows and
    the transfers of one connection; rows without partner keep a block of their own side, so no pair is ever built. Only ids and
    keys are shuffled; ``with_lines`` adds the records.
    """
    def ends(df: DataFrame) -> list[Column]:
        return [(F.col(c) if c in df.columns else F.lit(None).cast("string")).alias(c) for c in ("src_ip", "dst_ip")]

    transfers = settle(transfers.select("socket", "conn_no", "seq", "connection", "conn_us", "req_us", *ends(transfers)), "transfers")
    conns = connection_table(transfers)
    hits = settle(match_flows(tcp.select("flow_id", "socket", "t_us", *ends(tcp)), conns, tol), "matched-flows")
    name = F.concat_ws("#", F.col("socket"), F.col("conn_no").cast("string"))
    flows = hits.select(
        F.when(F.col("conn_no").isNotNull(), name).otherwise(F.concat(F.lit("flow#"), F.col("flow_id").cast("string"))).alias("block"),
        F.lit("tcp").alias("side"), F.col("flow_id").cast("long").alias("pos"), F.col("conn_no").isNotNull().alias("matched"),
        "socket", "flow_id", F.lit(None).cast("long").alias("seq"), "t_us", "src_ip", "dst_ip")
    taken = hits.where(F.col("conn_no").isNotNull()).select("socket", "conn_no").distinct().withColumn("_m", F.lit(True))
    wanted = transfers.join(taken, ["socket", "conn_no"], "left")
    sent = wanted.select(
        name.alias("block"), F.lit("http").alias("side"), F.col("seq").cast("long").alias("pos"),
        F.coalesce("_m", F.lit(False)).alias("matched"), "socket", F.lit(None).cast("long").alias("flow_id"),
        F.col("seq").cast("long").alias("seq"), F.coalesce("conn_us", "req_us").alias("t_us"), "src_ip", "dst_ip")
    return flows.unionByName(sent)


def with_lines(blocks: DataFrame, tcp: DataFrame, transfers: DataFrame) -> DataFrame:
    """Add to rows of blocks the whole record (``line``) of their flow or transfer, each side joined by its own id."""
    flows = blocks.where(F.col("side") == "tcp").join(tcp.select("flow_id", "line"), "flow_id")
    sent = blocks.where(F.col("side") == "http").join(transfers.select("seq", "line"), "seq")
    return flows.unionByName(sent).select(*blocks.columns, "line")


def unmatched_transfers(merged: DataFrame) -> DataFrame:
    """How many transfers found no flow, out of all."""
    sent = F.col("side") == "http"
    return merged.agg(F.count_if(sent & ~F.col("matched")).alias("unmatched"), F.count_if(sent).alias("total"))


def pair_by_period(left: DataFrame, right: DataFrame, left_time: str, right_time: str, unit: str = "hour") -> DataFrame:
    """Files of two logs side by side by hour or day, outer."""
    a = left.withColumn("period", F.date_trunc(unit, left_time))
    b = right.withColumn("period", F.date_trunc(unit, right_time))
    return a.join(b, "period", "full")


def tag_protocol(flows: DataFrame, dpi: DataFrame, tol: int = 60_000_000, order: str = "dpi_no") -> DataFrame:
    """Add the protocol of the first TCP protocol row (by ``order``) of the same socket less than ``tol`` away, or N/A."""
    rows = dpi.where(F.col("l4") == "TCP")
    hit = first_within(flows, rows, ["socket"], "t_us", "dpi_us", [order], ["detected"], tol - 1, tol - 1)
    return hit.withColumn("protocol", F.coalesce("hit.detected", F.lit(MISSING))).drop("hit")


def cover_all(points: DataFrame, spans: DataFrame, keys: list[str], t: str, lo: str, hi: str, tol: int = 0) -> DataFrame:
    """Every span of equal keys that covers a point within ``tol``.

    A span lies on the grid whose cells fit its length (five cells at most); a point looks into one cell of each grid that
    holds spans, so neither long spans nor busy keys multiply, and only true matches are joined. Both sides are dealt by cell over all tasks:
    there can be far more matches than rows, so neither files nor the sides' sizes decide how many tasks make them.
    """
    wide = spans.withColumns({"_lo": F.col(lo) - tol, "_hi": F.col(hi) + tol}).where(F.col("_hi") >= F.col("_lo"))
    level = F.lit(len(CELLS) - 1)
    for i in reversed(range(len(CELLS) - 1)):
        level = F.when(F.col("_hi") - F.col("_lo") <= CELLS[i] * 4, F.lit(i)).otherwise(level)
    size = F.element_at(F.array(*[F.lit(c) for c in CELLS]), F.col("_level") + 1)
    grid = wide.withColumn("_level", level).withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size))))
    used = wide.agg(F.collect_set(level)).scalar()  # twelve numbers at most
    cells = F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col(t) / c).alias("cell")) for i, c in enumerate(CELLS)])
    looks = points.where(F.col(t).isNotNull()).withColumn("_used", used).select(
        "*", F.explode(F.filter(cells, lambda g: F.array_contains(F.col("_used"), g["level"]))).alias("_g")
    ).select("*", F.col("_g.level").alias("_level"), F.col("_g.cell").alias("_cell")).drop("_g", "_used")
    at, parts = [*keys, "_level", "_cell"], int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = looks.repartition(parts, *at).join(grid.repartition(parts, *at), at).where((F.col(t) >= F.col("_lo")) & (F.col(t) <= F.col("_hi")))
    return met.drop("_level", "_cell", "_lo", "_hi")


def mac_by_ip(points: DataFrame, ip_spans: DataFrame, ip: str = "ip", t: str = "t_ms", tol: int = 120_000) -> DataFrame:
    """Every device that held the address at the time."""
    spans = ip_spans.select(F.col("ip").alias(ip), "mac", "atime", "rtime")
    return cover_all(points, spans, [ip], t, "atime", "rtime", tol)


def ip_by_mac(points: DataFrame, ip_spans: DataFrame, mac: str = "mac", t: str = "t_ms", tol: int = 120_000) -> DataFrame:
    """The first address the device held at the time, or null."""
    spans = ip_spans.select(F.col("mac").alias(mac), "atime", "rtime", F.col("ip").alias("_ip"))
    hit = first_cover(points, spans, [mac], t, "atime", "rtime", ["rtime", "_ip"], ["_ip"], tol, exact_first=False)
    return hit.select(*points.columns, F.col("hit._ip").alias("found_ip"))


def ap_by_mac(points: DataFrame, ap_spans: DataFrame, mac: str = "mac", t: str = "t_ms", tol: int = 120_000) -> DataFrame:
    """The first access point the device was on at the time, or null."""
    spans = ap_spans.select(F.col("mac").alias(mac), "start", "end", F.col("ap").alias("_ap"))
    hit = first_cover(points, spans, [mac], t, "start", "end", ["end", "_ap"], ["_ap"], tol, exact_first=False)
    return hit.select(*points.columns, F.col("hit._ap").alias("found_ap"))


def ap_by_ip(points: DataFrame, ip_spans: DataFrame, ap_spans: DataFrame, ip: str = "ip", t: str = "t_ms", tol: int = 120_000,
             cell: int = 4 * HOUR_MS) -> DataFrame:
    """Add device and access point of an address: the first device (by allocation) that was on one; else the last
    device and no access point; else nulls. Distinct (address, time) pairs are looked up once.

    No pair of a point and a device is built. Spans of addresses are cut at cells of time and once more at the pieces of the device's
    access points; one pass in time order over (address, cell) holds the spans that can still win and answers each point.
    """
    asked = points.select(F.col(ip).alias("_ip"), F.col(t).alias("_x")).where(F.col("_ip").isNotNull() & F.col("_x").isNotNull()).distinct()
    ends = asked.agg(F.struct(F.min("_x").alias("lo"), F.max("_x").alias("hi"))).scalar()

    def celled(spans: DataFrame, lo: Column, hi: Column, *cols: Column) -> DataFrame:
        """Spans once in each cell they touch between the first and the last point, cut at its edges."""
        cut = spans.withColumn("_ends", ends).select(*cols, F.greatest(lo, "_ends.lo").alias("_x"), F.least(hi, "_ends.hi").alias("_to"), "_ends")
        cells = F.explode(F.sequence(F.floor(F.col("_x") / cell), F.floor(F.col("_to") / cell))).alias("_cell")
        whole = cut.where("_ends IS NOT NULL AND _ends.lo IS NOT NULL AND _x <= _to").drop("_ends").select("*", cells)
        return whole.withColumns({"_x": F.greatest("_x", F.col("_cell") * cell), "_to": F.least("_to", (F.col("_cell") + 1) * cell - 1)})

    sound = ip_spans.where(F.col("ip").isNotNull() & (F.col("rtime") + tol >= F.col("atime") - tol))
    held = celled(sound, F.col("atime") - tol, F.col("rtime") + tol, F.col("ip").alias("_ip"), F.col("mac").alias("_m"), F.col("atime"), F.col("rtime"))
    on = unbeaten(ap_spans, ["mac"], "start", "end", ["end", "ap"], ["ap"], HOUR_MS).where(F.col("_pay.ap").isNotNull())
    on = celled(on, F.greatest(F.col("_lo") - tol, F.col("_before") + (tol + 1)), F.col("_hi") + tol, F.col("mac").alias("_m"), F.col("_pay.ap").alias("_ap"))
    seen = held.join(on.withColumnsRenamed({"_x": "_x2", "_to": "_to2"}), ["_m", "_cell"])
    seen = seen.withColumns({"_x": F.greatest("_x", "_x2"), "_to": F.least("_to", "_to2")}).drop("_x2", "_to2").where("_x <= _to")
    asked = asked.withColumn("_cell", F.floor(F.col("_x") / cell))
    rows = held.withColumn("_kind", F.lit(HELD)).unionByName(seen.withColumn("_kind", F.lit(SEEN)), allowMissingColumns=True).unionByName(
        asked.withColumn("_kind", F.lit(ASKED)), allowMissingColumns=True)
    order = ["_ip", "_cell", "_x", "_kind", "atime", "rtime", "_m"]
    placed = rows.select(*order, "_to", "_ap").fillna(0, ["atime", "rtime", "_to"]).repartition("_ip", "_cell").sortWithinPartitions(*order)
    found = placed.mapInArrow(holders, "_ip string, _x long, found_mac string, found_ap string").withColumnsRenamed({"_ip": ip, "_x": t})
    return points.join(found, [ip, t], "left").select(*points.columns, "found_mac", "found_ap")


HELD, SEEN, ASKED = 0, 1, 2  # rows of ``holders``


def holders(batches: Iterator) -> Iterator:
    """Answers of the points (``ASKED``) among spans (``HELD``) and their parts on an access point (``SEEN``), sorted by address, cell and time.

    Spans come in the order of their allocation, so one that ends before a later one does can be the last device no more. A part waits
    in a heap by allocation unless the first one there lasts as long.
    """
    import pyarrow as pa

    def listed(column: pa.Array) -> list:
        return column.to_numpy().tolist() if pa.types.is_integer(column.type) else column.to_pylist()

    group, last, first = None, [], []
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for ip, cell, x, kind, begun, ended, mac, until, ap in zip(*[listed(c) for c in batch.columns]):
            if group != (ip, cell):
                group, last, first = (ip, cell), [], []
            if kind == HELD:
                while last and last[-1][0] <= until:
                    last.pop()
                last.append((until, mac))
            elif kind == SEEN:
                if not (first and first[0][3] >= until and first[0][:3] <= (begun, ended, mac)):
                    heappush(first, (begun, ended, mac, until, ap))
            else:
                while first and first[0][3] < x:
                    heappop(first)
                while last and last[-1][0] < x:
                    last.pop()
                if first or last:
                    for column, value in zip(out, (ip, x, first[0][2], first[0][4]) if first else (ip, x, last[-1][1], None)):
                        column.append(value)
        if out[0]:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["_ip", "_x", "found_mac", "found_ap"])


def tag_device(flows: DataFrame, ip_spans: DataFrame, ap_spans: DataFrame, prefix: str = "111.186", tol: int = 120_000) -> DataFrame:
    """Add device and access point of the local side of a flow (src_ip, dst_ip, t_ms, ...), N/A where unknown."""
    asked = flows.withColumn("_ip", local_side_ip(F.col("src_ip"), F.col("dst_ip"), prefix))
    found = ap_by_ip(asked, ip_spans, ap_spans, "_ip", "t_ms", tol)
    return found.select(*flows.columns, F.coalesce("found_mac", F.lit(MISSING)).alias("device"),
                        F.coalesce("found_ap", F.lit(MISSING)).alias("place"))


def block_endpoints(blocks: DataFrame) -> DataFrame:
    """Per block of merged flows the ends and time of its first usable record, flows before transfers."""
    usable = F.col("src_ip").isNotNull() & F.col("t_ms").isNotNull()
    rank = F.struct(F.when(F.col("side") == "tcp", 0).otherwise(1), F.col("pos"))
    return blocks.where(usable).groupBy("block").agg(F.min_by(F.struct("src_ip", "dst_ip", "t_ms"), rank).alias("_r")).select("block", "_r.*")


def click_match(requests: DataFrame, clicks: DataFrame, keys: list[str], tree: list[str], t: str, click: str, within: int = 2000) -> DataFrame:
    """Requests of the trees in which some request follows a click by less than ``within``."""
    hit = first_within(requests, clicks, keys, t, click, [click], [], within - 1, 0)
    live = hit.where(F.col("hit").isNotNull()).select(*tree).distinct()
    return null_safe(requests, live, tree, "left_semi")
