"""Whole jobs: chains of operators from raw logs to outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import schemas
from ..functions.net import has_socket, undirected_socket
from ..functions.spans import entry_duration, request_end, response_end
from ..functions.url import Suffixes, entry_url, strip_proto
from ..session import settle
from ..operators import cleaning, forest, lookups, matching, sessions, stats


def wifi_sessions(events: DataFrame, buildings: DataFrame | None = None, merge_gap: int = 10_000, shift: int = 300_000) -> DataFrame:
    """Clean controller events (mac, t_ms, code, ap, account, ip, seq) to movement sessions with address and account."""
    if buildings is not None:
        events = cleaning.building_events(events, buildings)
    events = settle(events, "events")
    moves = sessions.association_sessions(cleaning.by_codes(events, cleaning.ASSOCIATION_CODES), merge_gap)
    addresses = sessions.ip_sessions(cleaning.by_codes(events, cleaning.IP_CODES), merge_gap)
    auths = cleaning.by_codes(events, cleaning.AUTH_CODES).select("mac", "t_ms", "account", "ip").distinct()
    placed = settle(matching.attach_ip(moves, addresses, shift), "moves")
    return matching.attach_account(placed, auths)


def http_context(http: DataFrame, movement: DataFrame, rules, classes: DataFrame, names: DataFrame, suffixes: Suffixes | DataFrame, seq: str = "seq",
                 tol: int = 300_000, gap: int = 300_000) -> DataFrame:
    """Request log and movement sessions to context sessions with their services."""
    clean = cleaning.clean_http(http, keep=(seq,)).withColumnRenamed(seq, "seq")
    known = cleaning.classified(lookups.add_service(settle(clean, "clean-http"), "host", rules, classes, names).drop("scat2"))
    placed = settle(matching.locate_requests(known, movement, suffixes, tol), "placed-http")
    return stats.context_session_stats(sessions.context_sessions(placed, gap))


def publish_rows(context: DataFrame, profiles: DataFrame, by: str | None = None) -> DataFrame:
    """Context sessions with the profile of their account, in the published columns; ``by`` as in ``join_profiles``."""
    return cleaning.published_columns(lookups.join_profiles(stats.flat_services(context), profiles, by))


def http_sessions(http: DataFrame, rules, classes: DataFrame, names: DataFrame, suffixes: Suffixes | DataFrame, gap: int = 300_000) -> DataFrame:
    """Request log to sessions per address with their leading service."""
    clean = settle(cleaning.clean_http_strict(http), "clean-http")
    full = lookups.with_domain(lookups.add_service(clean, "host", rules, classes, names), "host", suffixes, "domain")
    return cleaning.sane_sessions(stats.http_session_stats(full, gap))


def record(df: DataFrame, ddl: str, missing: str, quoted_from: int | None = None) -> Column:
    """The whole log record of a row: the line the reader kept, or all fields of the layout in order, ``missing`` for null or absent ones."""
    if "line" in df.columns:
        return F.col("line")
    cells = []
    for i, (name, kind) in enumerate(zip(schemas.names(ddl), schemas.types(ddl))):
        cell = F.col(name) if name in df.columns else F.lit(None)
        text = F.when(cell.isNotNull(), F.format_string("%.6f", cell)) if kind == "DOUBLE" and name in df.columns else cell.cast("string")
        text = F.coalesce(text, F.lit(missing))
        cells.append(F.concat(F.lit('"'), text, F.lit('"')) if quoted_from is not None and i >= quoted_from else text)
    return F.concat_ws(" ", *cells)


def transfers(http: DataFrame, seq: str = "seq") -> DataFrame:
    """Requests as numbered transfers of their sockets with their whole record (``line``), ready for matching with flows."""
    def us(name: str) -> Column:
        return F.floor(F.col(name) * 1_000_000)

    ends = [F.col(c) for c in ("source_ip", "source_port", "dest_ip", "dest_port")]
    rows = cleaning.transfer_rows(http).where(has_socket(*ends)).select(
        F.col(seq).alias("seq"), undirected_socket(*ends).alias("socket"),
        "connection", us("connection_ts").alias("conn_us"), us("request_ts").alias("req_us"),
        F.col("source_ip").alias("src_ip"), F.col("dest_ip").alias("dst_ip"), record(http, schemas.HTTP, "N/A", 17).alias("line"),
    )
    return sessions.http_connections(rows, "socket", "req_us", "connection", "seq")


def flow_keys(tcp: DataFrame, flow_id: str = "flow_id") -> DataFrame:
    """TCP flows with the socket and start time they are matched by and their whole record (``line``)."""
    ends = [F.col(c) for c in ("client_ip", "client_port", "server_ip", "server_port")]
    return tcp.where(has_socket(*ends)).select(
        F.col(flow_id).alias("flow_id"), undirected_socket(*ends).alias("socket"),
        F.floor(F.col("first_abs_time_ms") * 1000).alias("t_us"), F.col("client_ip").alias("src_ip"), F.col("server_ip").alias("dst_ip"),
        record(tcp, schemas.TCP, "-").alias("line"),
    )


def flow_merge(tcp: DataFrame, http: DataFrame, dpi: DataFrame, ip_spans: DataFrame, ap_spans: DataFrame, prefix: str = "111.186") -> DataFrame:
    """Whole records of flows and transfers in blocks, tagged with protocol (flows), device and access point (blocks).

    ``tcp`` has the columns of ``flow_keys``, ``http`` of ``transfers``, ``dpi`` socket, dpi_us, l4, detected, dpi_no. A block's place
    is that of its first usable record, so blocks without flow have one too. Rows are matched by ids and keys and get their
    records last.
    """
    blocks = settle(matching.merge_flows(tcp, http), "blocks")
    first = matching.block_endpoints(blocks.withColumn("t_ms", F.floor(F.col("t_us") / 1000)))
    placed = matching.tag_device(first, ip_spans, ap_spans, prefix).select("block", "device", "place")
    named = matching.tag_protocol(tcp.select("flow_id", "socket", "t_us"), dpi).select("flow_id", "protocol")
    flows = blocks.where(F.col("side") == "tcp").join(named, "flow_id")
    sent = blocks.where(F.col("side") == "http").withColumn("protocol", F.lit(None).cast("string"))
    tagged = matching.with_lines(flows.unionByName(sent), tcp, http).join(placed, "block", "left")
    return tagged.withColumns({c: F.coalesce(c, F.lit(matching.MISSING)) for c in ("device", "place")})


def entries(http: DataFrame, suffixes: Suffixes | DataFrame, seq: str = "seq") -> DataFrame:
    """Requests as entries of the activity model: times in seconds, address and referrer without protocol."""
    begin = F.col("request_ts")
    stop = response_end(F.col("response_ts"), F.col("response_time_end"))
    return lookups.with_domain(http.where(begin.isNotNull()), "request_host", suffixes, "_domain").select(
        F.col(seq).alias("seq"), F.col("source_ip"), F.col("request_user_agent").alias("agent"),
        F.floor(begin * 1_000_000).alias("t"), begin.alias("start"), stop.alias("end"),
        entry_duration(begin, request_end(begin, F.col("request_time")), stop).alias("duration"),
        F.col("_domain").alias("domain"),
        strip_proto(entry_url(F.col("request_host"), F.col("request_url"))).alias("url"),
        strip_proto(F.col("request_referer")).alias("ref"), F.col("response_content_type").alias("ctype"),
    )


def activity(http: DataFrame, suffixes: Suffixes | DataFrame, seq: str = "seq", timeout: int = 60_000_000, cut_gap: float = 3.0,
             extra: list[str] = ["source_ip"]) -> DataFrame:
    """Request log to activity trees per device, user agent (or domain) and session.

    A session is followed row by row with its trees in memory, so the key must be one device: a user agent alone is
    shared by many.
    """
    marked = sessions.ua_sessions(settle(entries(http, suffixes, seq), "entries"), "agent", "domain", "t", timeout, extra)
    return forest.activity_forest(marked, ["has_ua", "activity", *extra, "session_start"], cut_gap)


def evaluate_activity(http: DataFrame, clicks: DataFrame, keys: list[str], suffixes: Suffixes | DataFrame, seq: str = "seq", timeout: int = 60_000_000, cut_gap: float = 8.0,
                      burst: int = 3_000_000, within: int = 2_000_000, extra: list[str] = ["source_ip"]) -> DataFrame:
    """How well activity trees find the requests that belong to clicks: one row with agents, score, agents with a score
    above 0 and their mean score.

    Truth are the bursts of a user agent in which a request follows a click by less than ``within``; ``clicks`` has ``keys``
    (columns of ``entries``) and click (microseconds). Requests are told apart by begin, end and address.
    """
    rows = entries(http, suffixes, seq)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("start", "end", "url")]
    rows = settle(rows.withColumn("entity", F.concat_ws("|", *parts)).withColumn("node", F.concat(F.lit("n"), F.col("seq").cast("string"))), "entries")
    marked = sessions.ua_sessions(rows, "agent", "domain", "t", timeout, extra)
    edges = forest.activity_forest(marked, ["has_ua", "activity", *extra, "session_start"], cut_gap)
    whole = F.concat_ws("#", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("tree", *extra, "session_start")])
    predicted = edges.where(F.col("has_ua") & ~F.col("dummy")).select(F.col("activity").alias("agent"), whole.alias("tree"), "node").join(rows.select("node", "entity"), "node")
    bursts = sessions.truth_trees(rows.where(F.col("agent").isNotNull()), "agent", "t", burst)
    truth = matching.click_match(bursts, clicks, keys, ["agent", "tree"], "t", "click", within)
    scores = stats.evaluate_forest(predicted, truth.withColumn("tree", F.col("tree").cast("string")))
    above = F.col("score") > 0
    return scores.agg(F.count("*").alias("agents"), F.avg("score").alias("score"), F.count_if(above).alias("agents_above_0"), F.avg(F.when(above, F.col("score"))).alias("score_above_0"))
