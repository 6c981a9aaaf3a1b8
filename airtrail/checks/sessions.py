"""Checked queries: sessions, event pairs, and joins by key and time."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import undirected_socket
from ..operators import cleaning, matching, sessions
from ..plans import jobs
from ..session import settle
from .columns import CLEAN, SOCKET
from .tables import SUFFIXES, check

GAP = 6 * 3_600_000  # the given events are hours apart
HOUR = 3_600_000

# the plain window form of a gap session, in DuckDB
def gap_sql(source: str, keys: str, ts: str, gap: int, test: str = ">") -> str:
    return f"""SELECT *, max(CASE WHEN fresh THEN {ts} END) OVER (PARTITION BY {keys} ORDER BY {ts}) AS session_start FROM (SELECT *,
        coalesce({ts} - lag({ts}) OVER (PARTITION BY {keys} ORDER BY {ts}) {test} {gap}, true) AS fresh FROM ({source}) s) f"""


@check("w_sessionize", "SELECT seq, ip, stime, session_start FROM (" + gap_sql(CLEAN, "ip", "stime", GAP) + ") x")
def _(t):
    rows = cleaning.clean_http(t["http"], keep=("seq",))
    return sessions.sessionize(rows, ["ip"], "stime", GAP).select("seq", "ip", "stime", "session_start")


ENTRY = r"""SELECT seq, source_ip, request_user_agent AS agent, CAST(floor(request_ts * 1e6) AS BIGINT) AS t, request_ts AS b, response_ts + response_time_end AS e,
    coalesce(nullif(response_ts + response_time_end, 0), request_ts + request_time) - request_ts AS dur,
    regexp_extract(request_host, '([a-z0-9-]+\.(com|net|org))$', 1) AS dom FROM {http} WHERE request_ts IS NOT NULL"""


@check("w_ua_sessions", "SELECT seq, activity, has_ua, session_start FROM (" + gap_sql(
    f"SELECT *, agent IS NOT NULL AS has_ua, coalesce(agent, dom) AS activity FROM ({ENTRY}) e", "has_ua, activity", "t", 900_000_000) + ") x")
def _(t):
    return sessions.ua_sessions(jobs.entries(t["http"], SUFFIXES), "agent", "domain", "t", 900_000_000).select("seq", "activity", "has_ua", "session_start")


@check("w_truth_trees", "SELECT seq, agent, session_start AS tree FROM (" + gap_sql(ENTRY, "agent", "t", 300_000_000) + ") x")
def _(t):
    return sessions.truth_trees(jobs.entries(t["http"], SUFFIXES), "agent", "t", 300_000_000).select("seq", "agent", "tree")


@check("w_screen_clicks", "SELECT kind AS trace, session_start AS click, count(*) AS events FROM (" + gap_sql(
    "SELECT event_type AS kind, t_ms FROM {ev} WHERE event_type <> 'error'", "kind", "t_ms", 600_000, ">=") + ") x GROUP BY 1, 2")
def _(t):
    return sessions.screen_clicks(t["ev"].where("event_type <> 'error'").withColumnRenamed("event_type", "trace"), "t_ms", ["trace"], 600_000)


@check("w_packet_bursts", """SELECT event_id, CAST(coalesce(t_us - lag(t_us) OVER (PARTITION BY user_id % 5 ORDER BY t_us, event_id) < 600000000, false) AS INT) AS burst
    FROM {ev} WHERE event_type <> 'error'""")
def _(t):
    rows = t["ev"].select("event_id", (F.col("user_id") % 5).alias("trace"), "t_us", (F.col("event_type") != "error").alias("is_tcp"))
    return sessions.packet_bursts(rows, "trace", "t_us", "event_id", 600_000_000, 3_600_000_000).select("event_id", "burst")


_WIFI_RAW = """e AS (SELECT *, coalesce(ap, '') AS a, code IN (0, 2) AS opens FROM {wifi} WHERE code < 4),
    p AS (SELECT *, lag(a) OVER (PARTITION BY mac ORDER BY t_ms, seq) AS pa, coalesce(sum(CASE WHEN opens THEN 0 ELSE 1 END)
        OVER (PARTITION BY mac, a ORDER BY t_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM e),
    r AS (SELECT mac, a, greatest(min(t_ms) FILTER (opens), max(t_ms) FILTER (opens AND pa IS DISTINCT FROM a)) AS s, max(t_ms) FILTER (NOT opens) AS e,
        max(seq) FILTER (NOT opens) AS seq FROM p GROUP BY mac, a, epoch HAVING count(*) FILTER (opens) > 0 AND count(*) FILTER (NOT opens) > 0)"""


def _merge_sql(place: str, order: str, gap: int) -> str:
    return f"""m AS (SELECT *, CASE WHEN lag(mac) OVER w IS NOT NULL AND lag({place}) OVER w = {place} AND s - lag(e) OVER w < {gap} THEN 0 ELSE 1 END AS fresh
        FROM r WINDOW w AS (PARTITION BY mac ORDER BY {order})), i AS (SELECT *, sum(fresh) OVER (PARTITION BY mac ORDER BY {order}) AS island,
        row_number() OVER (PARTITION BY mac ORDER BY {order}) AS rn FROM m),
    g AS (SELECT mac, island, {place}, arg_min(s, rn) AS s, arg_max(e, rn) AS e FROM i GROUP BY mac, island, {place}),
    done AS (SELECT mac, s AS s_ms, least(e, coalesce(lead(s) OVER (PARTITION BY mac ORDER BY island), e)) AS e_ms, {place} FROM g)"""


WIFI_SQL = _WIFI_RAW + ", " + _merge_sql("a", "e, seq", GAP)


@check("w_association_sessions", f"WITH {WIFI_SQL} SELECT mac, s_ms, e_ms, nullif(a, '') AS ap FROM done")
def _(t):
    return sessions.association_sessions(t["wifi"], GAP)


IP_SQL = """p AS (SELECT *, code = 6 AS ends, coalesce(sum(CASE WHEN code = 6 THEN 1 ELSE 0 END) OVER (PARTITION BY mac, ip ORDER BY t_ms, seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM {addr}),
    r AS (SELECT mac, ip, min(t_ms) FILTER (NOT ends) AS s, coalesce(max(t_ms) FILTER (ends), max(t_ms)) AS e FROM p GROUP BY mac, ip, epoch HAVING count(*) FILTER (NOT ends) > 0),
    """ + _merge_sql("ip", "s, e, ip", GAP)


@check("w_ip_sessions", f"WITH {IP_SQL} SELECT mac, s_ms, e_ms, ip FROM done")
def _(t):
    return sessions.ip_sessions(t["addr"], GAP)


@check("w_context_sessions", f"""WITH c AS (SELECT seq, CASE WHEN k % 4 = 0 THEN 'no account ' || CAST(user_id % 200 AS STRING) ELSE 'u' || CAST(user_id % 50 AS STRING) END AS account, 'B' || CAST(k % 3 AS STRING) AS location, t_ms AS stime, t_ms // 86400000 AS d
        FROM (SELECT *, event_id AS seq FROM {{ev}}) e),
    f AS (SELECT *, CASE WHEN stime - lag(stime) OVER w <= {HOUR} AND lag(location) OVER w = location THEN 0 ELSE 1 END AS fresh FROM c WINDOW w AS (PARTITION BY account, d ORDER BY stime, seq)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY account, d ORDER BY stime, seq) AS no FROM f)
    SELECT seq, min(stime) OVER (PARTITION BY account, d, no) AS start, count(*) OVER (PARTITION BY account, d, no) AS n FROM n""")
def _(t):
    rows = t["ev"].select(F.col("event_id").alias("seq"), F.when(F.col("k") % 4 != 0, F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string"))).alias("account"),
                          (F.col("user_id") % 200).cast("string").alias("ip"), F.concat(F.lit("B"), (F.col("k") % 3).cast("string")).alias("location"), F.col("t_ms").alias("stime"))
    marked = sessions.context_sessions(rows, HOUR)
    sizes = marked.groupBy("sid").agg(F.min("stime").alias("start"), F.count("*").alias("n"))
    return marked.join(sizes, "sid").select("seq", "start", "n")


CONN_SQL = f"""x AS (SELECT h.seq, {SOCKET.replace('source_port', 'r.source_port')} AS socket, h.connection, CAST(floor(h.connection_ts * 1e6) AS BIGINT) AS conn_us, CAST(floor(h.request_ts * 1e6) AS BIGINT) AS req_us
        FROM {{http}} h JOIN {{req}} r ON r.event_id = h.seq WHERE h.request_protocol LIKE '%HTTP%' AND h.connection <> 'other' AND h.request_ts IS NOT NULL),
    y AS (SELECT *, sum(CASE WHEN connection IN ('start', 'unique') OR pc IN ('last', 'unique') OR pc IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY socket ORDER BY req_us, seq) AS conn_no
        FROM (SELECT *, lag(connection) OVER (PARTITION BY socket ORDER BY req_us, seq) AS pc FROM x) z),
    conns AS (SELECT socket, conn_no, arg_min(CASE WHEN connection IN ('start', 'unique') AND conn_us IS NOT NULL THEN conn_us ELSE req_us END, (req_us, seq)) AS align_us, min(req_us) AS first_us,
        bool_or(connection IN ('last', 'unique')) AS closed, count(*) AS transfers FROM y GROUP BY 1, 2)"""


def _socket_sql(view: str) -> str:
    """Undirected socket of the tcp view, whose ends are swapped on odd rows."""
    return f"""(SELECT *, CASE WHEN client_ip LIKE '10.%' THEN client_ip ELSE server_ip END AS near_ip, CASE WHEN client_ip LIKE '10.%' THEN server_ip ELSE client_ip END AS far_ip,
        CASE WHEN client_ip LIKE '10.%' THEN client_port ELSE server_port END AS near_port FROM {view})"""


_NUM = "((CAST(split_part({0}, '.', 1) AS BIGINT) * 256 + CAST(split_part({0}, '.', 2) AS BIGINT)) * 256 + CAST(split_part({0}, '.', 3) AS BIGINT)) * 256 + CAST(split_part({0}, '.', 4) AS BIGINT)"
FLOW_SQL = f"""flows AS (SELECT flow_id, client_ip, server_ip, CAST(({_NUM.format('near_ip')}) * 65536 + near_port AS STRING) || '-' || CAST(({_NUM.format('far_ip')}) * 65536 + 80 AS STRING) AS socket,
    f_us AS t_us FROM {_socket_sql('{tcp}')} q)"""


def _transfers(t):
    return jobs.transfers(t["http"])


TCP_FIELDS = {0: "client_ip", 1: "client_port", 2: "c_packets", 8: "c_bytes", 44: "server_ip", 45: "server_port", 46: "s_packets", 52: "s_bytes"}


def tcp_line():
    """A flow record of 111 fields from the tcp view."""
    return F.concat_ws(" ", *[F.coalesce(F.col(TCP_FIELDS[i]).cast("string"), F.lit("-")) if i in TCP_FIELDS else F.format_string("%.3f", "first_abs_time_ms") if i == 97 else F.lit("0") for i in range(111)])


def _flows(t):
    return jobs.flow_keys(t["tcp"].withColumn("line", tcp_line()))


def _line_sql(http_columns) -> str:
    """Both records as SQL: the flow's from its 111 fields, the request's from its 38."""
    from .. import schemas

    cells = [f"coalesce(CAST({TCP_FIELDS[i]} AS VARCHAR), '-')" if i in TCP_FIELDS else "printf('%.3f', first_abs_time_ms)" if i == 97 else "'0'" for i in range(111)]
    asked = []
    for i, (name, kind) in enumerate(zip(schemas.names(schemas.HTTP), schemas.types(schemas.HTTP))):
        text = "'N/A'" if name not in http_columns else f"coalesce(printf('%.6f', {name}), 'N/A')" if kind == "DOUBLE" else f"coalesce(CAST({name} AS VARCHAR), 'N/A')"
        asked.append(f"'\"' || {text} || '\"'" if i >= 17 else text)
    return (f"tcp_lines AS (SELECT flow_id AS pos, 'tcp' AS side, {' || chr(32) || '.join(cells)} AS line FROM {{tcp}}), "
            f"http_lines AS (SELECT seq AS pos, 'http' AS side, {' || chr(32) || '.join(asked)} AS line FROM {{http}}), all_lines AS (SELECT * FROM tcp_lines UNION ALL SELECT * FROM http_lines)")


LINE_SQL = _line_sql({"source_ip", "source_port", "dest_ip", "dest_port", "connection", "connection_ts", "request_ts", "request_time", "response_ts", "response_time_begin", "response_time_end",
                      "request_size", "response_size", "request_url", "request_protocol", "request_host", "request_user_agent", "request_referer", "response_content_type"})


def _dpi(t):
    return t["dpi"].select("*", undirected_socket(F.col("source_ip"), F.col("source_port"), F.col("dest_ip"), F.col("dest_port")).alias("socket"))


@check("w_http_connections", f"WITH {CONN_SQL} SELECT socket, conn_no, align_us, first_us, closed, transfers FROM conns")
def _(t):
    return matching.connection_table(_transfers(t))


HIT_SQL = f"""{CONN_SQL}, {FLOW_SQL}, cand AS (SELECT f.flow_id, c.conn_no, row_number() OVER (PARTITION BY f.flow_id ORDER BY c.closed DESC, c.first_us, c.conn_no) AS rn
    FROM flows f JOIN conns c ON c.socket = f.socket AND abs(f.t_us - c.align_us) < 180000000), hit AS (SELECT f.*, c.conn_no FROM flows f LEFT JOIN cand c ON c.flow_id = f.flow_id AND rn = 1)"""
MERGE_SQL = f"""{HIT_SQL}, merged AS (SELECT CASE WHEN conn_no IS NULL THEN 'flow#' || CAST(flow_id AS STRING) ELSE socket || '#' || CAST(conn_no AS STRING) END AS block, 'tcp' AS side,
    flow_id AS pos, conn_no IS NOT NULL AS matched FROM hit UNION ALL SELECT y.socket || '#' || CAST(y.conn_no AS STRING), 'http', y.seq, h.socket IS NOT NULL
    FROM y LEFT JOIN (SELECT DISTINCT socket, conn_no FROM hit WHERE conn_no IS NOT NULL) h ON h.socket = y.socket AND h.conn_no = y.conn_no)"""


@check("j_match_flows", f"WITH {HIT_SQL} SELECT flow_id, socket, conn_no FROM hit")
def _(t):
    return matching.match_flows(_flows(t), matching.connection_table(_transfers(t))).select("flow_id", "socket", "conn_no")


@check("j_merge_flows", f"WITH {MERGE_SQL} SELECT block, side, pos, matched FROM merged")
def _(t):
    return matching.merge_flows(_flows(t), _transfers(t)).select("block", "side", "pos", "matched")


@check("a_unmatched_transfers", f"WITH {MERGE_SQL} SELECT count(*) FILTER (NOT matched) AS unmatched, count(*) AS total FROM merged WHERE side = 'http'")
def _(t):
    return matching.unmatched_transfers(matching.merge_flows(_flows(t), _transfers(t)))


DPI_SOCKET = "CAST((" + _NUM.format("source_ip") + ") * 65536 + source_port AS STRING) || '-' || CAST((" + _NUM.format("dest_ip") + ") * 65536 + 80 AS STRING)"
TAG_SQL = f"""{FLOW_SQL}, d AS (SELECT *, {DPI_SOCKET} AS socket FROM {{dpi}} WHERE l4 = 'TCP'),
    tag AS (SELECT f.*, coalesce(c.detected, 'N/A') AS protocol FROM flows f LEFT JOIN (SELECT f.flow_id, arg_min(d.detected, d.dpi_no) AS detected FROM flows f JOIN d ON d.socket = f.socket
    AND abs(f.t_us - d.dpi_us) < 60000000 GROUP BY 1) c USING (flow_id))"""


@check("j_tag_protocol", f"WITH {TAG_SQL} SELECT flow_id, protocol FROM tag")
def _(t):
    return matching.tag_protocol(_flows(t), _dpi(t)).select("flow_id", "protocol")


PAIR = """SELECT x.{0}, x.t_ms, {1} FROM {{asks}} x JOIN {2} s ON s.{0} = x.{0} AND x.t_ms BETWEEN s.{3} - 120000 AND s.{4} + 120000"""


@check("j_mac_by_ip", "SELECT x.seq, s.mac AS found FROM {asks} x JOIN {ip_spans} s ON s.ip = x.ip AND x.t_ms BETWEEN s.atime - 120000 AND s.rtime + 120000")
def _(t):
    return matching.mac_by_ip(t["asks"].drop("mac"), t["ip_spans"]).select("seq", F.col("mac").alias("found"))


@check("j_ip_by_mac", """SELECT x.seq, f.found FROM {asks} x LEFT JOIN (SELECT x.seq, arg_min(s.ip, (s.atime, s.rtime, s.ip)) AS found FROM {asks} x JOIN {ip_spans} s ON s.mac = x.mac
    AND x.t_ms BETWEEN s.atime - 120000 AND s.rtime + 120000 GROUP BY 1) f USING (seq)""")
def _(t):
    return matching.ip_by_mac(t["asks"], t["ip_spans"]).select("seq", F.col("found_ip").alias("found"))


@check("j_ap_by_mac", """SELECT x.seq, f.found FROM {asks} x LEFT JOIN (SELECT x.seq, arg_min(s.ap, (s.start_ms, s.end_ms, s.ap)) AS found FROM {asks} x JOIN {ap_spans} s ON s.mac = x.mac
    AND x.t_ms BETWEEN s.start_ms - 120000 AND s.end_ms + 120000 GROUP BY 1) f USING (seq)""")
def _(t):
    return matching.ap_by_mac(t["asks"], _aps(t)).select("seq", F.col("found_ap").alias("found"))


def _aps(t):
    return t["ap_spans"].select("mac", "ap", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


PLACE_SQL = """q AS (SELECT DISTINCT ip, t_ms FROM asked), h AS (SELECT DISTINCT q.ip, q.t_ms, s.mac, s.atime, s.rtime FROM q JOIN {ip_spans} s ON s.ip = q.ip AND q.t_ms BETWEEN s.atime - 120000 AND s.rtime + 120000),
    a AS (SELECT h.ip, h.t_ms, h.mac, h.atime, h.rtime, arg_min(s.ap, (s.start_ms, s.end_ms, s.ap)) AS ap FROM h LEFT JOIN {ap_spans} s ON s.mac = h.mac
        AND h.t_ms BETWEEN s.start_ms - 120000 AND s.end_ms + 120000 GROUP BY ALL),
    place AS (SELECT ip, t_ms, coalesce(arg_min(mac, (atime, rtime, mac)) FILTER (ap IS NOT NULL), arg_max(mac, (atime, rtime, mac))) AS mac,
        arg_min(ap, (atime, rtime, mac)) FILTER (ap IS NOT NULL) AS ap FROM a GROUP BY 1, 2)"""


@check("j_ap_by_ip", f"WITH asked AS (SELECT ip, t_ms FROM {{asks}}), {PLACE_SQL} SELECT x.seq, p.mac AS found_mac, p.ap AS found_ap FROM {{asks}} x LEFT JOIN place p ON p.ip = x.ip AND p.t_ms = x.t_ms")
def _(t):
    return matching.ap_by_ip(t["asks"], t["ip_spans"], _aps(t)).select("seq", "found_mac", "found_ap")


@check("j_tag_device", f"""WITH loc_flows AS (SELECT flow_id, CASE WHEN client_ip LIKE '10.184%' THEN client_ip ELSE server_ip END AS ip, f_us // 1000 AS t_ms FROM {{tcp}}),
    asked AS (SELECT ip, t_ms FROM loc_flows), {PLACE_SQL} SELECT flow_id, coalesce(p.mac, 'N/A') AS device, coalesce(p.ap, 'N/A') AS place FROM loc_flows f LEFT JOIN place p ON p.ip = f.ip AND p.t_ms = f.t_ms""")
def _(t):
    flows = _flows(t).withColumn("t_ms", F.floor(F.col("t_us") / 1000))
    return matching.tag_device(flows, t["ip_spans"], _aps(t), "10.184").select("flow_id", "device", "place")


LOCATION_SQL = """WITH f AS (SELECT *, CASE WHEN kind = 'alloc' AND lag(kind) OVER w = 'recycle' THEN 1 ELSE 0 END AS fresh FROM {loc} WINDOW w AS (PARTITION BY ip, mac ORDER BY t_ms, seq)),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY ip, mac ORDER BY t_ms, seq) AS n FROM f),
    a AS (SELECT *, min(t_ms) FILTER (kind = 'alloc') OVER (PARTITION BY ip, mac, n) AS a0 FROM n),
    g AS (SELECT ip, mac, n, a0, max(t_ms) FILTER (kind = 'alloc') AS a1, max(t_ms) FILTER (kind = 'recycle' AND t_ms - a0 <= 86400000) AS closed, coalesce(min(t_ms) FILTER (kind = 'recycle') - a0 > 86400000, false) AS late
        FROM a WHERE a0 IS NOT NULL GROUP BY ip, mac, n, a0),
    b AS (SELECT *, min(CASE WHEN late THEN n END) OVER (PARTITION BY ip, mac) AS n_late FROM g)
    SELECT ip, mac, min(a0) AS atime, CASE WHEN bool_or(late) THEN max(a1) ELSE max(coalesce(closed, a1)) END AS rtime FROM b GROUP BY ip, mac, least(n, coalesce(n_late, n))"""


@check("w_location_intervals", LOCATION_SQL)
def _(t):
    return sessions.location_intervals(t["loc"])


@check("w_location_days", LOCATION_SQL)
def _(t):
    # the log in three periods, one after the other
    log = t["loc"]
    ends = log.agg(F.min("t_ms").alias("lo"), F.max("t_ms").alias("hi")).first()
    if ends.lo is None:
        return sessions.location_intervals(log)
    third = (ends.hi - ends.lo) // 3 + 1
    period = F.floor((F.col("t_ms") - ends.lo) / third)
    state = settle(sessions.location_state(log.where(period == 0)), "locations")
    for i in (1, 2):
        state = settle(sessions.extend_locations(state, log.where(period == i)), "locations")
    return state.select("ip", "mac", "atime", "rtime")


def attach_ip_sql(moves: str, ips: str, shift: int) -> str:
    return f"""pair AS (SELECT m.mac, m.s_ms, m.e_ms, m.ap, i.s_ms AS s, i.e_ms AS e, i.ip, i.s_ms <= m.e_ms AND i.e_ms >= m.s_ms AS exact FROM {moves} m LEFT JOIN {ips} i
        ON i.mac = m.mac AND i.s_ms // 86400000 = m.s_ms // 86400000 AND i.s_ms - {shift} <= m.e_ms AND i.e_ms + {shift} >= m.s_ms),
    with_ip AS (SELECT mac, s_ms, e_ms, ap, coalesce(arg_max(ip, (s, e, ip)) FILTER (exact), arg_min(ip, (s, e, ip)) FILTER (s IS NOT NULL)) AS ip FROM pair GROUP BY ALL)"""


MOVES_IP = "pair_moves AS (SELECT mac, s_ms, e_ms, ap FROM {moves}), pair_ips AS (SELECT mac, t_ms AS s_ms, t_ms + 1800000 AS e_ms, ip FROM {addr} WHERE code = 5), " + attach_ip_sql("pair_moves", "pair_ips", 2 * HOUR)


@check("j_attach_ip", f"WITH {MOVES_IP} SELECT mac, s_ms, e_ms, ap, ip FROM with_ip")
def _(t):
    held = t["addr"].where("code = 5").select("mac", F.col("t_ms").alias("s_ms"), (F.col("t_ms") + 1_800_000).alias("e_ms"), "ip")
    return matching.attach_ip(t["moves"].select("mac", "s_ms", "e_ms", "ap"), held, 2 * HOUR)


def attach_account_sql(source: str) -> str:
    return f"""au AS (SELECT DISTINCT mac, t_ms // 86400000 AS d, account, ip FROM {{wifi}} WHERE code = 4),
    with_acc AS (SELECT DISTINCT m.mac, m.s_ms, m.e_ms, m.ap, m.ip, a.account FROM {source} m LEFT JOIN au a ON a.mac = m.mac AND a.d = m.s_ms // 86400000
        WHERE a.mac IS NULL OR a.ip IS NULL OR a.ip = '0.0.0.0' OR a.ip IS NOT DISTINCT FROM m.ip)"""


@check("j_attach_account", f"WITH {attach_account_sql('{moves}')} SELECT * FROM with_acc")
def _(t):
    auths = t["wifi"].where("code = 4").select("mac", "t_ms", "account", "ip")
    return matching.attach_account(t["moves"], auths)


LOCATED_SQL = f"""c AS ({CLEAN}), lk AS (SELECT c.*, m.ap AS location, m.account, row_number() OVER (PARTITION BY c.seq ORDER BY CASE WHEN c.stime BETWEEN m.s_ms AND m.e_ms THEN 0 ELSE 1 END, m.s_ms, m.e_ms, m.mac, m.ap) AS rn
        FROM c JOIN {{moves}} m ON m.ip = c.ip AND m.s_ms // 86400000 = c.stime // 86400000 AND c.stime BETWEEN m.s_ms - {HOUR} AND m.e_ms + {HOUR}),
    located AS (SELECT * EXCLUDE (rn, host), regexp_extract(host, '([a-z0-9-]+\\.(com|net|org))$', 1) AS host, host AS full_host FROM lk WHERE rn = 1)"""


@check("j_locate_requests", f"WITH {LOCATED_SQL} SELECT seq, ip, stime, host, location, account FROM located")
def _(t):
    rows = cleaning.clean_http(t["http"], keep=("seq",))
    return matching.locate_requests(rows, t["moves"], SUFFIXES, HOUR).select("seq", "ip", "stime", "host", "location", "account")


@check("j_locate_requests_span_days", f"""WITH c AS ({CLEAN}) SELECT seq, location FROM (SELECT c.seq, m.ap AS location, row_number() OVER (PARTITION BY c.seq ORDER BY CASE WHEN c.stime BETWEEN m.s_ms AND m.e_ms THEN 0 ELSE 1 END,
    m.s_ms, m.e_ms, m.mac, m.ap) AS rn FROM c JOIN {{moves}} m ON m.ip = c.ip AND c.stime // 86400000 BETWEEN m.s_ms // 86400000 AND m.e_ms // 86400000 AND c.stime BETWEEN m.s_ms - {HOUR} AND m.e_ms + {HOUR}) x WHERE rn = 1""")
def _(t):
    rows = cleaning.clean_http(t["http"], keep=("seq",))
    return matching.locate_requests(rows, t["moves"], SUFFIXES, HOUR, span_days=True).select("seq", "location")


@check("j_click_match", f"""WITH e AS ({ENTRY}), tree AS (SELECT seq, agent, t, session_start AS tree FROM ({gap_sql('SELECT * FROM e', 'agent', 't', 300_000_000)}) x),
    clicks AS (SELECT t_us FROM {{ev}} WHERE event_type = 'click'),
    live AS (SELECT DISTINCT agent, tree FROM tree r WHERE EXISTS (SELECT 1 FROM clicks c WHERE r.t - c.t_us >= 0 AND r.t - c.t_us < 60000000))
    SELECT seq FROM tree r WHERE EXISTS (SELECT 1 FROM live l WHERE l.agent IS NOT DISTINCT FROM r.agent AND l.tree = r.tree)""")
def _(t):
    trees = sessions.truth_trees(jobs.entries(t["http"], SUFFIXES), "agent", "t", 300_000_000).withColumn("trace", F.lit(0))
    clicks = t["ev"].where("event_type = 'click'").select(F.lit(0).alias("trace"), F.col("t_us").alias("click"))
    return matching.click_match(trees, clicks, ["trace"], ["agent", "tree"], "t", "click", 60_000_000).select("seq")


@check("j_pair_by_period", """WITH a AS (SELECT DISTINCT date_trunc('hour', make_timestamp(t_ms * 1000)) AS h FROM {tcp}), b AS (SELECT DISTINCT date_trunc('hour', make_timestamp(t_ms * 1000)) AS h FROM {udp})
    SELECT epoch_ms(coalesce(a.h, b.h)) AS period_ms, a.h IS NOT NULL AS has_tcp, b.h IS NOT NULL AS has_udp FROM a FULL JOIN b ON a.h = b.h""")
def _(t):
    def hours(df, name):
        return df.select(F.date_trunc("hour", F.timestamp_millis("t_ms")).alias(name)).distinct()
    a, b = hours(t["tcp"], "tcp_file"), hours(t["udp"], "udp_file")
    both = matching.pair_by_period(a, b, "tcp_file", "udp_file")
    return both.select(F.unix_millis("period").alias("period_ms"), F.col("tcp_file").isNotNull().alias("has_tcp"), F.col("udp_file").isNotNull().alias("has_udp"))


@check("g_classify_pairs", f"""WITH e AS ({ENTRY}), s AS (SELECT *, agent IS NOT NULL AS has_ua, coalesce(agent, dom) AS activity FROM e), w AS ({gap_sql('SELECT * FROM s', 'has_ua, activity', 't', 900_000_000)}),
    p AS (SELECT *, lag(b) OVER q AS pb, lag(e) OVER q AS pe, lag(dur) OVER q AS pdur, lag(dom) OVER q AS pdom FROM w WINDOW q AS (PARTITION BY has_ua, activity, session_start ORDER BY t, seq)),
    m AS (SELECT *, least(coalesce(e, b + 0.1::DOUBLE), coalesce(pe, pb + 0.1::DOUBLE)) - greatest(b, pb) AS ov, abs(b - pb) AS hd, abs(coalesce(e, b + 0.1::DOUBLE) - coalesce(pe, pb + 0.1::DOUBLE)) AS td,
        least(coalesce(nullif(dur, 0), 0.1::DOUBLE), coalesce(nullif(pdur, 0), 0.1::DOUBLE)) AS md FROM p)
    SELECT seq, CASE WHEN pb IS NULL THEN NULL WHEN hd <= 0.5 AND td / md < 0.1 AND dom IS NOT DISTINCT FROM pdom THEN 1 WHEN ov > 0 THEN 2 WHEN ov <= 0 AND abs(ov) < 1 THEN 3
        WHEN ov <= 0 AND abs(ov) < 10 THEN 4 ELSE 9 END AS pair_class FROM m""")
def _(t):
    marked = sessions.ua_sessions(jobs.entries(t["http"], SUFFIXES), "agent", "domain", "t", 900_000_000)
    return sessions.classify_against_previous(marked, ["has_ua", "activity", "session_start"], ["t", "seq"]).select("seq", "pair_class")
