"""Checked queries: statistics, forests, files, streams and whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.net import is_local, undirected_socket
from ..functions.url import registered_domain
from ..operators import cleaning, forest, matching, sessions, stats
from ..plans import jobs
from ..session import scratch, settle
from ..sources import catalog, landing, lines, sinks, tables, traffic, wifi
from ..streaming import jobs as streams
from ..streaming.flows import stream_merge_blocks
from .columns import _CLASS, CLEAN, STRICT
from .sessions import (ENTRY, GAP, HOUR, IP_SQL, LINE_SQL, LOCATED_SQL, MERGE_SQL, PLACE_SQL, TAG_SQL, WIFI_SQL, _aps, _dpi, _flows, _transfers, tcp_line,
                       attach_account_sql, attach_ip_sql, gap_sql)
from .tables import RULES, SUFFIXES, check

# ---- statistics


def _hour(ms="t_ms"):
    return F.floor(F.col(ms) / HOUR) * HOUR


BREAKDOWN_SQL = "SELECT t_ms - t_ms % 3600000 AS hour, l4, proto_name AS l7, count(*) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM {dpi} GROUP BY 1, 2, 3"


@check("a_protocol_breakdown", BREAKDOWN_SQL)
def _(t):
    return stats.protocol_breakdown(t["dpi"], _hour())


_UP = "CASE WHEN client_ip LIKE '10.184%' THEN {0} ELSE {1} END"


def _dir_sql(l4: str) -> str:
    whole = "c_packets IS NOT NULL AND c_bytes IS NOT NULL AND s_packets IS NOT NULL AND s_bytes IS NOT NULL"
    part = [f"count(*) FILTER (l4 = '{l4}') AS {l4}_flows"]
    for unit in ("packets", "bytes"):
        for way, (a, b) in (("up", ("c", "s")), ("down", ("s", "c"))):
            part.append(f"CAST(coalesce(sum({_UP.format(f'{a}_{unit}', f'{b}_{unit}')}) FILTER (l4 = '{l4}' AND {whole}), 0) AS BIGINT) AS {l4}_{unit}_{way}")
    return ", ".join(part)


_COUNTERS = "t_ms - t_ms % 3600000 AS hour, client_ip, c_packets, c_bytes, s_packets, s_bytes"


@check("a_direction_totals", f"""SELECT hour, {_dir_sql('tcp')}, {_dir_sql('udp')} FROM (SELECT 'tcp' AS l4, {_COUNTERS} FROM {{tcp}} UNION ALL SELECT 'udp', {_COUNTERS} FROM {{udp}}) x GROUP BY 1""")
def _(t):
    def cut(name):
        return t[name].select(_hour().alias("hour"), "client_ip", "c_packets", "c_bytes", "s_packets", "s_bytes")
    return stats.direction_totals(cut("tcp"), cut("udp"), r"^10\.184.*")


def _pivot_sql(names, test):
    of = {n: f"{test} = '{n}'" for n in names} | {"other": test + " NOT IN (" + ", ".join(f"'{n}'" for n in names) + ")"}
    return ", ".join(f"CAST(sum({unit}) FILTER ({mine}) AS BIGINT) AS \"{n}_{unit}\"" for n, mine in of.items() for unit in ("flows", "packets", "bytes"))


NAMES = sorted([f"P{i}" for i in range(1, 9)] + ["TCP-Unknown"])  # the rest are other protocols
LABEL_SQL = "CASE WHEN lower(l7) = 'unknown' THEN l4 || '-' || l7 ELSE l7 END"


@check("a_protocol_pivot", f"WITH b AS ({BREAKDOWN_SQL}) SELECT hour, {_pivot_sql(NAMES, LABEL_SQL)} FROM b GROUP BY 1")
def _(t):
    return stats.protocol_pivot(stats.protocol_breakdown(t["dpi"], _hour()), NAMES)


@check("a_protocol_pivot_l4", f"WITH b AS ({BREAKDOWN_SQL}) SELECT hour, {_pivot_sql(['TCP', 'UDP'], 'l4')} FROM b GROUP BY 1")
def _(t):
    return stats.protocol_pivot(stats.protocol_breakdown(t["dpi"], _hour()), ["TCP", "UDP"], layer4=True)


@check("a_protocol_totals", f"WITH b AS ({BREAKDOWN_SQL}) SELECT {LABEL_SQL} AS proto, CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(packets) AS BIGINT) AS packets, CAST(sum(bytes) AS BIGINT) AS bytes FROM b GROUP BY 1")
def _(t):
    return stats.protocol_totals(stats.protocol_breakdown(t["dpi"], _hour()))


@check("a_socket_multiplicity", """WITH s AS (SELECT CASE WHEN flow_id % 23 <> 0 THEN least(client_ip || ':' || client_port, server_ip || ':' || server_port) || '-' || greatest(client_ip || ':' || client_port, server_ip || ':' || server_port) END AS s FROM {tcp}),
    p AS (SELECT s, count(*) AS n FROM s GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS lines, CAST(coalesce(sum(n) FILTER (s IS NULL), 0) AS BIGINT) AS incomplete, count(*) FILTER (s IS NOT NULL AND n = 1) AS once,
    count(*) FILTER (s IS NOT NULL AND n = 2) AS twice, count(*) FILTER (s IS NOT NULL AND n > 2) AS more FROM p""")
def _(t):
    sock = undirected_socket(F.col("client_ip"), F.col("client_port"), F.col("server_ip"), F.col("server_port"))
    return stats.socket_multiplicity(t["tcp"], F.when(F.col("flow_id") % 23 != 0, sock))


@check("a_metric_rollup", """SELECT t_ms - t_ms % 3600000 AS bucket_ms, count(value) AS value_hit, min(value) AS value_min, max(value) AS value_max, quantile_disc(value, 0.9) AS value_prc90,
    count(*) FILTER (k = 1) AS k_idx1, count(*) FILTER (k <> 1) AS k_idxother FROM {ev} GROUP BY 1""")
def _(t):
    rows = t["ev"].withColumn("at", F.timestamp_millis("t_ms"))
    out = stats.metric_rollup(rows, "at", "1 hour", {"value": ["hit", "min", "max", "prc:90"], "k": ["idx:1,other"]})
    return out.withColumn("bucket_ms", F.unix_millis("bucket")).drop("bucket")


@check("a_metric_rollup_days", """SELECT epoch_ms(date_trunc('day', l_shipdate)) AS bucket_ms, round(avg(l_quantity), 6) AS l_quantity_avg, round(stddev_samp(l_quantity), 6) AS l_quantity_stdev, min(l_quantity) AS l_quantity_min,
    max(l_quantity) AS l_quantity_max, count(l_quantity) AS l_quantity_hit, quantile_disc(l_quantity, 0.5) AS l_quantity_prc50, quantile_disc(l_quantity, 0.95) AS l_quantity_prc95,
    count(*) FILTER (l_linenumber = 1) AS l_linenumber_idx1, count(*) FILTER (l_linenumber = 4) AS l_linenumber_idx4, count(*) FILTER (l_linenumber NOT IN (1, 4)) AS l_linenumber_idxother FROM {lineitem} GROUP BY 1""")
def _(t):
    rows = t["lineitem"].withColumn("at", F.col("l_shipdate").cast("timestamp"))
    out = stats.metric_rollup(rows, "at", "1 day", {"l_quantity": ["avg", "stdev", "min", "max", "hit", "prc:50,95"], "l_linenumber": ["idx:1,4,other"]})
    return out.withColumns({"bucket_ms": F.unix_millis("bucket"), "l_quantity_avg": F.round("l_quantity_avg", 6), "l_quantity_stdev": F.round("l_quantity_stdev", 6)}).drop("bucket")


@check("a_ap_traffic", "SELECT ap, CAST(sum(k) AS BIGINT) AS uptraffic, CAST(sum(user_id) AS BIGINT) AS downtraffic FROM {wifi} w JOIN {ev} e ON e.event_id = w.seq WHERE ap IS NOT NULL AND k % 5 <> 0 GROUP BY 1")
def _(t):
    rows = t["wifi"].select("seq", F.col("ap").alias("assocApName")).join(
        t["ev"].select(F.col("event_id").alias("seq"), F.when(F.col("k") % 5 != 0, F.col("k")).alias("srcTotPkts"), F.col("user_id").alias("dstTotPkts")), "seq")
    return stats.ap_traffic(rows)


@check("a_row_count", "SELECT count(*) AS n FROM {lineitem}")
def _(t):
    return catalog.row_count(t["lineitem"])


@check("a_flow_burst", """WITH e AS (SELECT user_id * 40 + k % 40 AS conn, t_ms, CASE event_type WHEN 'view' THEN 'open' WHEN 'error' THEN 'reset' WHEN 'purchase' THEN 'closed' ELSE 'data' END AS state FROM {ev})
    SELECT conn, max(t_ms) FILTER (state = 'open') AS start, max(t_ms) FILTER (state IN ('reset', 'closed')) - max(t_ms) FILTER (state = 'open') AS duration, count(*) FILTER (state <> 'open') + 1 AS packets,
    arg_max(state, t_ms) FILTER (state IN ('reset', 'closed')) AS state FROM e GROUP BY 1 HAVING count(*) FILTER (state = 'open') > 0 AND count(*) FILTER (state IN ('reset', 'closed')) > 0""")
def _(t):
    state = F.when(F.col("event_type") == "view", "open").when(F.col("event_type") == "error", "reset").when(F.col("event_type") == "purchase", "closed").otherwise("data")
    return stats.flow_burst(t["ev"].select((F.col("user_id") * 40 + F.col("k") % 40).alias("conn"), F.col("t_ms").alias("t"), state.alias("state")))


def _predicted(t):
    e = jobs.entries(t["http"], SUFFIXES)
    rows = sessions.truth_trees(e, "agent", "t", 300_000_000).select(F.coalesce("agent", F.lit("-")).alias("agent"), F.col("tree"), "url", "seq")
    return rows.select("agent", "tree", F.concat_ws("|", "url", (F.col("seq") % 400).cast("string")).alias("entity"))


def _truth(t):
    e = jobs.entries(t["http"], SUFFIXES)
    rows = sessions.truth_trees(e, "agent", "t", 900_000_000).select(F.coalesce("agent", F.lit("-")).alias("agent"), F.col("tree"), "url", "seq")
    return rows.select("agent", "tree", F.concat_ws("|", "url", (F.col("seq") % 400).cast("string")).alias("entity"))


_URL = """SELECT h.seq, CASE WHEN request_host IS NULL THEN NULL ELSE regexp_replace(CASE WHEN request_url LIKE 'http%' THEN request_url ELSE request_host || request_url END, '^\\w+:?//', '') END AS url FROM {http} h"""


def _trees_sql(gap: int) -> str:
    return f"""SELECT coalesce(x.agent, '-') AS agent, session_start AS tree, concat_ws('|', u.url, CAST(x.seq % 400 AS VARCHAR)) AS entity FROM ({gap_sql('SELECT * FROM e', 'agent', 't', gap)}) x JOIN u USING (seq)"""


@check("a_evaluate_forest", f"""WITH e AS ({ENTRY}), u AS ({_URL}), p AS ({_trees_sql(300_000_000)}), g AS ({_trees_sql(900_000_000)}), np AS (SELECT agent, tree, count(*) AS n FROM p GROUP BY 1, 2), ng AS (SELECT agent, tree, count(*) AS n FROM g GROUP BY 1, 2),
    d AS (SELECT p.agent, p.tree AS pt, g.tree AS gt, count(*) AS dup FROM p JOIN (SELECT DISTINCT * FROM g) g USING (agent, entity) GROUP BY 1, 2, 3),
    f AS (SELECT d.agent, gt, max(2 * (dup / np.n) * (dup / ng.n) / (dup / np.n + dup / ng.n)) AS f FROM d JOIN np ON np.agent = d.agent AND np.tree = pt JOIN ng ON ng.agent = d.agent AND ng.tree = gt GROUP BY 1, 2)
    SELECT ng.agent, round(avg(coalesce(f, 0)), 6) AS score, count(*) AS trees FROM ng LEFT JOIN f ON f.agent = ng.agent AND f.gt = ng.tree WHERE ng.agent IN (SELECT agent FROM p) GROUP BY 1""")
def _(t):
    return stats.evaluate_forest(_predicted(t), _truth(t)).withColumn("score", F.round("score", 6))


# ---- forests


def _forest_rows(t):
    return jobs.entries(t["http"], SUFFIXES).select("source_ip", F.coalesce("agent", F.lit("-")).alias("agent"), "t", "seq", "url", "ref", "ctype", (F.floor(F.col("end") * 1_000_000)).alias("end_us"))


# requests one by one: a request joins the newest tree that is not idle and holds its referrer, under the newest node there with that address
FOREST_SQL = r"""
    en AS (SELECT seq, source_ip, coalesce(request_user_agent, '-') AS agent, CAST(floor(request_ts * 1e6) AS BIGINT) AS t, regexp_replace(request_referer, '^\w+:?//', '') AS ref, response_content_type AS ctype,
        CASE WHEN request_host IS NULL OR request_url IS NULL THEN NULL WHEN starts_with(request_url, 'http') THEN regexp_replace(request_url, '^\w+:?//', '') ELSE request_host || request_url END AS url
        FROM {http} WHERE request_ts IS NOT NULL),
    o AS (SELECT *, row_number() OVER (PARTITION BY source_ip, agent ORDER BY t, seq) AS i FROM en),
    walk AS (SELECT DISTINCT source_ip, agent, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(tree BIGINT, url VARCHAR, node VARCHAR)[]) AS nodes, CAST([] AS BIGINT[]) AS last, CAST([] AS VARCHAR[]) AS names,
            CAST(NULL AS VARCHAR) AS node, CAST(NULL AS VARCHAR) AS parent, CAST(NULL AS VARCHAR) AS tree, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS VARCHAR) AS planted FROM en
        UNION ALL SELECT source_ip, agent, i,
            nodes || CASE WHEN best IS NULL AND ref IS NOT NULL THEN [struct_pack(tree := spot, url := ref, node := 'd' || seq)] ELSE [] END || CASE WHEN url IS NOT NULL THEN [struct_pack(tree := spot, url := url, node := 'n' || seq)] ELSE [] END,
            CASE WHEN best IS NULL THEN last || [t] ELSE last[1:best - 1] || [t] || last[best + 1:] END,
            CASE WHEN best IS NULL THEN names || [root] ELSE names END,
            'n' || seq, CASE WHEN best IS NULL THEN CASE WHEN ref IS NOT NULL THEN root END ELSE list_filter(nodes, lambda x: x.tree = best AND x.url = ref)[-1].node END,
            CASE WHEN best IS NULL THEN root ELSE names[best] END, t, url, CASE WHEN best IS NULL THEN ref END
        FROM (SELECT *, coalesce(best, len(last) + 1) AS spot, CASE WHEN ref IS NULL THEN 'n' ELSE 'd' END || seq AS root
            FROM (SELECT w.source_ip, w.agent, o.i, w.nodes, w.last, w.names, o.seq, o.t, o.url, o.ref,
                list_max(list_transform(list_filter(w.nodes, lambda x: x.url = o.ref AND o.t - w.last[x.tree] <= 900000000), lambda x: x.tree)) AS best
                FROM walk w JOIN o ON o.source_ip IS NOT DISTINCT FROM w.source_ip AND o.agent = w.agent AND o.i = w.i + 1) a) b),
    edges AS (SELECT source_ip, agent, tree, node, parent, false AS dummy, t, url FROM walk WHERE i > 0
        UNION ALL SELECT source_ip, agent, tree, tree, NULL, true, t, planted FROM walk WHERE planted IS NOT NULL)"""


@check("g_referrer_forest", f"WITH RECURSIVE {FOREST_SQL} SELECT * FROM edges")
def _(t):
    return forest.referrer_forest(_forest_rows(t), ["source_ip", "agent"])


@check("g_split_forest", f"""WITH RECURSIVE {FOREST_SQL},
    wide AS (SELECT parent AS node FROM edges WHERE parent IS NOT NULL AND parent IN (SELECT 'n' || seq FROM en WHERE contains(ctype, 'text')) GROUP BY 1 HAVING count(*) > 1),
    tops AS (SELECT *, parent IS NULL OR node IN (SELECT node FROM wide) AS top FROM edges),
    down AS (SELECT node, node AS up FROM tops WHERE top UNION ALL SELECT x.node, d.up FROM down d JOIN tops x ON x.parent = d.node WHERE NOT x.top)
    SELECT source_ip, agent, node, dummy, t, url, up AS tree, CASE WHEN NOT top THEN parent END AS parent FROM tops JOIN down USING (node)""")
def _(t):
    rows = _forest_rows(t)
    edges = forest.referrer_forest(rows, ["source_ip", "agent"])
    text = rows.where(F.col("ctype").contains("text")).select(F.concat(F.lit("n"), F.col("seq").cast("string")).alias("node"))
    return forest.split_forest(edges, text, 1)


@check("g_activity_forest")
def _(t):
    return jobs.activity(t["http"], SUFFIXES, timeout=900_000_000)


@check("g_tree_measures", f"""WITH e AS ({ENTRY}), x AS ({gap_sql('SELECT * FROM e', 'agent', 't', 900_000_000)}) SELECT coalesce(agent, '-') AS agent, CAST(session_start AS STRING) AS tree, min(t) AS start,
    max(CAST(floor(e * 1e6) AS BIGINT)) AS "end", count(*) AS nodes, count(*) AS requests FROM x GROUP BY 1, 2""")
def _(t):
    e = jobs.entries(t["http"], SUFFIXES)
    rows = sessions.truth_trees(e, "agent", "t", 900_000_000).select(
        F.coalesce("agent", F.lit("-")).alias("agent"), F.col("tree").cast("string").alias("tree"), "t", F.lit(False).alias("dummy"), F.floor(F.col("end") * 1_000_000).alias("end_us"))
    return forest.tree_measures(rows, ["agent"], "end_us")


@check("g_tree_nodes", f"WITH e AS ({ENTRY}), x AS ({gap_sql('SELECT * FROM e', 'agent', 't', 900_000_000)}) SELECT CAST(session_start AS STRING) AS tree, seq, t FROM x")
def _(t):
    rows = sessions.truth_trees(jobs.entries(t["http"], SUFFIXES), "agent", "t", 900_000_000).select(
        F.col("tree").cast("string").alias("tree"), "seq", "t", F.lit(False).alias("dummy"), F.col("seq").alias("node"))
    return forest.tree_nodes(rows).select("tree", "seq", "t")


# ---- text logs and files: lines are made from the given tables, written and read back


def _http_lines(t):
    from .. import schemas

    have, cells = set(t["http"].columns), []
    for i, name in enumerate(schemas.names(schemas.HTTP)):
        kind = schemas.types(schemas.HTTP)[i]
        cell = F.lit(None).cast("string")
        if name in have:
            cell = F.format_string("%.6f", F.col(name)) if kind == "DOUBLE" else F.col(name).cast("string")
            cell = F.when(F.col(name).isNotNull(), cell)
        cell = F.coalesce(cell, F.lit("N/A"))
        cells.append(cell if i < 17 else F.concat(F.lit('"'), cell, F.lit('"')))
    return t["http"].select("seq", F.concat_ws(" ", *cells).alias("value"))


_PARSED = """SELECT source_ip, source_port, dest_ip, connection, CAST(floor(request_ts * 1e3) AS BIGINT) AS request_ms, request_size, response_size, request_url, request_host, request_user_agent, request_referer FROM {http}"""


def _parsed(df):
    return df.select("source_ip", "source_port", "dest_ip", "connection", F.floor(F.col("request_ts") * 1000).alias("request_ms"), "request_size", "response_size",
                     "request_url", "request_host", "request_user_agent", "request_referer")


@check("s_http_log", _PARSED)
def _(t):
    path = scratch(t.spark, "http")
    broken = F.when(F.col("seq") % 7 == 0, F.concat("value", F.lit(' "extra"'))).otherwise(F.lit("short line"))
    whole = _http_lines(t)
    whole.select("value").unionByName(whole.select(broken.alias("value"))).write.option("compression", "gzip").text(path)
    return _parsed(traffic.read_http_log(t.spark, path))


@check("s_http_csv", _PARSED)
def _(t):
    path = scratch(t.spark, "http")
    _http_lines(t).select("value").write.text(path)
    return _parsed(traffic.read_http_csv(t.spark, path))


@check("s_http_light", "SELECT source_ip, source_port, connection, CAST(floor(request_ts * 1e3) AS BIGINT) AS request_ms, request_size, response_size, request_url, request_host, request_user_agent, response_content_type AS response_ctype FROM {http}")
def _(t):
    def cell(c):
        return F.coalesce(F.when(F.col(c).isNotNull(), F.format_string("%.6f", F.col(c)) if dict(t["http"].dtypes)[c] == "double" else F.col(c).cast("string")), F.lit(""))
    names = ["source_ip", "source_port", "dest_ip", "dest_port", "connection", "connection_ts", None, None, None, "request_ts", "request_time", "response_ts", "response_time_begin",
             "response_time_end", None, "request_size", "response_size", None, "request_url", "request_host", "request_user_agent", "request_referer", None, None, "response_content_type"]
    path = scratch(t.spark, "light")
    t["http"].select(F.concat_ws("|", *[F.lit("") if n is None else cell(n) for n in names])).write.text(path)
    return traffic.read_http_light(t.spark, path).select("source_ip", "source_port", "connection", F.floor(F.col("request_ts") * 1000).alias("request_ms"), "request_size", "response_size",
                                                         "request_url", "request_host", "request_user_agent", "response_ctype")


@check("s_tcp_log", "SELECT client_ip, client_port, c_packets AS client_packets, c_bytes AS client_data_bytes, server_ip, server_port, s_packets AS server_packets, s_bytes AS server_data_bytes, f_us // 1000 AS start_ms FROM {tcp}")
def _(t):
    path = scratch(t.spark, "tcp")
    t["tcp"].select(tcp_line().alias("value")).unionByName(t["tcp"].select(F.lit("1.2.3.4 80 1").alias("value"))).write.text(path)
    return traffic.read_tcp_log(t.spark, path).select("client_ip", "client_port", "client_packets", "client_data_bytes", "server_ip", "server_port", "server_packets", "server_data_bytes",
                                                      F.floor("first_abs_time_ms").alias("start_ms"))


@check("s_udp_log", "SELECT client_ip, c_packets AS client_packets, c_bytes AS client_bytes, s_packets AS server_packets, s_bytes AS server_bytes, t_ms FROM {udp}")
def _(t):
    cells = [F.col("client_ip"), F.lit("53"), F.col("t_ms").cast("string"), F.lit("0.5"), F.col("c_bytes"), F.col("c_packets"), F.lit("1"), F.lit("12"),
             F.lit("8.8.8.8"), F.lit("53"), F.lit("0.0"), F.lit("0.0"), F.col("s_bytes"), F.col("s_packets"), F.lit("0"), F.lit("0")]
    path = scratch(t.spark, "udp")
    t["udp"].select(F.concat_ws(" ", *[c.cast("string") for c in cells])).write.text(path)
    return traffic.read_udp_log(t.spark, path).select("client_ip", "client_packets", "client_bytes", "server_packets", "server_bytes", F.floor("client_first_abs_time_ms").alias("t_ms"))


@check("s_dpi_log", "SELECT source_ip, source_port, dest_ip, dpi_us // 1000 AS ms, l4, k AS proto_id, proto_name, packets, bytes FROM (SELECT *, CAST(split_part(detected, '/', 1) AS INT) AS k FROM {dpi}) d")
def _(t):
    cells = [F.col("source_ip"), F.col("source_port"), F.col("dest_ip"), F.col("dest_port"), F.format_string("%.6f", "ts"), F.col("l4"), F.col("detected"), F.col("packets"), F.col("bytes")]
    body = t["dpi"].select(F.concat_ws(" ", *[c.cast("string") for c in cells]).alias("value"))
    head = t["dpi"].limit(1).select(F.lit("src sport dst dport time l4 proto packets bytes").alias("value"))
    path = scratch(t.spark, "dpi")
    head.unionByName(body).write.text(path)
    return traffic.read_dpi_log(t.spark, path).select("source_ip", "source_port", "dest_ip", F.floor(F.col("ts") * 1000).alias("ms"), "l4", "proto_id", "proto_name", "packets", "bytes")


@check("s_wifi_syslog", """SELECT mac, t_ms - t_ms % 1000 AS t_ms, code, CASE WHEN code < 4 THEN ap_name END AS ap, account, ip FROM {wifi}
    UNION ALL SELECT mac, t_ms - t_ms % 1000, code, NULL, NULL, ip FROM {addr}""")
def _(t):
    at = F.date_format(F.timestamp_millis("t_ms"), "MMM d HH:mm:ss yyyy")
    mac = F.concat_ws(":", *[F.substring("mac", i, 2) for i in range(1, 12, 2)])
    head = F.concat(F.col("t_ms").cast("string"), F.lit(" <141>"), at, F.lit(" 192.0.2.7 stm[12]: <"))
    ap = F.concat(F.lit(" AP 192.0.2.7-02:00:5e:00:53:01-"), F.col("ap_name"), F.lit(" done"))
    body = (
        F.when(F.col("code") == 0, F.concat(head, F.lit("501091> <NOTI>  Auth request: "), mac, F.lit(": "), ap))
        .when(F.col("code") == 1, F.concat(head, F.lit("501106> <NOTI>  Deauth to sta: "), mac, F.lit(": Ageout"), ap))
        .when(F.col("code") == 2, F.concat(head, F.lit("501095> <NOTI>  Assoc request @ x: "), mac, F.lit(" (SN 1): "), ap))
        .when(F.col("code") == 3, F.concat(head, F.lit("501102> <NOTI>  Disassoc from sta: "), mac, F.lit(":"), ap))
        .otherwise(F.concat(head, F.lit("522008> <NOTI>  User ok: username="), F.coalesce("account", F.lit("-")), F.lit(" MAC="), mac, F.lit(" IP="), F.coalesce("ip", F.lit("-")), F.lit(" AP=x role=y")))
    )
    moves = t["wifi"].select(body.alias("value"))
    number = F.when(F.col("code") == 6, "522005").when(F.col("seq") % 2 == 0, "522006").otherwise("522026")
    held = t["addr"].select(F.concat(head, number, F.lit("> <INFO>  User entry: MAC="), mac, F.lit(" IP="), F.col("ip"), F.lit(" x")).alias("value"))
    noise = t["addr"].select(F.concat(head, F.lit("404400> <WARN> other")).alias("value"))
    path = scratch(t.spark, "syslog")
    moves.unionByName(held).unionByName(noise).write.text(path)
    return wifi.parse_wifi_syslog(lines.read_lines(t.spark, path))


@check("s_split_good_bad", "SELECT count(*) AS lines, count(*) FILTER (k % 3 <> 0) AS good, count(*) FILTER (k % 3 = 0) AS bad FROM {ev}")
def _(t):
    rows = t["ev"].select(F.when(F.col("k") % 3 == 0, "a|b").otherwise("a|b|c").alias("value"))
    return lines.arity_counts(rows, 3, "|")


@check("s_location_log", """SELECT mac, kind, t_ms - t_ms % 1000 AS t_ms, ip, NULL AS end_ms, NULL AS ap FROM {loc} UNION ALL
    SELECT mac, 'assoc', start_ms - start_ms % 1000, NULL, end_ms - end_ms % 1000, ap FROM {ap_spans}""")
def _(t):
    def iso(c):
        return F.date_format(F.timestamp_millis(c), "yyyy-MM-dd HH:mm:ss")
    held = t["loc"].select(F.concat_ws("\t", "mac", iso("t_ms"), F.when(F.col("kind") == "alloc", "IPAllocation").otherwise("IPRecycle"), "ip").alias("value"))
    seen = t["ap_spans"].select(F.concat_ws("\t", "mac", iso("start_ms"), iso("end_ms"), F.lit("60"), "ap").alias("value"))
    path = scratch(t.spark, "location")
    held.unionByName(seen).write.text(path)
    return wifi.read_location_log(t.spark, path)


@check("s_named_files", "SELECT k, count(*) AS n FROM {ev} WHERE k % 3 = 1 GROUP BY 1")
def _(t):
    path = scratch(t.spark, "named")
    # three folders; the names of the files in one of them match, the others' differ by their suffix
    for i, codec in enumerate(("bzip2", "gzip", "none")):
        t["ev"].where(F.col("k") % 3 == i).select(F.col("k").cast("string").alias("value")).write.option("compression", codec).text(f"{path}/{codec}")
    found = lines.read_lines(t.spark, path, name_regex=r"PART-\d+.*\.gz$")
    return found.groupBy(F.col("value").cast("int").alias("k")).agg(F.count("*").alias("n"))


@check("s_tolerant_gzip", "SELECT CAST(event_id AS STRING) AS value FROM {ev}")
def _(t):
    path = scratch(t.spark, "gz")
    t["ev"].select(F.col("event_id").cast("string")).write.option("compression", "gzip").text(path)
    return lines.read_lines(t.spark, path + "/*.gz", tolerant_gzip=True)


@check("u_traces", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS line_no, CAST(event_id AS STRING) AS value FROM {ev}")
def _(t):
    path = scratch(t.spark, "traces")
    t["ev"].repartitionByRange(5, "event_id").sortWithinPartitions("event_id").select(F.col("event_id").cast("string")).write.text(path)
    return lines.trace_lines(t.spark, path).select("line_no", "value")


@check("s_ap_table", "SELECT 'B' || CAST(event_id AS STRING) AS code, 'name ' || CAST(k AS STRING) AS name FROM {ev} WHERE event_id % 7 <> 0 AND k % 5 <> 0")
def _(t):
    path = scratch(t.spark, "aps")
    code, name = F.concat(F.lit("B"), F.col("event_id").cast("string")), F.concat(F.lit("name "), F.col("k").cast("string"))
    cells = [F.when(F.col("event_id") % 7 == 0, "null").otherwise(code), F.when(F.col("k") % 5 == 0, "null").otherwise(name), F.lit("T"), F.lit("U"), F.lit("121.4"), F.lit("31.0")]
    t["ev"].select(F.concat_ws(",", *cells)).write.text(path)
    return tables.load_ap_table(t.spark, path).select("code", "name")


@check("p_without_nulls", "SELECT seq FROM {http} WHERE request_host IS NOT NULL AND response_size IS NOT NULL")
def _(t):
    return cleaning.without_nulls(t["http"].select("seq", "request_host", "response_size"), ["request_host", "response_size"]).select("seq")


@check("s_delimited", "SELECT CAST(user_id AS INT) AS user_id, t_ms - t_ms % 1000 AS ms, k AS loc FROM {ev}")
def _(t):
    from .. import schemas
    path = scratch(t.spark, "mobility")
    sinks.write_delimited(t["ev"].select("user_id", F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd HH:mm:ss").alias("time"), F.col("k").alias("loc")), path, ",")
    return lines.read_delimited(t.spark, path, schemas.MOBILITY, ",").select("user_id", F.unix_millis("time").alias("ms"), "loc")


@check("s_land", """SELECT event_id, event_type FROM {ev} WHERE make_timestamp(t_ms * 1000) >= (SELECT date_trunc('day', make_timestamp(min(t_ms) * 1000)) + INTERVAL 6 HOUR FROM {ev})
    AND make_timestamp(t_ms * 1000) < (SELECT date_trunc('day', make_timestamp(min(t_ms) * 1000)) + INTERVAL 101 HOUR FROM {ev})""")
def _(t):
    path = scratch(t.spark, "landed")
    landing.land(t["ev"].select("event_id", "event_type", "t_ms"), path, F.timestamp_millis("t_ms"))
    first = t["ev"].agg(F.date_trunc("day", F.timestamp_millis(F.min("t_ms"))).alias("d")).select(
        F.date_format(F.col("d") + F.expr("INTERVAL 6 HOURS"), "yyyy-MM-dd HH").alias("a"), F.date_format(F.col("d") + F.expr("INTERVAL 101 HOURS"), "yyyy-MM-dd HH").alias("b")).first()
    return landing.read_period(t.spark, path, first["a"], first["b"]).select("event_id", "event_type")


@check("s_lookup", "SELECT page_id, regexp_extract(regexp_extract(url, '^https?://([^/]+)', 1), '([^.]+\\.[^.]+)$', 1) AS \"domain\" FROM {pages}")
def _(t):
    # every last label of the given hosts as a rule of its own, read back as a user's file
    path = scratch(t.spark, "suffixes")
    t["pages"].select(F.regexp_extract("url", r"^https?://[^/]*\.([^./]+)(/|$)", 1).alias("value")).distinct().repartition(3, "value").write.text(path)
    rules = tables.read_lookup(t.spark, "suffixes", path + "/part-*")
    return t["pages"].select("page_id", registered_domain(F.col("url"), rules).alias("domain"))


@check("s_touch_log", "SELECT CAST(t_ms AS STRING) AS time, CAST(k AS STRING) AS x, CAST(user_id AS STRING) AS y FROM {ev} WHERE event_type = 'click'")
def _(t):
    line = F.when(F.col("event_type") == "click", F.concat_ws(" ", F.lit("touch"), "t_ms", F.concat_ws(":", "k", "user_id"))).when(F.col("event_type") == "view", "# note").otherwise("one two")
    return tables.parse_touch_log(t["ev"].select(line.alias("value")))


@check("s_device_events", "SELECT t_ms / 1e3 AS t, event_type AS action FROM {ev} WHERE k % 2 = 0")
def _(t):
    line = F.concat_ws(" ", F.format_string("%d.%03d", F.floor(F.col("t_ms") / 1000), F.col("t_ms") % 1000), F.when(F.col("k") % 2 == 0, "screen").otherwise("key"), "event_type")
    return tables.parse_device_events(t["ev"].select(line.alias("value")))


@check("s_tcptrace", "SELECT client_ip AS host_a, server_ip AS host_b, CAST(client_port AS STRING) AS port_a, CAST(server_port AS STRING) AS port_b FROM {tcp}")
def _(t):
    path = scratch(t.spark, "trace")
    t["tcp"].select(F.concat_ws(", ", F.col("flow_id").cast("string"), "client_ip", "server_ip", F.col("client_port").cast("string"), F.col("server_port").cast("string"), F.lit("9"))).write.text(path)
    return traffic.read_tcptrace(t.spark, path).drop("conn")


@check("s_profiles", "SELECT account, id, sex, birth, eduy FROM {profiles}")
def _(t):
    path = scratch(t.spark, "profiles")
    sinks.write_delimited(t["profiles"], path, ",")
    return tables.read_profiles(t.spark, path)


@check("s_wifi_sessions", "SELECT mac, s_ms, e_ms, ap, ip, account FROM {moves}")
def _(t):
    path = scratch(t.spark, "moves")
    sinks.write_delimited(t["moves"].select("mac", "s_ms", "e_ms", "ap", "ip", "account"), path, ",")
    return wifi.read_wifi_sessions(t.spark, path)


@check("k_by_month", "SELECT 'SET' || strftime(l_shipdate, '%y%m') AS \"set\", l_orderkey, l_linenumber FROM {lineitem}")
def _(t):
    path = scratch(t.spark, "months")
    sinks.write_by_month(t["lineitem"].select("l_orderkey", "l_linenumber", F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("stime")), path)
    return t.spark.read.parquet(path).select("set", "l_orderkey", "l_linenumber")


@check("k_hourly", BREAKDOWN_SQL)
def _(t):
    path = scratch(t.spark, "hourly")
    for part in (0, 1, 0):  # the first hours are written again
        hours = stats.protocol_breakdown(t["dpi"], _hour()).where(F.floor(F.col("hour") / HOUR) % 2 == part)
        sinks.write_hourly(hours.withColumn("hour", F.timestamp_millis("hour")), path)
    return t.spark.read.parquet(path).withColumn("hour", F.unix_millis("hour")).drop("at", "hh")


@check("k_location_db", "SELECT 'ip' AS side, mac, ip AS name, atime AS lo, rtime AS hi FROM {ip_spans} UNION ALL SELECT 'ap', mac, ap, start_ms, end_ms FROM {ap_spans}")
def _(t):
    path = scratch(t.spark, "places")
    sinks.save_location_db(t["ip_spans"], _aps(t), path)
    ip, ap = sinks.load_location_db(t.spark, path)
    return ip.select(F.lit("ip").alias("side"), "mac", F.col("ip").alias("name"), F.col("atime").alias("lo"), F.col("rtime").alias("hi")).unionByName(
        ap.select(F.lit("ap").alias("side"), "mac", F.col("ap").alias("name"), F.col("start").alias("lo"), F.col("end").alias("hi")))


@check("k_recompress", "SELECT CAST(event_id AS STRING) AS value FROM {ev}")
def _(t):
    a, b = scratch(t.spark, "plain"), scratch(t.spark, "packed")
    t["ev"].select(F.col("event_id").cast("string")).write.text(a)
    sinks.recompress(t.spark, a, b, "gzip")
    return lines.read_lines(t.spark, b)


@check("w_flow_blocks", f"""WITH {MERGE_SQL}, c AS (SELECT block, count(*) FILTER (side = 'tcp') AS n_tcp, count(*) FILTER (side = 'http') AS n_http FROM merged GROUP BY 1)
    SELECT n, CAST(sum(m) AS BIGINT) AS blocks FROM (SELECT 2 + n_http - 1 AS n, 1 AS m FROM c WHERE n_http > 0 UNION ALL SELECT 2, 1 FROM c WHERE n_http = 0 UNION ALL SELECT 1, greatest(n_tcp - 1, 0) FROM c) x WHERE m > 0 GROUP BY 1""")
def _(t):
    path = scratch(t.spark, "blocks")
    flows, sent = settle(_flows(t), "flows"), settle(_transfers(t), "numbered-transfers")
    sinks.write_flow_blocks(matching.with_lines(matching.merge_flows(flows, sent), flows, sent), path)
    numbered = sessions.flow_blocks(lines.ordered_lines(t.spark, path))
    sizes = numbered.groupBy("file", "block").agg(F.count("*").cast("int").alias("n"))
    return sizes.groupBy("n").agg(F.count("*").alias("blocks"))


@check("c_catalog", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS keys, 2 AS columns FROM {ev}")
def _(t):
    path, file = scratch(t.spark, "table"), scratch(t.spark, "file")
    name = "keyvalue_" + path.rsplit("-", 1)[1]
    sinks.write_delimited(t["ev"].select("event_id", "event_type"), file, ",")
    catalog.create_table(t.spark, name, "key BIGINT, value STRING", path)
    catalog.load_file(t.spark, name, file)
    width = catalog.describe(t.spark, name).count() * catalog.show_tables(t.spark, name).count()
    rows = t.spark.read.schema(t.spark.table(name).schema).csv(path)
    out = rows.agg(F.count("*").alias("n"), F.sum("key").alias("keys"), F.lit(width).alias("columns"))
    t.spark.sql(f"DROP TABLE {name}")
    return out


# ---- whole jobs

_STATS = """cl AS (SELECT seq, account, location, stime, etime, size, mobile, sp, scat, located.host, stime // 86400000 AS d FROM located JOIN svc ON svc.host = located.full_host WHERE sp IS NOT NULL),
    fr AS (SELECT *, CASE WHEN stime - lag(stime) OVER w <= 3600000 AND lag(location) OVER w = location THEN 0 ELSE 1 END AS fresh FROM cl WINDOW w AS (PARTITION BY account, d ORDER BY stime, seq)),
    nn AS (SELECT *, sum(fresh) OVER (PARTITION BY account, d ORDER BY stime, seq) AS no FROM fr), k AS (SELECT *, account || '|' || d || '|' || no AS sid FROM nn),
    mo AS (SELECT sid, arg_min(mobile, (-n, mobile)) AS mobile FROM (SELECT sid, mobile, count(*) AS n FROM k WHERE mobile <> 'unknown' GROUP BY 1, 2) x GROUP BY 1),
    sv AS (SELECT sid, sp, scat, host, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS requests FROM k GROUP BY ALL),
    li AS (SELECT sid, string_agg(sp, ';' ORDER BY bytes DESC, sp, scat NULLS FIRST, host) AS sps, string_agg(coalesce(scat, 'null'), ';' ORDER BY bytes DESC, sp, scat NULLS FIRST, host) AS scats,
        string_agg(host, ';' ORDER BY bytes DESC, sp, scat NULLS FIRST, host) AS hosts, string_agg(CAST(bytes AS VARCHAR), ';' ORDER BY bytes DESC, sp, scat NULLS FIRST, host) AS bytes,
        string_agg(CAST(requests AS VARCHAR), ';' ORDER BY bytes DESC, sp, scat NULLS FIRST, host) AS requests FROM sv GROUP BY 1),
    ctx AS (SELECT g.account, g.location, g.stime, g.sdur, mo.mobile, li.sps, li.scats, li.hosts, li.bytes, li.requests FROM (SELECT sid, any_value(account) AS account, any_value(location) AS location, min(stime) AS stime,
        max(etime) - min(stime) AS sdur FROM k GROUP BY 1) g JOIN li USING (sid) LEFT JOIN mo USING (sid))"""
CONTEXT_SQL = f"{_CLASS}, {LOCATED_SQL}, {_STATS}"


def _context(t):
    return jobs.http_context(t["http"], t["moves"], RULES, t.lookup("classes"), t.lookup("class_names"), t.lookup("suffixes"), tol=HOUR, gap=HOUR)


@check("job_http_context", f"WITH {CONTEXT_SQL} SELECT * FROM ctx")
def _(t):
    return stats.flat_services(_context(t))


@check("job_publish", f"WITH {CONTEXT_SQL} SELECT p.id, location, stime, sdur, sps, scats, hosts, bytes, requests, sex, birth, eduy FROM ctx JOIN {{profiles}} p USING (account)")
def _(t):
    return jobs.publish_rows(_context(t), t["profiles"])


@check("k_publish", f"""WITH {CONTEXT_SQL}, j AS (SELECT p.id, sex, birth, eduy, stime FROM ctx JOIN {{profiles}} p USING (account))
    SELECT 'profiles' AS part, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT id, sex, birth, eduy FROM j) x UNION ALL SELECT 'traffic', count(*), min(id) FROM j""")
def _(t):
    people, traffic_path = sinks.publish(jobs.publish_rows(_context(t), t["profiles"], by="id"), scratch(t.spark, "published"))
    def part(path, name):
        return t.spark.read.csv(path).agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.min("_c0").alias("first_id"))
    return part(people, "profiles").unionByName(part(traffic_path, "traffic"))


SESSION_SQL = f"""{_CLASS}, st AS ({STRICT}), ex AS (SELECT st.*, svc2.sp, svc2.scat, regexp_extract(st.host, '([a-z0-9-]+\\.(com|net|org))$', 1) AS "domain" FROM st LEFT JOIN (SELECT h.host, f.category AS sp,
        coalesce(n.name, CAST(c.cls1 AS VARCHAR)) AS scat FROM (SELECT DISTINCT host FROM st) h LEFT JOIN (SELECT host, arg_min(category, rule_no) AS category FROM (SELECT DISTINCT host FROM st) q, {{rules}} r WHERE regexp_matches(q.host, r.regex) GROUP BY 1) f USING (host)
        LEFT JOIN {{classes}} c ON c.category = f.category LEFT JOIN {{class_names}} n ON n.cls1 = c.cls1) svc2 USING (host)),
    ss AS ({gap_sql('SELECT * FROM ex', 'ip', 'stime', GAP)}),
    tot AS (SELECT ip, session_start AS sstime, max(etime) AS setime, count(*) AS total_requests, CAST(sum(size) AS BIGINT) AS total_bytes FROM ss GROUP BY 1, 2),
    sv AS (SELECT ip, session_start AS sstime, sp, scat, "domain", CAST(sum(size) AS BIGINT) AS bytes FROM ss GROUP BY ALL),
    tp AS (SELECT *, row_number() OVER (PARTITION BY ip, sstime ORDER BY bytes DESC, sp DESC NULLS LAST, scat DESC NULLS LAST, "domain" DESC) AS rn FROM sv)"""


@check("job_http_sessions", f"WITH {SESSION_SQL} SELECT ip, sstime, setime, total_requests, total_bytes, sp, scat, \"domain\", bytes FROM tot JOIN tp USING (ip, sstime) WHERE rn = 1 AND setime > 0 AND setime >= sstime")
def _(t):
    return jobs.http_sessions(t["http"], RULES, t.lookup("classes"), t.lookup("class_names"), t.lookup("suffixes"), GAP)


_JOB_WIFI = f"""WITH {WIFI_SQL.replace('done AS', 'wdone AS')}, {IP_SQL.replace('p AS', 'ip_p AS').replace('FROM p ', 'FROM ip_p ').replace('r AS', 'ip_r AS', 1).replace('FROM r ', 'FROM ip_r ').replace('m AS (', 'ip_m AS (').replace('FROM m)', 'FROM ip_m)').replace('i AS (', 'ip_i AS (').replace('FROM i ', 'FROM ip_i ').replace('g AS (', 'ip_g AS (').replace('FROM g)', 'FROM ip_g)').replace('done AS', 'ipdone AS')},
    wm AS (SELECT mac, s_ms, e_ms, nullif(a, '') AS ap FROM wdone), {attach_ip_sql('wm', 'ipdone', 2 * HOUR)}, {attach_account_sql('with_ip')} SELECT * FROM with_acc"""


@check("job_wifi_sessions", _JOB_WIFI)
def _(t):
    both = t["wifi"].select("mac", "t_ms", "code", "ap", "account", "ip", "seq").unionByName(
        t["addr"].select("mac", "t_ms", "code", F.lit(None).cast("string").alias("ap"), F.lit(None).cast("string").alias("account"), "ip", "seq"))
    return jobs.wifi_sessions(both, None, GAP, 2 * HOUR)


ENDS_SQL = """r AS (SELECT m.block, 0 AS rank, m.pos, f.client_ip AS src_ip, f.server_ip AS dst_ip, f.t_us // 1000 AS t_ms FROM merged m JOIN flows f ON m.side = 'tcp' AND f.flow_id = m.pos
    UNION ALL SELECT m.block, 1, m.pos, h.source_ip, h.dest_ip, coalesce(y.conn_us, y.req_us) // 1000 FROM merged m JOIN y ON m.side = 'http' AND y.seq = m.pos JOIN {http} h ON h.seq = m.pos),
    ends AS (SELECT block, arg_min(src_ip, (rank, pos)) AS src_ip, arg_min(dst_ip, (rank, pos)) AS dst_ip, arg_min(t_ms, (rank, pos)) AS t_ms FROM r GROUP BY 1)"""
_TAGGED = f"""{MERGE_SQL}, {TAG_SQL.split('flows AS', 1)[1].split('), d AS', 1)[1].join(['d AS', ''])}, {ENDS_SQL}, {LINE_SQL}, lf AS (SELECT block, CASE WHEN src_ip LIKE '10.184%' THEN src_ip ELSE dst_ip END AS ip, t_ms FROM ends),
    asked AS (SELECT ip, t_ms FROM lf), {PLACE_SQL}, tagged AS (SELECT m.block, m.side, m.pos, m.matched, tag.protocol, coalesce(p.mac, 'N/A') AS device, coalesce(p.ap, 'N/A') AS place, line
    FROM merged m LEFT JOIN tag ON m.side = 'tcp' AND tag.flow_id = m.pos JOIN lf ON lf.block = m.block JOIN all_lines l ON l.side = m.side AND l.pos = m.pos LEFT JOIN place p ON p.ip = lf.ip AND p.t_ms = lf.t_ms)"""
_JOB_FLOW = f"WITH {_TAGGED} SELECT * FROM tagged"


@check("job_flow_merge", _JOB_FLOW)
def _(t):
    return jobs.flow_merge(_flows(t), _transfers(t), _dpi(t), t["ip_spans"], _aps(t), "10.184").select("block", "side", "pos", "matched", "protocol", "device", "place", "line")


@check("job_activity_scores")
def _(t):
    clicks = t["ev"].where("event_type = 'click'").select(F.concat(F.lit("10.184."), (F.col("user_id") % 200).cast("string"), F.lit("."), (F.col("k") % 3).cast("string")).alias("source_ip"), F.col("t_us").alias("click"))
    return jobs.evaluate_activity(t["http"], clicks, ["source_ip"], SUFFIXES, burst=300_000_000, within=60_000_000)


@check("k_flow_blocks", f"""WITH {_TAGGED} SELECT CASE WHEN side = 'tcp' THEN 'TCP: ' || device || ' ' || place || ' ' || protocol || ' ' || line ELSE 'HTTP: ' || line END AS value FROM tagged
    UNION ALL SELECT 'TCP: ' || min(device) || ' ' || min(place) || ' -' FROM tagged GROUP BY block HAVING count(*) FILTER (side = 'tcp') = 0
    UNION ALL SELECT 'HTTP: -' FROM tagged GROUP BY block HAVING count(*) FILTER (side = 'http') = 0""")
def _(t):
    path = scratch(t.spark, "blocks")
    sinks.write_flow_blocks(jobs.flow_merge(_flows(t), _transfers(t), _dpi(t), t["ip_spans"], _aps(t), "10.184"), path)
    return lines.read_lines(t.spark, path)


@check("j_block_endpoints", f"""WITH {MERGE_SQL}, r AS (SELECT m.block, 0 AS rank, m.pos, f.client_ip AS src_ip, f.server_ip AS dst_ip, f.t_us // 1000 AS t_ms FROM merged m JOIN flows f ON m.side = 'tcp' AND f.flow_id = m.pos
    UNION ALL SELECT m.block, 1, m.pos, h.source_ip, h.dest_ip, coalesce(y.conn_us, y.req_us) // 1000 FROM merged m JOIN y ON m.side = 'http' AND y.seq = m.pos JOIN {{http}} h ON h.seq = m.pos)
    SELECT block, arg_min(src_ip, (rank, pos)) AS src_ip, arg_min(dst_ip, (rank, pos)) AS dst_ip, arg_min(t_ms, (rank, pos)) AS t_ms FROM r GROUP BY 1""")
def _(t):
    blocks = matching.merge_flows(_flows(t), _transfers(t)).withColumn("t_ms", F.floor(F.col("t_us") / 1000))
    return matching.block_endpoints(blocks)


# ---- streams: what is there is processed once; a marker far ahead closes the last windows

FAR = 4_102_444_800_000  # 2100-01-01


def _closed(t, df, time_ms, ts, **fixed):
    """Rows with a timestamp plus one marker row, written as stream input. The marker is made from the written rows, so they are computed once."""
    rows = df.withColumn(ts, F.timestamp_millis(time_ms))
    path = scratch(t.spark, "stream-in")
    rows.write.parquet(path)
    marker = t.spark.read.schema(rows.schema).parquet(path).limit(1)
    marker.withColumns({ts: F.timestamp_millis(F.lit(FAR)), **{c: F.lit(v) for c, v in fixed.items()}}).select(rows.columns).write.mode("append").parquet(path)
    return t.spark.readStream.schema(rows.schema).parquet(path)


def _run(t, stream):
    out = scratch(t.spark, "stream-out")
    streams.run_available(stream, out, scratch(t.spark, "stream-state"))
    return t.spark.read.schema(stream.schema).parquet(out)


@check("t_protocol_hours", BREAKDOWN_SQL)
def _(t):
    source = _closed(t, t["dpi"].select("t_ms", "l4", "proto_name", "packets", "bytes"), "t_ms", "ts")
    return _run(t, streams.stream_protocol_hours(source)).withColumn("hour", F.unix_millis("hour"))


@check("t_direction_hours", f"""WITH b AS (SELECT hour, {_dir_sql('tcp')}, {_dir_sql('udp')} FROM (SELECT 'tcp' AS l4, {_COUNTERS} FROM {{tcp}} UNION ALL SELECT 'udp', {_COUNTERS} FROM {{udp}}) x GROUP BY 1)
    SELECT hour, 'tcp' AS l4, tcp_flows AS flows, tcp_packets_up AS packets_up, tcp_packets_down AS packets_down, tcp_bytes_up AS bytes_up, tcp_bytes_down AS bytes_down FROM b WHERE tcp_flows > 0
    UNION ALL SELECT hour, 'udp', udp_flows, udp_packets_up, udp_packets_down, udp_bytes_up, udp_bytes_down FROM b WHERE udp_flows > 0""")
def _(t):
    names = ["t_ms", "client_ip", "c_packets", "c_bytes", "s_packets", "s_bytes"]
    both = t["tcp"].select(*names, F.lit("tcp").alias("l4")).unionByName(t["udp"].select(*names, F.lit("udp").alias("l4")))
    return _run(t, streams.stream_direction_hours(_closed(t, both, "t_ms", "ts"), is_local(F.col("client_ip"), r"^10\.184.*"))).withColumn("hour", F.unix_millis("hour"))


@check("t_sessionize", "SELECT ip, session_start AS start, max(stime) AS last, count(*) AS requests, CAST(sum(size) AS BIGINT) AS bytes FROM (" + gap_sql(CLEAN, "ip", "stime", GAP) + ") x GROUP BY 1, 2")
def _(t):
    source = _closed(t, cleaning.clean_http(t["http"]).select("ip", "stime", "size"), "stime", "ts", ip="marker")
    return _run(t, streams.stream_sessionize(source, "ip", gap="6 hours")).select("ip", F.unix_millis("start").alias("start"), F.unix_millis("last").alias("last"), "requests", "bytes")


@check("t_merge_flows", """WITH f AS (SELECT flow_id, user_id % 40 AS socket, f_us // 1000 AS t FROM {tcp} JOIN {ev} ON event_id = flow_id), h AS (SELECT event_id AS seq, user_id % 40 AS socket, t_ms AS t FROM {ev})
    SELECT f.flow_id, h.seq FROM f FULL JOIN h ON f.socket = h.socket AND abs(f.t - h.t) < 180000""")
def _(t):
    users = t["ev"].select(F.col("event_id").alias("flow_id"), (F.col("user_id") % 40).alias("socket"))
    flows = t["tcp"].select("flow_id", F.floor(F.col("f_us") / 1000).alias("f_ms")).join(users, "flow_id")
    sent = t["ev"].select(F.col("event_id").alias("seq"), (F.col("user_id") % 40).alias("socket"), "t_ms")
    a = _closed(t, flows, "f_ms", "flow_ts", flow_id=-1, socket=-1)
    b = _closed(t, sent, "t_ms", "http_ts", seq=-1, socket=-2)
    return _run(t, streams.stream_merge_flows(a, b)).where("coalesce(flow_id, 0) >= 0 AND coalesce(seq, 0) >= 0").select("flow_id", "seq")


@check("t_best_matches", f"WITH {MERGE_SQL} SELECT block, side, pos, matched FROM merged")
def _(t):
    flows = _flows(t).select("flow_id", "socket", "t_us", F.floor(F.col("t_us") / 1000).alias("f_ms"))
    sent = _transfers(t).select("seq", "socket", "connection", "conn_us", "req_us", F.floor(F.col("req_us") / 1000).alias("t_ms"))
    a = _closed(t, flows, "f_ms", "flow_ts", flow_id=-1, socket="-")
    b = _closed(t, sent, "t_ms", "http_ts", seq=-1, socket="+")
    # a connection may have begun long before its first request: the stream only gathers, the blocks come from all rows
    pairs = _run(t, streams.stream_merge_flows(a, b)).where("coalesce(flow_id, 0) >= 0 AND coalesce(seq, 0) >= 0")
    return streams.best_matches(pairs).select("block", "side", "pos", "matched")


@check("t_land_once", "SELECT t_ms - t_ms % 3600000 AS hour_ms, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM {dpi} GROUP BY 1")
def _(t):
    source, path, notes = (scratch(t.spark, name) for name in ("land-in", "landed", "land-notes"))
    t["dpi"].select("t_ms", "bytes").write.parquet(source)
    rows = t.spark.readStream.schema("t_ms LONG, bytes LONG").option("maxFilesPerTrigger", 1).parquet(source)
    streams.land_stream(rows, path, F.timestamp_millis("t_ms"), notes)
    # the stream forgets that its batches ended, and once more with a lost ledger: both times they run again
    for lost in ([f"{notes}/commits"], [f"{notes}/commits", f"{path}.ledger"]):
        for folder in lost:
            file = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
            file.getFileSystem(t.spark._jsc.hadoopConfiguration()).delete(file, True)
        streams.land_stream(rows, path, F.timestamp_millis("t_ms"), notes)
    landed = t.spark.read.parquet(path)
    return landed.groupBy((F.col("t_ms") - F.col("t_ms") % HOUR).alias("hour_ms")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@check("t_merge_blocks", f"WITH {MERGE_SQL} SELECT block, side, pos, matched FROM merged")
def _(t):
    names = ["seq", "socket", "connection", "conn_us", "req_us"]
    a = _closed(t, _flows(t).select("flow_id", "socket", "t_us", F.floor(F.col("t_us") / 1000).alias("f_ms")), "f_ms", "flow_ts", socket="-")
    b = _closed(t, _transfers(t).select(*names, F.floor(F.col("req_us") / 1000).alias("t_ms")), "t_ms", "http_ts", socket="-")
    # the batch knows no end of a silent connection
    blocks = stream_merge_blocks(a, b, idle=10**15)
    return _run(t, blocks).where("socket <> '-'").select("block", "side", "pos", "matched")


@check("t_stream_logs", "SELECT event_type AS kind, count(*) AS n FROM {ev} GROUP BY 1")
def _(t):
    path = scratch(t.spark, "landing")
    t["ev"].select(F.concat_ws(" ", F.col("event_id").cast("string"), "event_type")).write.text(path)
    return _run(t, streams.stream_logs(t.spark, path, "id BIGINT, kind STRING", " ", 2)).groupBy("kind").agg(F.count("*").alias("n"))
