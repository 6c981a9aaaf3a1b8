"""Checked queries: column functions, projections, filters, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import net, spans, text, times, url
from ..operators import cleaning, lookups
from ..session import scratch
from ..sources import tables
from .tables import RULES, SUFFIXES, check

MOBILE = url.MOBILE_WORDS.replace(r"\/", "/")


@check("f_strip_url", r"""SELECT page_id, regexp_extract(url, '^(?:\w+://)?([^\?&]+)\??', 1) AS no_params,
    regexp_extract(url, '^((?:\w+://)?[^&\?]+)\??', 1) AS no_params_proto, regexp_extract(url, '^(?:\w+:?//)?(.*)$', 1) AS no_proto,
    regexp_matches(url, '^\w+:?//') AS has_proto, regexp_extract(url, '^(?:\w+:?//)?([^?&]+)', 1) AS bare FROM {pages}""")
def _(t):
    u = F.col("url")
    return t["pages"].select("page_id", url.strip_params(u).alias("no_params"), url.strip_params_keep_proto(u).alias("no_params_proto"),
                             url.strip_proto(u).alias("no_proto"), url.has_proto(u).alias("has_proto"), url.strip_url(u).alias("bare"))


@check("f_combine_url", r"""SELECT seq, CASE WHEN request_url LIKE 'http%' THEN request_url ELSE request_host || request_url END AS full_url,
    CASE WHEN request_host IS NULL THEN NULL WHEN request_url LIKE 'http%' THEN regexp_replace(request_url, '^\w+://', '') ELSE request_host || request_url END AS entry_url
    FROM {http}""")
def _(t):
    h, u = F.col("request_host"), F.col("request_url")
    return t["http"].select("seq", url.combine_url(h, u).alias("full_url"), url.entry_url(h, u).alias("entry_url"))


@check("f_url_host", r"SELECT page_id, regexp_extract(url, '^(?:\w+:?//)?([^:/?&]+)', 1) AS host FROM {pages}")
def _(t):
    return t["pages"].select("page_id", url.url_host(F.col("url")).alias("host"))


@check("f_url_params", r"""SELECT page_id, unnest(regexp_extract_all(q, '([^?=&]+)=[^?&=]+', 1)) AS name, unnest(regexp_extract_all(q, '[^?=&]+=([^?&=]+)', 1)) AS value
    FROM (SELECT page_id, regexp_extract(url, '\?.*$') AS q FROM {pages})""")
def _(t):
    return t["pages"].select("page_id", F.explode(url.url_params(F.col("url"))).alias("name", "value"))


@check("f_registered_domain", r"""SELECT page_id, regexp_extract(url, '([a-z0-9-]+\.(com|net|org))(/|$)', 1) AS domain FROM {pages}""")
def _(t):
    return t["pages"].select("page_id", url.registered_domain(F.col("url"), SUFFIXES).alias("domain"))


@check("f_registered_domain_rules", r"""SELECT page_id, regexp_extract(url, '([a-z0-9-]+\.(com|net|org))(/|$)', 1) AS domain FROM {pages}""")
def _(t):
    # the last labels of the given hosts among ten thousand rules, in several files
    path = scratch(t.spark, "suffix-rules")
    ends = t["pages"].select(F.regexp_extract("url", r"^https?://[^/]*\.([^./]+)(/|$)", 1).alias("value")).distinct()
    more = t.spark.range(10_000).select(F.concat(F.element_at(F.array(F.lit(""), F.lit("*."), F.lit("!www.")), (F.col("id") % 3 + 1).cast("int")), F.lit("zone"), F.col("id").cast("string")))
    ends.union(more).repartition(4, "value").write.text(path)
    return lookups.add_domain(t["pages"].select("page_id", "url"), "url", tables.read_suffix_rules(t.spark, path)).select("page_id", "domain")


@check("f_url_equal", r"""SELECT p.page_id, regexp_replace(p.url, '^\w+://', '') = regexp_replace(q.url, '^\w+://', '') AS strict,
    regexp_extract(p.url, '^\w+://([^?&]+)', 1) = regexp_extract(q.url, '^\w+://([^?&]+)', 1) AS loose,
    list_contains(['/a', regexp_replace(q.url, '^\w+://', '')], regexp_replace(p.url, '^\w+://', '')) AS inside
    FROM {pages} p JOIN {pages} q ON p.page_id = q.page_id - q.page_id % 2""")
def _(t):
    p, q = t["pages"].select("page_id", F.col("url").alias("a")), t["pages"].select((F.col("page_id") - F.col("page_id") % 2).alias("page_id"), F.col("url").alias("b"))
    a, b = F.col("a"), F.col("b")
    return p.join(q, "page_id").select("page_id", url.url_equal(a, b).alias("strict"), url.url_equal(a, b, loose=True).alias("loose"),
                                       url.url_in(a, F.array(F.lit("/a"), b)).alias("inside"))


@check("f_mobile_type", r"""SELECT seq, coalesce(nullif(regexp_extract(request_user_agent, '""" + MOBILE + r"""'), ''), 'unknown') AS mobile FROM {http}""")
def _(t):
    return t["http"].select("seq", url.mobile_type(F.col("request_user_agent")).alias("mobile"))


@check("f_parse_numbers", r"""SELECT event_id, coalesce(TRY_CAST(substr(props, 7, 1) AS BIGINT), -7) AS first_digit, coalesce(TRY_CAST(event_type AS DOUBLE), 0.5) AS none,
    coalesce(TRY_CAST(regexp_extract(props, '(\d+\.?\d*)', 1) AS DOUBLE), -1) AS captured, coalesce(TRY_CAST(regexp_extract(event_type, '(\d+)', 1) AS DOUBLE), -1) AS missing FROM {events}""")
def _(t):
    return t["events"].select("event_id", times.parse_long(F.substring("props", 7, 1), -7).alias("first_digit"), times.parse_double(F.col("event_type"), 0.5).alias("none"),
                              times.capture_number(F.col("props")).alias("captured"), times.capture_number(F.col("event_type"), r"(\d+)").alias("missing"))


@check("f_iso_time", r"""SELECT event_id, strftime(make_timestamp(t_ms * 1000), '%Y-%m-%d %H:%M:%S') AS iso, t_ms - t_ms % 1000 AS ms,
    'SET' || strftime(make_timestamp(t_ms * 1000), '%y%m') AS month_set, t_ms // 86400000 AS day_no, strftime(date_trunc('hour', make_timestamp(t_ms * 1000)), '%Y-%m-%d %H') AS hour FROM {ev}""")
def _(t):
    iso = times.ms_to_iso(F.col("t_ms"))
    return t["ev"].select("event_id", iso.alias("iso"), times.iso_to_ms(iso).alias("ms"), times.month_key(F.col("t_ms")).alias("month_set"),
                          times.day_of_ms(F.col("t_ms")).alias("day_no"), F.date_format(times.hour_of(F.timestamp_millis("t_ms")), "yyyy-MM-dd HH").alias("hour"))


@check("f_syslog_time", r"""SELECT event_id, t_ms - t_ms % 1000 AS ms, epoch_ms(make_timestamp(CASE WHEN month(m) = 2 AND day(m) = 29 THEN 2012 ELSE 2013 END, month(m), day(m), hour(m), minute(m), second(m))) AS no_year
    FROM (SELECT *, make_timestamp(t_ms * 1000) AS m FROM {ev})""")
def _(t):
    at = F.timestamp_millis("t_ms")
    whole = F.date_format(at, "MMM  d HH:mm:ss yyyy")
    return t["ev"].select("event_id", times.syslog_ms(whole).alias("ms"), times.syslog_ms(F.date_format(at, "MMM d HH:mm:ss")).alias("no_year"))


@check("f_epoch_text", r"SELECT event_id, CAST(floor(t_us / 1e6 * 1e3) AS BIGINT) AS ms, CAST(floor((t_us / 1e3) / 1e3) AS BIGINT) AS s FROM {ev}")
def _(t):
    sec, milli = F.format_string("%d.%06d", F.floor(F.col("t_us") / 1000000), F.col("t_us") % 1000000), F.format_string("%d.%03d", F.col("t_ms"), F.col("t_us") % 1000)
    return t["ev"].select("event_id", F.floor(times.epoch_text(sec) * 1000).alias("ms"), F.floor(times.epoch_text(milli, "ms")).alias("s"))


@check("f_file_name_time", r"""SELECT event_id, t_ms - t_ms % 60000 AS dpi_ms, t_ms - t_ms % 60000 AS flow_ms, t_ms - t_ms % 86400000 AS wifi_ms FROM {ev}""")
def _(t):
    at = F.timestamp_millis("t_ms")

    def ms(name):
        return F.unix_millis(times.file_name_time(name))

    return t["ev"].select("event_id", ms(F.concat(F.date_format(at, "yyyyMMdd-HHmm"), F.lit(".dpi.out.gz"))).alias("dpi_ms"),
                          ms(F.concat(F.date_format(at, "HH_mm_dd_MMM_yyyy"), F.lit(".out"))).alias("flow_ms"),
                          ms(F.concat(F.lit("wifilog"), F.date_format(at, "yyyy-MM-dd"), F.lit(".txt"))).alias("wifi_ms"))


@check("f_ip_long", r"""SELECT event_id, ((10 * 256 + 184) * 256 + user_id % 200) * 256 + k % 3 AS num, source_ip AS back, CAST(NULL AS BIGINT) AS bad FROM {req}""")
def _(t):
    n = net.ip_to_long(F.col("source_ip"))
    return t["req"].select("event_id", n.alias("num"), net.long_to_ip(n).alias("back"), net.ip_to_long(F.concat("source_ip", F.lit(".1"))).alias("bad"))


SOCKET = ("CAST((((10 * 256 + 184) * 256 + user_id % 200) * 256 + k % 3) * CAST(65536 AS BIGINT) + source_port AS STRING) || '-' || "
          "CAST((CAST(((93 * 256 + 184) * 256 + k % 4) AS BIGINT) * 256 + 10) * 65536 + 80 AS STRING)")


@check("f_undirected_socket", f"SELECT event_id, {SOCKET} AS sock, true AS same FROM {{req}}")
def _(t):
    a = [F.col("source_ip"), F.col("source_port")]
    b = [F.col("dest_ip"), F.lit(80)]
    s = net.undirected_socket(*a, *b)
    return t["req"].select("event_id", s.alias("sock"), (s == net.undirected_socket(*b, *a)).alias("same"))


@check("f_socket", "SELECT seq, source_ip || ':' || CAST(source_port AS STRING) || '>' || dest_ip || ':' || CAST(dest_port AS STRING) AS sock FROM {http}")
def _(t):
    s = net.socket(F.col("source_ip"), F.col("source_port"), F.col("dest_ip"), F.col("dest_port"))
    return t["http"].withColumn("s", s).select("seq", F.concat_ws("", "s.source.ip", F.lit(":"), "s.source.port", F.lit(">"), "s.dest.ip", F.lit(":"), "s.dest.port").alias("sock"))


@check("f_direction", r"""SELECT flow_id, CASE WHEN client_ip LIKE '10.184.%' THEN client_ip ELSE server_ip END AS local_ip,
    CASE WHEN split_part(client_ip, '.', 1) = '10' AND CAST(split_part(client_ip, '.', 3) AS INT) < 64 THEN 'client'
         WHEN split_part(server_ip, '.', 1) = '10' AND CAST(split_part(server_ip, '.', 3) AS INT) < 64 THEN 'server'
         WHEN client_ip LIKE '93.184.2.%' OR client_ip LIKE '93.184.3.%' THEN 'server' WHEN server_ip LIKE '93.184.2.%' OR server_ip LIKE '93.184.3.%' THEN 'client' END AS side,
    client_ip LIKE '10.184%' AS is_local FROM {tcp}""")
def _(t):
    c, s = F.col("client_ip"), F.col("server_ip")
    return t["tcp"].select("flow_id", net.local_side_ip(c, s, "10.184").alias("local_ip"), net.direction(c, s, ["10.184.0.0/18"], ["93.184.2.0/23"]).alias("side"),
                           net.is_local(c, r"^10\.184.*").alias("is_local"))


@check("f_small_text", r"""SELECT seq, mac2 AS mac_plain, ctype, suffix FROM (SELECT e.seq, '00' || lpad(CAST(r.user_id AS STRING), 10, '0') AS mac2,
    coalesce(e.response_content_type LIKE '%text%', false) AS ctype, CASE WHEN e.request_url LIKE '%.%' THEN regexp_extract(e.request_url, '\.([^.]*)$', 1) END AS suffix
    FROM {http} e JOIN {req} r ON r.event_id = e.seq)""")
def _(t):
    mac = F.col("mac")
    dotted = F.concat_ws(":", *[F.substring(mac, i, 2) for i in range(1, 12, 2)])
    rows = t["http"].join(t["wifi"].select("seq", "mac"), "seq")
    return rows.select("seq", net.mac_plain(dotted).alias("mac_plain"), text.content_is_text(F.col("response_content_type")).alias("ctype"),
                       text.file_suffix(F.col("request_url")).alias("suffix"))


# the checksum from its definition: eight steps for each of the 256 byte values, one table step a byte
_CRC = """WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS m),
    b AS (SELECT page_id, list_transform(range(1, CAST(octet_length(encode(url)) AS BIGINT) + 1), lambda i: CAST(('0x' || hex(encode(url))[2 * i - 1:2 * i]) AS BIGINT)) AS bytes FROM {pages})
    SELECT page_id, xor(CASE WHEN len(bytes) = 0 THEN 4294967295 ELSE list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, m[xor(c & 255, x) + 1])) END, 4294967295) AS crc FROM b, tab"""


@check("f_crc32", _CRC)
def _(t):
    return t["pages"].select("page_id", text.crc32_text(F.col("url")).alias("crc"))


_SPAN = """s AS (SELECT seq, request_ts AS b, response_ts + response_time_end AS e, request_ts + request_time AS q FROM {http})"""


@check("f_entry_times", f"""WITH {_SPAN} SELECT seq, CAST(floor(q * 1000) AS BIGINT) AS request_end_ms, CAST(floor(e * 1000) AS BIGINT) AS response_end_ms,
    CAST(floor((coalesce(nullif(e, 0), q) - b) * 1000) AS BIGINT) AS duration_ms FROM s""")
def _(t):
    b = F.col("request_ts")
    q, e = spans.request_end(b, F.col("request_time")), spans.response_end(F.col("response_ts"), F.col("response_time_end"))
    return t["http"].select("seq", F.floor(q * 1000).alias("request_end_ms"), F.floor(e * 1000).alias("response_end_ms"),
                            F.floor(spans.entry_duration(b, q, e) * 1000).alias("duration_ms"))


@check("f_span_overlap", f"""WITH {_SPAN} SELECT a.seq, CAST(floor(1000 * (least(coalesce(a.e, a.b + 0.1::DOUBLE), coalesce(z.e, z.b + 0.1::DOUBLE)) - greatest(a.b, z.b))) AS BIGINT) AS shared,
    CAST(floor(1000 * abs(a.b - z.b)) AS BIGINT) AS head, CAST(floor(1000 * abs(coalesce(a.e, a.b + 0.1::DOUBLE) - coalesce(z.e, z.b + 0.1::DOUBLE))) AS BIGINT) AS tail
    FROM s a JOIN s z ON z.seq = a.seq + 1 WHERE a.b IS NOT NULL AND z.b IS NOT NULL""")
def _(t):
    h = t["http"].select("seq", F.col("request_ts").alias("b"), spans.response_end(F.col("response_ts"), F.col("response_time_end")).alias("e")).where("b IS NOT NULL")
    z = h.select((F.col("seq") - 1).alias("seq"), F.col("b").alias("zb"), F.col("e").alias("ze"))
    b, e, zb, ze = (F.col(c) for c in ("b", "e", "zb", "ze"))
    return h.join(z, "seq").select("seq", F.floor(1000 * spans.overlap(b, e, zb, ze)).alias("shared"), F.floor(1000 * spans.head_diff(b, zb)).alias("head"),
                                   F.floor(1000 * spans.tail_diff(b, e, zb, ze)).alias("tail"))


@check("f_measures", """SELECT l_returnflag, round(avg((l_quantity - l_linenumber * 4) ** 2), 4) AS mse, round(sqrt(avg((l_quantity - l_linenumber * 4) ** 2)), 4) AS rmse,
    round(5 * (avg(l_discount) * avg(l_tax)) / (4 * avg(l_discount) + avg(l_tax)), 6) AS f2, round(2 * (avg(l_discount) * avg(l_tax)) / (avg(l_discount) + avg(l_tax)), 6) AS f1
    FROM {lineitem} GROUP BY 1""")
def _(t):
    p, q = F.col("l_quantity"), F.col("l_linenumber") * 4
    a, b = F.avg("l_discount"), F.avg("l_tax")
    return t["lineitem"].groupBy("l_returnflag").agg(F.round(text.mse(p, q), 4).alias("mse"), F.round(text.rmse(p, q), 4).alias("rmse"),
                                                     F.round(text.f_beta(a, b, 2), 6).alias("f2"), F.round(text.f_measure(a, b), 6).alias("f1"))


CLEAN = r"""SELECT seq, source_ip AS ip, CAST(floor(request_ts * 1000) AS BIGINT) AS stime,
    CAST(floor((coalesce(response_ts, request_ts) + coalesce(response_time_end, 0)) * 1000) AS BIGINT) AS etime,
    request_size + coalesce(response_size, 0) AS size, coalesce(nullif(regexp_extract(request_user_agent, '""" + MOBILE + r"""'), ''), 'unknown') AS mobile,
    replace(request_host, 'www.', '') AS host FROM {http} WHERE request_ts IS NOT NULL AND request_size IS NOT NULL AND request_host IS NOT NULL"""
STRICT = r"""SELECT seq, source_ip AS ip, source_port AS sport, CAST(floor(request_ts) AS BIGINT) * 1000 AS stime,
    CAST(floor((floor(response_ts) + response_time_end) * 1000) AS BIGINT) AS etime, request_size + response_size AS size, request_host AS host,
    regexp_extract(request_url, '^(?:\w+:?//)?([^?&]+)', 1) AS url, request_user_agent AS user_agent, request_referer AS referrer FROM {http}
    WHERE request_ts IS NOT NULL AND response_ts IS NOT NULL AND response_time_end IS NOT NULL AND request_size IS NOT NULL AND response_size IS NOT NULL AND request_host IS NOT NULL"""


@check("p_clean_http", CLEAN)
def _(t):
    return cleaning.clean_http(t["http"], keep=("seq",))


@check("p_clean_http_strict", STRICT)
def _(t):
    return cleaning.clean_http_strict(t["http"], keep=("seq",))


@check("p_clean_field", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS field FROM {ev}""")
def _(t):
    quoted = F.when(F.col("event_id") % 3 == 0, F.lit('"N/A"')).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    return t["ev"].select("event_id", text.clean_field(quoted).alias("field"))


@check("p_event_codes", "SELECT code, count(*) AS n FROM (SELECT code FROM {wifi} WHERE code IN (0, 1, 2, 3) UNION ALL SELECT code FROM {addr}) x GROUP BY 1")
def _(t):
    both = cleaning.by_codes(t["wifi"], cleaning.ASSOCIATION_CODES).select("code").unionByName(cleaning.by_codes(t["addr"], cleaning.IP_CODES).select("code"))
    return both.groupBy("code").agg(F.count("*").alias("n"))


@check("p_sane_sessions", "SELECT seq, stime AS sstime, etime - 2000 AS setime FROM (" + CLEAN + ") c WHERE etime - 2000 > 0 AND etime - 2000 >= stime")
def _(t):
    rows = cleaning.clean_http(t["http"], keep=("seq",)).select("seq", F.col("stime").alias("sstime"), (F.col("etime") - 2000).alias("setime"))
    return cleaning.sane_sessions(rows)


@check("p_transfer_rows", "SELECT seq FROM {http} WHERE request_protocol LIKE '%HTTP%' AND connection IN ('start', 'continue', 'last', 'unique') AND request_ts IS NOT NULL")
def _(t):
    return cleaning.transfer_rows(t["http"]).select("seq")


_CLASS = r"""hosts AS (SELECT DISTINCT host FROM (""" + CLEAN + r""") c), first AS (SELECT host, arg_min(category, rule_no) AS category FROM hosts, {rules} WHERE regexp_matches(host, regex) GROUP BY 1),
    svc AS (SELECT h.host, f.category AS sp, coalesce(n.name, CAST(c.cls1 AS VARCHAR)) AS scat, CAST(c.cls2 AS VARCHAR) AS scat2 FROM hosts h LEFT JOIN first f USING (host)
    LEFT JOIN {classes} c ON c.category = f.category LEFT JOIN {class_names} n ON n.cls1 = c.cls1)"""


@check("j_service", f"WITH {_CLASS} SELECT c.seq, c.host, s.sp, s.scat, s.scat2 FROM ({CLEAN}) c LEFT JOIN svc s USING (host)")
def _(t):
    rows = cleaning.clean_http(t["http"], keep=("seq",)).select("seq", "host")
    return lookups.add_service(rows, "host", RULES, t.lookup("classes"), t.lookup("class_names"))


@check("p_classified", f"WITH {_CLASS} SELECT s.sp, count(*) AS n, CAST(sum(c.size) AS BIGINT) AS bytes FROM ({CLEAN}) c JOIN svc s USING (host) WHERE s.sp IS NOT NULL GROUP BY 1")
def _(t):
    rows = lookups.add_service(cleaning.clean_http(t["http"]), "host", RULES, t.lookup("classes"), t.lookup("class_names"))
    return cleaning.classified(rows).groupBy("sp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


_BUILD = r"""keyed AS (SELECT *, regexp_replace(regexp_replace(ap_name, '-[0-9]+F-.*$', ''), '^MH-', '') AS bkey FROM {wifi}),
    best AS (SELECT bkey, arg_max(b.name, length(code)) AS bname, arg_max(b."type", length(code)) AS btype, arg_max(b."user", length(code)) AS buser, CAST(arg_max(b.lat, length(code)) AS DOUBLE) AS blat
    FROM (SELECT DISTINCT bkey FROM keyed WHERE bkey IS NOT NULL) k JOIN {buildings} b ON contains(k.bkey, b.code) GROUP BY 1)"""


@check("j_building", f"WITH {_BUILD} SELECT seq, ap_name, bname AS building_name, btype AS building_type, buser AS building_user, blat AS building_lat FROM keyed LEFT JOIN best USING (bkey)")
def _(t):
    return lookups.add_building(t["wifi"].select("seq", "ap_name"), "ap_name", t.lookup("buildings"), ("name", "type", "user", "lat"))


@check("p_building_events", f"""WITH {_BUILD} SELECT seq, mac, t_ms, code, account, CASE WHEN code < 4 THEN bname END AS ap, CASE WHEN code = 4 THEN coalesce(ip, '0.0.0.0') END AS ip
    FROM keyed LEFT JOIN best USING (bkey)""")
def _(t):
    ev = t["wifi"].select("seq", "mac", "t_ms", "code", F.col("ap_name").alias("ap"), "account", F.when(F.col("ip") != "0.0.0.0", F.col("ip")).alias("ip"))
    return cleaning.building_events(ev, t.lookup("buildings"))


@check("j_protocol", """SELECT d.event_id, p.name AS proto, p.category AS proto_category FROM {dpi} d LEFT JOIN {protocols} p ON p.id = CAST(split_part(d.detected, '/', 1) AS INT)""")
def _(t):
    rows = t["dpi"].select("event_id", F.split("detected", "/")[0].cast("int").alias("proto_id"))
    return lookups.add_protocol(rows, "proto_id", t.lookup("protocols")).drop("proto_id")


@check("j_protocols_of", """SELECT category, count(*) AS flows, min(ids) AS ids, min(names) AS names FROM (SELECT d.event_id, p.category FROM {dpi} d JOIN {protocols} p
    ON p.id = CAST(split_part(d.detected, '/', 1) AS INT)) x JOIN (SELECT category, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, string_agg(name, ',' ORDER BY id) AS names
    FROM {protocols} GROUP BY 1) c USING (category) GROUP BY 1""")
def _(t):
    rows = t["dpi"].select(F.split("detected", "/")[0].cast("int").alias("proto_id"))
    used = lookups.add_protocol(rows, "proto_id", t.lookup("protocols")).where("proto_category IS NOT NULL").groupBy(F.col("proto_category").alias("category")).agg(F.count("*").alias("flows"))
    lists = lookups.protocols_of(t.lookup("protocols"))
    return used.join(lists, "category").select("category", "flows", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.array_join("names", ",").alias("names"))


@check("j_host_country", r"""SELECT page_id, CASE WHEN host = reg THEN '' ELSE substr(host, 1, length(host) - length(reg) - 1) END AS subdomain, split_part(reg, '.', 1) AS "domain",
    regexp_extract(reg, '\.(.*)$', 1) AS suffix, coalesce(country, 'unknown') AS country
    FROM (SELECT page_id, regexp_extract(url, '://([^:/?&]+)', 1) AS host, regexp_extract(url, '([a-z0-9-]+\.(com|net|org))(/|$)', 1) AS reg FROM {pages}) h
    LEFT JOIN {countries} c ON c.suffix = regexp_extract(reg, '([^.]*)$', 1)""")
def _(t):
    parts = lookups.host_parts(t["pages"].select("page_id", "url"), "url", SUFFIXES).drop("url")
    return lookups.add_country(parts, F.col("suffix"), t.lookup("countries"))


@check("j_file_category", r"""SELECT seq, c.category AS file_category FROM {http} h LEFT JOIN (SELECT suffix, arg_min(category, pri) AS category FROM
    (VALUES ('html', 'web', 2), ('html', 'text', 3), ('com', 'executable', 1)) v(suffix, category, pri) GROUP BY 1) c
    ON c.suffix = CASE WHEN h.request_url LIKE '%.%' THEN regexp_extract(h.request_url, '\.([^.]*)$', 1) END""")
def _(t):
    cats = t.spark.createDataFrame([("html", "web", 2), ("html", "text", 3), ("com", "executable", 1)], "suffix STRING, category STRING, priority INT")
    return lookups.add_file_category(t["http"].select("seq", "request_url"), "request_url", cats).drop("request_url")


@check("j_profiles", "SELECT m.mac, m.s_ms, m.account, p.id, p.sex FROM {moves} m JOIN {profiles} p USING (account)")
def _(t):
    return lookups.join_profiles(t["moves"].select("mac", "s_ms", "account"), t["profiles"].select("account", "id", "sex"))


@check("j_in_both", "SELECT account FROM {moves} INTERSECT SELECT account FROM {profiles}")
def _(t):
    return lookups.in_both(t["moves"], t["profiles"], "account")


@check("o_top_k", """SELECT ip, seq, size FROM (SELECT *, row_number() OVER (PARTITION BY ip ORDER BY size DESC, seq) AS rn FROM (""" + CLEAN + """) c) x WHERE rn <= 3""")
def _(t):
    return lookups.top_k(cleaning.clean_http(t["http"], keep=("seq",)), ["ip"], [F.desc("size"), F.asc("seq")], 3).select("ip", "seq", "size")


@check("o_global_sort", "SELECT mac, s_ms, e_ms FROM {moves} ORDER BY mac, s_ms")
def _(t):
    return t["moves"].select("mac", "s_ms", "e_ms").orderBy("mac", "s_ms")


@check("u_distinct", "SELECT DISTINCT mac, account, ip FROM {wifi} WHERE code = 4")
def _(t):
    return cleaning.by_codes(t["wifi"], cleaning.AUTH_CODES).select("mac", "account", "ip").distinct()


@check("u_union_all", "SELECT part, count(*) AS n FROM (SELECT flow_id, 'complete' AS part FROM {tcp} WHERE flow_id % 3 > 0 UNION ALL SELECT flow_id, 'nocomplete' FROM {tcp} WHERE flow_id % 3 = 0) x GROUP BY 1")
def _(t):
    done = t["tcp"].where("flow_id % 3 > 0").select("flow_id", F.lit("complete").alias("part"))
    return done.unionByName(t["tcp"].where("flow_id % 3 = 0").select("flow_id", F.lit("nocomplete").alias("part"))).groupBy("part").agg(F.count("*").alias("n"))
