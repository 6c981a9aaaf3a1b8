"""Fixed input layouts, as DDL text."""

HTTP_FIELDS = (
    "source_ip STRING, source_port INT, dest_ip STRING, dest_port INT, connection STRING, "
    "connection_ts DOUBLE, close_ts DOUBLE, connection_time DOUBLE, idle_time_0 DOUBLE, "
    "request_ts DOUBLE, request_time DOUBLE, response_ts DOUBLE, response_time_begin DOUBLE, "
    "response_time_end DOUBLE, idle_time_1 DOUBLE, request_size BIGINT, response_size BIGINT"
)

# Field order of the request log (38), its short form (25) and the flow logs.
HTTP = HTTP_FIELDS + (
    ", request_method STRING, request_url STRING, request_protocol STRING, request_host STRING, "
    "request_user_agent STRING, request_referer STRING, request_connection STRING, request_keep_alive STRING, "
    "response_protocol STRING, response_code STRING, response_server STRING, response_content_length STRING, "
    "response_content_type STRING, response_content_encoding STRING, response_etag STRING, "
    "response_cache_control STRING, response_last_modified STRING, response_age STRING, "
    "response_expires STRING, response_connection STRING, response_keep_alive STRING"
)

HTTP_LIGHT = HTTP_FIELDS + (
    ", request_method STRING, request_url STRING, request_host STRING, request_user_agent STRING, "
    "request_referrer STRING, response_code INT, response_server STRING, response_ctype STRING"
)

_TCP_SIDE = (
    "ip STRING", "port INT", "packets BIGINT", "rst_sent BIGINT", "ack_sent BIGINT", "pure_ack_sent BIGINT",
    "unique_bytes BIGINT", "data_packets BIGINT", "data_bytes BIGINT", "rexmit_packets BIGINT",
    "rexmit_bytes BIGINT", "out_seq_packets BIGINT", "syn_count BIGINT", "fin_count BIGINT", "ws_sent BIGINT",
    "ts_sent BIGINT", "win_scale BIGINT", "sack_set BIGINT", "sack_sent BIGINT", "mss BIGINT", "max_seg BIGINT",
    "min_seg BIGINT", "max_win BIGINT", "min_win BIGINT", "zero_win BIGINT", "max_cwin BIGINT", "min_cwin BIGINT",
    "init_cwin BIGINT", "rtt_avg DOUBLE", "rtt_min DOUBLE", "rtt_max DOUBLE", "rtt_std DOUBLE",
    "rtt_count BIGINT", "min_ttl BIGINT", "max_ttl BIGINT", "rexmit_rto BIGINT", "rexmit_fr BIGINT",
    "reordered BIGINT", "net_dup BIGINT", "unknown_seg BIGINT", "flow_control BIGINT", "unnece_rto BIGINT",
    "unnece_fr BIGINT", "syn_diff_seq BIGINT",
)
_TCP_FLOW = (
    "duration DOUBLE, first_offset DOUBLE, last_offset DOUBLE, client_first_payload DOUBLE, "
    "server_first_payload DOUBLE, client_last_payload DOUBLE, server_last_payload DOUBLE, "
    "client_first_ack DOUBLE, server_first_ack DOUBLE, first_abs_time_ms DOUBLE, client_internal INT, "
    "server_internal INT, type_mask INT, p2p_type INT, p2p_subtype INT, ed2k_data INT, ed2k_sig INT, "
    "ed2k_c2s INT, ed2k_s2c INT, ed2k_chat INT, http_type INT, ssl_client_hello STRING, ssl_server_hello STRING"
)
_UDP_SIDE = (
    "ip STRING", "port INT", "first_abs_time_ms DOUBLE", "duration DOUBLE", "bytes BIGINT", "packets BIGINT",
    "internal INT", "proto_type INT",
)
TCP = ", ".join([f"{s}_{f}" for s in ("client", "server") for f in _TCP_SIDE] + [_TCP_FLOW])
UDP = ", ".join(f"{s}_{f}" for s in ("client", "server") for f in _UDP_SIDE)
DPI = (
    "source_ip STRING, source_port INT, dest_ip STRING, dest_port INT, ts DOUBLE, l4 STRING, detected STRING, "
    "packets BIGINT, bytes BIGINT"
)
WIFI_EVENT = "mac STRING, t_ms BIGINT, code INT, ap STRING, account STRING, ip STRING"
WIFI_SESSION = "mac STRING, s_ms BIGINT, e_ms BIGINT, ap STRING, ip STRING, account STRING"
PROFILE = "account STRING, id STRING, sex STRING, birth STRING, eduy STRING"
CONTEXT_SESSION = (
    "account STRING, location STRING, stime BIGINT, sdur BIGINT, mobile STRING, sps STRING, scats STRING, "
    "hosts STRING, bytes STRING, requests STRING"
)
AP_TABLE = "code STRING, name STRING, type STRING, user STRING, lon DOUBLE, lat DOUBLE"
TCPTRACE = "conn STRING, host_a STRING, host_b STRING, port_a STRING, port_b STRING"
ADS_MONITOR = (
    "uid STRING, uid_stable SMALLINT, aid STRING, pid STRING, user_agent STRING, os STRING, lang STRING, "
    "ip STRING, time STRING, action STRING"
)
ADS_TRANSFORM = "uid STRING, time STRING"
MOBILITY = "user_id INT, time TIMESTAMP, loc INT"
TRIP = (
    "medallion STRING, hack_license STRING, vendor_id STRING, rate_code INT, store_and_fwd_flag STRING, "
    "pickup_datetime TIMESTAMP, dropoff_datetime TIMESTAMP, passenger_count SMALLINT, trip_time_in_secs INT, "
    "trip_distance DOUBLE, pickup_longitude DOUBLE, pickup_latitude DOUBLE, dropoff_longitude DOUBLE, "
    "dropoff_latitude DOUBLE"
)
FARE = (
    "medallion STRING, hack_license STRING, vendor_id STRING, pickup_datetime TIMESTAMP, payment_type STRING, "
    "fare_amount DOUBLE, surcharge DOUBLE, mta_tax DOUBLE, tip_amount DOUBLE, tolls_amount DOUBLE, total_amount DOUBLE"
)


def names(ddl: str) -> list[str]:
    """Column names of a layout."""
    return [part.split()[0] for part in ddl.split(", ")]


def types(ddl: str) -> list[str]:
    """Column types of a layout."""
    return [part.split()[1] for part in ddl.split(", ")]
