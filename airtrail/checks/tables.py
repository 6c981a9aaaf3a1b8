"""Log-shaped views of the given tables, in SQL that Spark and DuckDB both run, and the register of checked queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.url import Suffixes
from ..session import configure

# suffixes of the given hosts, and a few others
SUFFIXES = Suffixes(("com", "org", "net", "cn", "com.cn", "uk", "co.uk"))

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
       "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "ev": """SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
        T_US AS t_us, CAST(floor(T_US / 1e3) AS BIGINT) AS t_ms FROM {events}""",
    # association and authentication events of devices
    "wifi": """SELECT event_id AS seq, '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, t_ms,
        CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 2 WHEN 'error' THEN 1 WHEN 'purchase' THEN 3 ELSE 4 END AS code,
        CASE WHEN event_type <> 'signup' AND k % 13 <> 0 THEN 'B' || CAST(k % 4 AS STRING) END AS ap,
        CASE WHEN event_type <> 'signup' THEN 'MH-B' || CAST(k % 7 AS STRING) || '-' || CAST(k % 4 + 1 AS STRING) || 'F-0' || CAST(k % 3 AS STRING) END AS ap_name,
        CASE WHEN event_type = 'signup' THEN 'u' || CAST(user_id % 50 + k % 2 AS STRING) END AS account,
        CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 3 = 0 THEN '0.0.0.0'
            ELSE '10.184.' || CAST(user_id % 200 AS STRING) || '.' || CAST(k % 3 AS STRING) END END AS ip FROM {ev}""",
    # address allocations (5) and recycles (6)
    "addr": """SELECT event_id AS seq, '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, t_ms,
        CASE WHEN event_id % 3 = 0 THEN 6 ELSE 5 END AS code,
        '10.184.' || CAST(user_id % 200 AS STRING) || '.' || CAST(k % 3 AS STRING) AS ip FROM {ev}""",
    "loc": """SELECT seq, mac, t_ms, ip, CASE WHEN code = 6 THEN 'recycle' ELSE 'alloc' END AS kind FROM {addr}""",
    # movement sessions with address and account
    "moves": """SELECT '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, t_ms AS s_ms, t_ms + k * 600000 AS e_ms,
        'B' || CAST(k % 4 AS STRING) AS ap, '10.184.' || CAST(user_id % 200 AS STRING) || '.' || CAST(event_id % 3 AS STRING) AS ip,
        'u' || CAST(user_id % 50 AS STRING) AS account FROM {ev}""",
    "ip_spans": """SELECT '10.184.' || CAST(user_id % 20 AS STRING) || '.' || CAST(k % 3 AS STRING) AS ip,
        '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, t_ms AS atime, t_ms + k * 300000 AS rtime FROM {ev}""",
    "ap_spans": """SELECT '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, 'B' || CAST(k % 4 AS STRING) AS ap, t_ms AS start_ms,
        t_ms + k * 900000 AS end_ms FROM {ev}""",
    "asks": """SELECT event_id AS seq, '10.184.' || CAST(user_id % 20 AS STRING) || '.' || CAST(k % 3 AS STRING) AS ip,
        '00' || lpad(CAST(user_id AS STRING), 10, '0') AS mac, t_ms FROM {ev}""",
    "req": """SELECT *, event_id % (SELECT count(*) FROM {pages}) AS page, (event_id + 999999 - k % 3) % (SELECT count(*) FROM {pages}) AS ref_page,
        '10.184.' || CAST(user_id % 200 AS STRING) || '.' || CAST(k % 3 AS STRING) AS source_ip,
        '93.184.' || CAST(k % 4 AS STRING) || '.10' AS dest_ip, CAST(1024 + user_id % 100 AS INT) AS source_port,
        CAST(floor(event_id / 8e0) AS BIGINT) % 6 AS agent_no FROM {ev}""",
    # request log, the columns of the 38 that carry something
    "http": """SELECT r.event_id AS seq, r.source_ip, r.source_port, r.dest_ip, CAST(80 AS INT) AS dest_port,
        CASE r.event_id % 5 WHEN 0 THEN 'start' WHEN 1 THEN 'continue' WHEN 2 THEN 'last' WHEN 3 THEN 'unique' ELSE 'other' END AS connection,
        CASE WHEN r.event_id % 5 IN (0, 3) THEN (r.t_us - 500000) / 1e6 END AS connection_ts,
        CASE WHEN r.event_id % 97 <> 0 THEN r.t_us / 1e6 END AS request_ts, (r.k % 5) / 1e2 AS request_time,
        CASE WHEN r.event_id % 11 <> 0 THEN (r.t_us + (r.k % 10) * 100000) / 1e6 END AS response_ts, 1e-1 AS response_time_begin,
        CASE WHEN r.event_id % 17 <> 0 THEN (r.k % 50) / 1e1 END AS response_time_end,
        CASE WHEN r.event_id % 89 <> 0 THEN CAST(200 + r.k AS BIGINT) END AS request_size,
        CASE WHEN r.event_id % 13 <> 0 THEN CAST(floor(r.value * 100) AS BIGINT) END AS response_size,
        CASE WHEN r.k % 10 = 0 THEN p.url ELSE regexp_extract(p.url, '^https?://[^/]+(/.*)$', 1) END AS request_url,
        CASE WHEN r.event_id % 53 <> 0 THEN 'HTTP/1.1' END AS request_protocol,
        CASE WHEN r.event_id % 61 <> 0 THEN regexp_extract(p.url, '^https?://([^/]+)', 1) END AS request_host,
        CASE r.agent_no WHEN 0 THEN 'Mozilla/5.0 (iphone; CPU OS 7)' WHEN 1 THEN 'Dalvik (Linux; android 4.4) phone' WHEN 2 THEN 'Mozilla/5.0 (X11; Linux)'
            WHEN 3 THEN 'Opera opera mini ipad' WHEN 4 THEN 'curl/7.0 bb10 mobile' END AS request_user_agent,
        CASE WHEN r.event_id % 3 <> 0 THEN q.url END AS request_referer,
        CASE WHEN r.k % 4 = 0 THEN 'image/png' WHEN r.k % 4 = 1 THEN NULL ELSE 'text/html' END AS response_content_type
        FROM {req} r JOIN {pages} p ON p.page_id = r.page JOIN {pages} q ON q.page_id = r.ref_page""",
    "tcp": """SELECT event_id AS flow_id, CASE WHEN event_id % 2 = 0 THEN source_ip ELSE dest_ip END AS client_ip,
        CASE WHEN event_id % 2 = 0 THEN source_port ELSE 80 END AS client_port, CASE WHEN event_id % 2 = 0 THEN dest_ip ELSE source_ip END AS server_ip,
        CASE WHEN event_id % 2 = 0 THEN 80 ELSE source_port END AS server_port, (t_us + (event_id % 7 - 3) * 70000000) / 1e3 AS first_abs_time_ms,
        t_us + (event_id % 7 - 3) * 70000000 AS f_us, CAST(k AS BIGINT) AS c_packets, CASE WHEN event_id % 19 <> 0 THEN CAST(k * 10 AS BIGINT) END AS c_bytes,
        CAST(k % 9 AS BIGINT) AS s_packets, CAST(floor(value * 10) AS BIGINT) AS s_bytes, t_ms FROM {req} WHERE event_id % 4 <> 1""",
    "udp": """SELECT event_id AS flow_id, CASE WHEN event_id % 3 = 0 THEN dest_ip ELSE source_ip END AS client_ip, CAST(k % 5 AS BIGINT) AS c_packets,
        CAST(k * 3 AS BIGINT) AS c_bytes, CAST(k % 4 AS BIGINT) AS s_packets, CAST(floor(value) AS BIGINT) AS s_bytes, t_ms FROM {req} WHERE event_id % 4 = 1""",
    "dpi": """SELECT event_id, source_ip, source_port, dest_ip, CAST(80 AS INT) AS dest_port, (t_us + (event_id % 5 - 2) * 35000000) / 1e6 AS ts,
        t_us + (event_id % 5 - 2) * 35000000 AS dpi_us, CASE WHEN event_id % 4 = 0 THEN 'UDP' ELSE 'TCP' END AS l4,
        CAST(k % 12 AS STRING) || '/' || CASE WHEN k % 12 = 0 THEN 'Unknown' ELSE 'P' || CAST(k % 12 AS STRING) END AS detected,
        CASE WHEN k % 12 = 0 THEN 'Unknown' ELSE 'P' || CAST(k % 12 AS STRING) END AS proto_name, CAST(k + 1 AS BIGINT) AS packets,
        CAST(floor(value * 7) AS BIGINT) AS bytes, t_ms, CASE WHEN event_id % 2 = 0 THEN event_id ELSE -event_id END AS dpi_no FROM {req}""",
    "profiles": """SELECT 'u' || CAST(c_custkey % 60 AS STRING) AS account, 'p' || CAST(c_custkey AS STRING) AS id,
        CASE WHEN c_nationkey % 2 = 0 THEN 'F' ELSE 'M' END AS sex, CAST(1980 + c_nationkey AS STRING) AS birth, '2013' AS eduy FROM {customer}""",
}

# Small lookups of our own for the checked queries.
RULES = [(1, r"blog\.th", "blogs"), (2, "spam-farm", "spam"), (3, r"^m\.", "mobile"), (4, r"example\.org", "org"),
         (5, r"th.*r\.example", "thr"), (6, r"cheap-pills\.", "pills"), (7, "tion", "tion"), (8, "therou|thering", "ther")]
CLASSES = [("blogs", 1, 100), ("spam", 2, 200), ("mobile", 1, 101), ("org", 3, 300), ("thr", 4, 400), ("pills", 9, 900)]
CLASS_NAMES = [(1, "reading"), (2, "bad"), (3, "portal")]
BUILDINGS = [("B", "Campus", "Area", "All", 1.0, 2.0), ("B0", "Library", "Lib", "PUB", 1.5, 2.5), ("B1", "Lab", "Acad", "CS", 1.6, 2.6),
             ("B3", "Gym", "Sport", "PUB", 1.7, 2.7), ("B4", "Hall", "Dorm", "STU", 1.8, 2.8)]
COUNTRIES = [("com", "Commercial"), ("org", "Organisation"), ("de", "Germany")]
PROTOCOLS = [(i, f"P{i}" if i else "Unknown", ("Other", "Web", "Mail", "Net")[i % 4]) for i in range(10)]


def values(rows, columns: str) -> str:
    """A lookup as a DuckDB table expression."""
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)}) AS x({columns}))"


LOOKUPS_SQL = {"rules": values(RULES, "rule_no, regex, category"), "classes": values(CLASSES, "category, cls1, cls2"),
               "class_names": values(CLASS_NAMES, "cls1, name"), "buildings": values(BUILDINGS, 'code, name, "type", "user", lon, lat'),
               "countries": values(COUNTRIES, "suffix, country"), "protocols": values(PROTOCOLS, "id, name, category")}


class Tables:
    """Given tables and views of a data folder, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.made = configure(spark), folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in RAW:
                self.made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = VIEWS[name].replace("T_US", "unix_micros(CAST(ts AS TIMESTAMP))")
                self.made[name] = self.spark.sql(text, **{d: self[d] for d in needs(text)})
        return self.made[name]

    def lookup(self, name: str) -> DataFrame:
        """One of the small lookups."""
        rows, ddl = {"classes": (CLASSES, "category STRING, cls1 INT, cls2 INT"), "class_names": (CLASS_NAMES, "cls1 INT, name STRING"),
                     "buildings": (BUILDINGS, "code STRING, name STRING, type STRING, user STRING, lon DOUBLE, lat DOUBLE"),
                     "suffixes": ([(s, "plain") for s in SUFFIXES.plain], "suffix STRING, kind STRING"),
                     "countries": (COUNTRIES, "suffix STRING, country STRING"), "protocols": (PROTOCOLS, "id INT, name STRING, category STRING")}[name]
        return self.spark.createDataFrame(rows, ddl)


def needs(text: str) -> list[str]:
    """Names a view is made from."""
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def duck(body: str) -> str:
    """A DuckDB query over views and lookups named in ``{}``; further ``WITH`` parts may follow in the body."""
    order: list[str] = []

    def visit(name: str):
        if name in VIEWS:
            for d in needs(VIEWS[name]):
                visit(d)
            if name not in order:
                order.append(name)

    for name in needs(body):
        visit(name)
    parts = [f"{n} AS ({VIEWS[n].replace('T_US', 'epoch_us(ts)').format(**{d: d for d in needs(VIEWS[n])})})" for n in order]
    parts += [f"{n} AS {LOOKUPS_SQL[n]}" for n in needs(body) if n in LOOKUPS_SQL]
    text = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if text.upper().startswith(start):
            text = (start + ", ".join(parts) + ", " if parts else start) + text[len(start):]
            break
    else:
        text = ("WITH " + ", ".join(parts) + " " if parts else "") + text
    return text


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    """Register a query on ``Tables`` under a name, with its DuckDB counterpart when SQL can say it."""
    def keep(make: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: make(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = duck(sql)
        return make
    return keep
