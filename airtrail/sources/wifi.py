"""Wireless controller logs and derived session files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.net import mac_plain
from ..functions.times import iso_to_ms, syslog_ms

AUTH_REQUEST, DEAUTH, ASSOC_REQUEST, DISASSOC, USER_AUTH, IP_ALLOC, IP_RECYCLE, ROAM, NEW_DEVICE = range(9)

# Message numbers of each event.
CODES = {
    AUTH_REQUEST: (501091, 501092, 501109),
    DEAUTH: (501105, 501080, 501098, 501099, 501106, 501107, 501108, 501111),
    ASSOC_REQUEST: (501095, 501096, 501097),
    DISASSOC: (501102, 501104, 501113),
    USER_AUTH: (522008, 522042, 522038),
    IP_ALLOC: (522006, 522026),
    IP_RECYCLE: (522005,),
    ROAM: (500010,),
    NEW_DEVICE: (522035,),
}

# Pieces and forms of the messages.
TIME = r"(\w+\s+\d+\s+(?:\d{1,2}:){2}\d{1,2}(?:\s+\d{4})?)"
MAC = r"((?:[0-9a-f]{2}:){5}[0-9a-f]{2})"
IP = r"((?:\d{1,3}\.){3}\d{1,3})"
CAMPUS_IP = r"((?:111\.\d+|10\.18[4-8])(?:\.\d+){2})"
AP_NAME = r"([\w-]+)"
AP_INFO = r"((?:\d{1,3}\.){3}\d{1,3})-((?:[0-9a-f]{2}:){5}[0-9a-f]{2})-([\w-]+)"
ROAM_INFO = r"([\w-]+)/((?:[0-9a-f]{2}:){5}[0-9a-f]{2})/(\w+)"


def _forms(ip_range: str) -> dict[int, tuple[str, str]]:
    """Event -> pattern, and its groups as time, MAC, access point, account, address (``-`` where it has none)."""
    device = "1 2 5 - -"
    return {
        AUTH_REQUEST: (rf"(?i){TIME}(?:.*)Auth\s+request:\s+{MAC}:?\s+(?:.*)AP\s+{AP_INFO}", device),
        DEAUTH: (rf"(?i){TIME}(?:.*)Deauth(?:.*):\s+{MAC}:?\s+(?:.*)AP\s+{AP_INFO}", device),
        ASSOC_REQUEST: (rf"(?i){TIME}(?:.*)Assoc(?:.*):\s+{MAC}(?:.*):?\s+(?:.*)AP\s+{AP_INFO}", device),
        DISASSOC: (rf"(?i){TIME}(?:.*)Disassoc(?:.*):\s+{MAC}:?\s+AP\s+{AP_INFO}", device),
        USER_AUTH: (rf"(?i){TIME}(?:.*)\s+username=([^\s]+)\s+MAC={MAC}\s+IP={IP}(?:.+)", "1 3 - 2 4"),
        IP_ALLOC: (rf"(?i){TIME}(?:.*)MAC={MAC}\s+IP={ip_range}", "1 2 - - 3"),
        IP_RECYCLE: (rf"(?i){TIME}(?:.*)MAC={MAC}\s+IP={ip_range}", "1 2 - - 3"),
        ROAM: (rf"{TIME}(?:.*)Station\s+{MAC},\s+(?:{IP})?:\s+(?:.*)\s+AP\s+{AP_NAME},\s+{ROAM_INFO}", "1 2 4 - 3"),
        NEW_DEVICE: (rf"{TIME}(?:.*)MAC={MAC} Station UP: BSSID={MAC} ESSID={AP_NAME} (?:.*)AP-name={AP_NAME}", device),
    }


def parse_wifi_syslog(lines: DataFrame, line: str = "value", ip_range: str = CAMPUS_IP, keep: tuple[str, ...] = (), default_year: int = 2013) -> DataFrame:
    """Controller messages as clean events: mac, t_ms, code, ap, account, ip.

    The message number stands behind the second ``<`` and starts with 5; other lines give no row. A line is matched
    once, by the pattern of its number, and all groups come out of that match. Allocations and recycles of addresses outside
    ``ip_range`` give no row. ``default_year`` is the year of times without one.
    """
    mark = "\n"  # never inside a line
    number = F.regexp_extract(line, r"^[^<]*<[^<]*<(5\d*)>", 1).try_cast("int")
    numbered = lines.select(*keep, F.col(line).alias("_line"), number.alias("_n"))
    found = F.lit(None).cast("string")
    for event, (pattern, groups) in _forms(ip_range).items():
        flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
        cells = mark.join("" if g == "-" else f"${g}" for g in groups.split())
        taken = F.regexp_replace("_line", f"(?s){flag}^.*?{body}.*$", f"{event}{mark}{cells}")
        found = F.when(F.col("_n").isin(*CODES[event]), taken).otherwise(found)
    fields = numbered.where(F.col("_n").isNotNull()).select(*keep, F.split(found, mark).alias("_f"))

    def text(i: int):
        return F.nullif(F.col("_f")[i], F.lit(""))

    event = F.struct(
        mac_plain(text(2)).alias("mac"), syslog_ms(text(1), default_year).alias("t_ms"), F.col("_f")[0].cast("int").alias("code"),
        text(3).alias("ap"), text(4).alias("account"), text(5).alias("ip"),
    )
    return fields.select(*keep, F.inline(F.when(F.size("_f") == 6, F.array(event)))).where(F.col("t_ms").isNotNull())


def read_wifi_sessions(spark: SparkSession, path) -> DataFrame:
    """Movement sessions: mac, start, end, access point, IP, account."""
    return spark.read.schema(schemas.WIFI_SESSION).csv(path, nullValue="null")


def parse_location_log(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed rows of a location log: kind ``alloc``, ``recycle``, ``auth`` or ``assoc``.

    Allocation lines are ``mac time ipallocation ip``, association lines ``mac start end duration ap``.
    """
    mac = F.regexp_extract(line, r"^([^\t]+)\t", 1)
    rest = F.regexp_extract(line, r"^[^\t]+\t(.*)$", 1)
    rows = lines.where(F.trim(line) != "").select(*keep, mac.alias("mac"), F.rtrim(rest).alias("_r"))
    kind = (
        F.when(F.col("_r").rlike("(?i)ipallocation"), "alloc")
        .when(F.col("_r").rlike("(?i)iprecycle"), "recycle")
        .when(F.col("_r").rlike("(?i)userauth"), "auth")
        .otherwise("assoc")
    )
    marks = r"(?i)^(.*?)(?:ipallocation|iprecycle)(.*)$"
    cells = F.split("_r", "\t")
    is_ip = F.col("kind").isin("alloc", "recycle")
    is_ap = F.col("kind") == "assoc"
    blank = "\t "
    return rows.withColumn("kind", kind).select(
        *keep, "mac", "kind",
        F.when(is_ip, iso_to_ms(F.btrim(F.regexp_extract("_r", marks, 1), F.lit(blank)))).when(
            is_ap, iso_to_ms(F.try_element_at(cells, F.lit(1)))).alias("t_ms"),
        F.when(is_ip, F.btrim(F.regexp_extract("_r", marks, 2), F.lit(blank))).alias("ip"),
        F.when(is_ap, iso_to_ms(F.try_element_at(cells, F.lit(2)))).alias("end_ms"),
        F.when(is_ap, F.try_element_at(cells, F.lit(4))).alias("ap"),
    )


def read_location_log(spark: SparkSession, path) -> DataFrame:
    """Location log files."""
    from .lines import read_lines

    return parse_location_log(read_lines(spark, path))
