"""Typed projections and row filters of request, flow and event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.times import capture_number, parse_double, parse_long
from ..functions.url import mobile_type, strip_url

ASSOCIATION_CODES = (0, 1, 2, 3)
IP_CODES = (5, 6)
AUTH_CODES = (4,)


def valid_http(df: DataFrame) -> DataFrame:
    """Requests with a port, a parseable time, a size and a host."""
    return df.where(
        F.col("source_port").isNotNull() & F.col("request_size").isNotNull() & F.col("request_host").isNotNull()
        & (F.coalesce(F.col("request_ts").try_cast("double"), F.lit(-1.0)) != -1)
    )


def clean_http(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Clean requests: ip, stime, etime (ms), size, mobile, host.

    A request without response ends at its start; a missing size counts as 0; every ``www.`` leaves the host.
    """
    start = F.col("request_ts").try_cast("double")
    reply = F.coalesce(F.col("response_ts").try_cast("double"), start)
    lasts = parse_double(F.col("response_time_end"), 0.0)
    return valid_http(df).select(
        *keep, F.col("source_ip").alias("ip"), F.floor(start * 1000).alias("stime"),
        F.floor((reply + lasts) * 1000).alias("etime"),
        (parse_long(F.col("request_size"), 0) + parse_long(F.col("response_size"), 0)).alias("size"),
        mobile_type(F.col("request_user_agent")).alias("mobile"),
        F.replace("request_host", F.lit("www."), F.lit("")).alias("host"),
    )


def classified(df: DataFrame, provider: str = "sp") -> DataFrame:
    """Rows whose host has a known service."""
    return df.where(F.col(provider).isNotNull())


def clean_http_strict(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The stricter cleaner: seven columns must be there, start times are whole seconds, host must be known."""
    needed = ("source_port", "request_ts", "response_ts", "response_time_begin", "response_time_end", "request_size", "response_size")
    whole = df.dropna(subset=list(needed))
    begin = F.floor(capture_number(F.col("request_ts").cast("string"))) if dict(df.dtypes)["request_ts"] == "string" else F.floor("request_ts")
    reply = F.floor(capture_number(F.col("response_ts").cast("string"))) if dict(df.dtypes)["response_ts"] == "string" else F.floor("response_ts")
    rows = whole.select(
        *keep, F.col("source_ip").alias("ip"),
        F.coalesce(F.regexp_extract(F.col("source_port").cast("string"), r"(\d+)", 1).try_cast("int"), F.lit(-1)).alias("sport"),
        (begin * 1000).alias("stime"),
        F.floor((reply + parse_double(F.col("response_time_end"))) * 1000).alias("etime"),
        (parse_long(F.col("request_size")) + parse_long(F.col("response_size"))).alias("size"),
        F.col("request_host").alias("host"), strip_url(F.col("request_url")).alias("url"),
        F.col("request_user_agent").alias("user_agent"), F.col("request_referer").alias("referrer"),
    )
    return rows.where("sport > 0 AND stime > 0 AND etime > 0 AND size >= 0 AND host IS NOT NULL")


def by_codes(df: DataFrame, codes, code: str = "code") -> DataFrame:
    """Events of a set of codes."""
    return df.where(F.col(code).isin(*codes))


def sane_sessions(df: DataFrame, start: str = "sstime", end: str = "setime") -> DataFrame:
    """Sessions that end after 0 and not before they start."""
    return df.where((F.col(end) > 0) & (F.col(end) >= F.col(start)))


def transfer_rows(df: DataFrame) -> DataFrame:
    """Requests fit for matching with flows: an HTTP protocol name, a known position and a request time."""
    return df.where(
        F.substring("request_protocol", 1, 9).contains("HTTP")
        & F.col("connection").isin("start", "continue", "last", "unique")
        & F.col("request_ts").isNotNull() & (F.col("request_ts") != 0)
    )


def without_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all the named columns."""
    return df.dropna(subset=columns)


def published_columns(df: DataFrame) -> DataFrame:
    """The twelve published columns, in order."""
    return df.select("id", "location", "stime", "sdur", "sps", "scats", "hosts", "bytes", "requests", "sex", "birth", "eduy")


def building_events(events: DataFrame, buildings: DataFrame) -> DataFrame:
    """Clean events as the movement job wants them: association rows carry the building instead of the access
    point (null when unknown), authentications without an address carry 0.0.0.0, address rows only the address."""
    from .lookups import add_building

    named = add_building(events, "ap", buildings, fields=("name",), prefix="building_")
    association = F.col("code").isin(*ASSOCIATION_CODES)
    rest = [c for c in events.columns if c not in ("ap", "ip")]
    return named.select(
        *rest, F.when(association, F.col("building_name")).alias("ap"),
        F.when(F.col("code") == AUTH_CODES[0], F.coalesce("ip", F.lit("0.0.0.0"))).when(
            F.col("code").isin(*IP_CODES), F.col("ip")).alias("ip"),
    )
