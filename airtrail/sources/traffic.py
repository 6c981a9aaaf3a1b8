"""Request, flow and protocol logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from .lines import parse_delimited, quoted_fields, read_lines, split_once, typed_fields


def parse_http(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """38 typed columns from request-log lines; malformed lines are dropped."""
    return split_once(lines, quoted_fields(F.col(line)), keep).select(*keep, *typed_fields(F.col("_f"), schemas.HTTP, "N/A"))


def bad_http(lines: DataFrame, line: str = "value") -> DataFrame:
    """Request-log lines that do not have the 38 fields."""
    return lines.where(quoted_fields(F.col(line)).isNull())


def read_http_log(spark: SparkSession, path, line: bool = False) -> DataFrame:
    """Request log, 38 columns: space separated, texts quoted, ``N/A`` is null; ``line`` keeps the whole record in a column of that name."""
    rows = read_lines(spark, path).withColumnRenamed("value", "line")
    return parse_http(rows, "line", ("line",) if line else ())


def read_http_csv(spark: SparkSession, path) -> DataFrame:
    """The same log through the CSV reader, for files whose quotes are well formed."""
    return spark.read.schema(schemas.HTTP).csv(path, sep=" ", quote='"', escape='"', nullValue="N/A", mode="DROPMALFORMED")


def parse_http_light(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """25 typed columns from ``|`` separated lines; empty is null."""
    return parse_delimited(lines, schemas.HTTP_LIGHT, "|", line, null="", keep=keep)


def read_http_light(spark: SparkSession, path) -> DataFrame:
    """Short request log, 25 columns."""
    return parse_http_light(read_lines(spark, path))


def parse_tcp(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = (), min_fields: int = 110) -> DataFrame:
    """111 typed columns from flow lines; lines with fewer than ``min_fields`` fields are dropped, missing fields are null.

    Hourly counts of flows take all lines (``min_fields=1``): a line without the numbers counts as a flow only.
    """
    return parse_delimited(lines, schemas.TCP, " ", line, keep=keep, min_fields=min_fields)


def read_tcp_log(spark: SparkSession, path, min_fields: int = 110, line: bool = False) -> DataFrame:
    """TCP flow log, 111 columns; ``line`` keeps the whole record in a column of that name."""
    rows = read_lines(spark, path).withColumnRenamed("value", "line")
    return parse_tcp(rows, "line", ("line",) if line else (), min_fields)


def parse_udp(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """16 typed columns from UDP flow lines."""
    return parse_delimited(lines, schemas.UDP, " ", line, keep=keep)


def read_udp_log(spark: SparkSession, path) -> DataFrame:
    """UDP flow log, 16 columns."""
    return parse_udp(read_lines(spark, path))


def parse_dpi(lines: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed protocol rows. The header and other lines without a byte count, an ``id/name`` or 9 fields are dropped."""
    rows = parse_delimited(lines, schemas.DPI, " ", line, keep=keep, min_fields=9)
    name = F.split("detected", "/")
    return rows.where(F.col("packets").isNotNull() & F.col("bytes").isNotNull() & (F.size(name) >= 2)).withColumns(
        {"proto_id": F.element_at(name, 1).try_cast("int"), "proto_name": F.element_at(name, 2)}
    )


def read_dpi_log(spark: SparkSession, path) -> DataFrame:
    """Protocol log, 9 columns plus the split ``id/name``."""
    return parse_dpi(read_lines(spark, path))


def read_tcptrace(spark: SparkSession, path) -> DataFrame:
    """Connection list of a trace tool: hosts and ports are columns 2 to 5."""
    rows = spark.read.schema(schemas.TCPTRACE).csv(path, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows
