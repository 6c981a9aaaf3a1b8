"""Time columns: epoch numbers, log time text, buckets and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp (a zone-less one is read in the session zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def iso_to_ms(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` to epoch milliseconds; null when it does not parse."""
    return F.unix_millis(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def ms_to_iso(ms: Column) -> Column:
    """Epoch milliseconds to ``yyyy-MM-dd HH:mm:ss``."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss")


def syslog_ms(text: Column, default_year: int = 2013) -> Column:
    """``Jan 31 00:06:12 2014`` to epoch milliseconds; a missing year is ``default_year``, on 29 February the last leap year up to it."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    leap = next(y for y in range(default_year, 0, -1) if y % 4 == 0 and (y % 100 or y % 400 == 0))
    year = F.when(flat.rlike(r"(?i)^feb 29 "), F.lit(f" {leap}")).otherwise(F.lit(f" {default_year}"))
    full = F.when(flat.rlike(r"\d{4}$"), flat).otherwise(F.concat(flat, year))
    return F.unix_millis(F.try_to_timestamp(full, F.lit("MMM d H:m:s yyyy")))


def parse_long(text: Column, default: int | None = None) -> Column:
    """Whole number in a text, or the default."""
    return F.coalesce(text.try_cast("long"), F.lit(default).cast("long"))


def parse_double(text: Column, default: float | None = None) -> Column:
    """Number in a text, or the default."""
    return F.coalesce(text.try_cast("double"), F.lit(default).cast("double"))


def capture_number(text: Column, pattern: str = r"(\d+\.?\d*)", default: int = -1) -> Column:
    """Number a pattern captures in a text, else the default."""
    return F.coalesce(F.regexp_extract(text, pattern, 1).try_cast("double"), F.lit(float(default)))


def epoch_text(text: Column, unit: str = "s") -> Column:
    """Epoch text with any fraction to seconds; ``unit`` is ``s`` or ``ms``."""
    value = text.try_cast("double")
    return value / 1000.0 if unit == "ms" else value


def day_of_ms(ms: Column) -> Column:
    """UTC day number."""
    return F.floor(ms / DAY_MS)


def hour_of(ts: Column) -> Column:
    """Hour a timestamp falls in."""
    return F.date_trunc("hour", ts)


def month_key(ms: Column) -> Column:
    """Output set name of a month, e.g. ``SET1405``."""
    return F.concat(F.lit("SET"), F.date_format(F.timestamp_millis(ms), "yyMM"))


# Time formats used in the names of hourly and daily log files.
FILE_NAME_TIMES = (
    (r"(\d{8}-\d{4})", "yyyyMMdd-HHmm"),
    (r"(\d{2}_\d{2}_\d{2}_[A-Za-z]{3}_\d{4})", "HH_mm_dd_MMM_yyyy"),
    (r"wifilog(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
)


def file_name_time(name: Column) -> Column:
    """Time a log file name stands for, in any of the three forms in use."""
    return F.coalesce(
        *[F.try_to_timestamp(F.nullif(F.regexp_extract(name, p, 1), F.lit("")), F.lit(f)) for p, f in FILE_NAME_TIMES]
    )
