"""Typed logs landed by date and hour, so that jobs read the period they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.times import file_name_time


def land(df: DataFrame, path: str, ts: Column, mode: str = "append") -> None:
    """Append rows as Parquet in folders ``date=yyyy-MM-dd/hour=HH`` of their time; a null time lands in the default folders.

    Rows are rebalanced by folder: a busy hour is split over tasks, quiet hours share one.
    """
    placed = df.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH")})
    placed.hint("rebalance", "date", "hour").write.mode(mode).partitionBy("date", "hour").parquet(path)


def read_period(spark: SparkSession, path: str, begin: str, end: str) -> DataFrame:
    """Landed rows of the hours from ``begin`` to before ``end`` (``yyyy-MM-dd HH``); other folders are not opened."""
    at = F.concat_ws(" ", "date", "hour")
    days = (F.col("date") >= begin[:10]) & (F.col("date") <= end[:10])
    rows = spark.read.option("inferSchema", "false").schema(_plain(spark, path)).parquet(path)
    return rows.where(days & (at >= begin) & (at < end))


def _plain(spark: SparkSession, path: str) -> str:
    """The landed columns with text partitions: hours keep their leading zero."""
    schema = spark.read.parquet(path).schema
    return ", ".join(f"`{f.name}` {'string' if f.name in ('date', 'hour') else f.dataType.simpleString()}" for f in schema)


def named_files(spark: SparkSession, path: str, begin: str | None = None, end: str | None = None) -> DataFrame:
    """Lines of log files with the time their names stand for (``file_time``), of the files in a period only."""
    files = spark.read.option("recursiveFileLookup", "true").text(path)
    timed = files.select(file_name_time(F.col("_metadata.file_name")).alias("file_time"), "value")
    if begin is not None:
        timed = timed.where(F.col("file_time") >= F.lit(begin).cast("timestamp"))
    return timed if end is None else timed.where(F.col("file_time") < F.lit(end).cast("timestamp"))
