"""Logs as streams: hourly files as they land, merged flows, hourly statistics, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.matching import merge_flows
from ..operators.sessions import http_connections
from ..operators.stats import direction_counts, protocol_breakdown
from .flows import stream_pairs


def stream_logs(spark: SparkSession, path: str, schema: str | None = None, sep: str = " ", files_per_trigger: int | None = None) -> DataFrame:
    """New log files of a folder as a stream: raw lines, or typed columns with a layout."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path) if schema is None else reader.schema(schema).csv(path, sep=sep)


def stream_merge_flows(tcp: DataFrame, http: DataFrame, tol: str = "180 seconds", delay: str = "5 minutes") -> DataFrame:
    """Full outer match of flows and transfers by socket and time.

    ``tcp`` has flow_id, socket, flow_ts; ``http`` seq, socket, http_ts (timestamps), either may hold more columns. State is held
    only as long as a partner can still come; a row without one is sent once the watermark has passed it.
    """
    left, right = tcp.withColumnRenamed("socket", "tcp_socket"), http.withColumnRenamed("socket", "http_socket")
    return stream_pairs(left, right, ("tcp_socket", "http_socket"), ("flow_ts", "http_ts"), interval_us(tol), delay)


def interval_us(text: str) -> int:
    """Microseconds of a length of time like ``180 seconds``."""
    number, unit = text.split()
    return round(float(number) * {"millisecond": 1e3, "second": 1e6, "minute": 6e7, "hour": 3.6e9}[unit.rstrip("s")])


def best_matches(pairs: DataFrame, tol: int = 180_000_000) -> DataFrame:
    """Blocks of the finished hours of ``stream_merge_flows``, as the batch makes them: every flow and every transfer once.

    A pair says only that two rows can belong together; the rows are taken apart again, transfers are numbered into
    connections, and a flow goes to the connection the batch would choose. ``pairs`` carries t_us of the flow and connection,
    conn_us and req_us of the transfer.
    """
    tcp = pairs.where(F.col("flow_id").isNotNull()).select("flow_id", F.col("tcp_socket").alias("socket"), "t_us").dropDuplicates(["flow_id"])
    sent = pairs.where(F.col("seq").isNotNull()).select("seq", F.col("http_socket").alias("socket"), "connection", "conn_us", "req_us").dropDuplicates(["seq"])
    return merge_flows(tcp, http_connections(sent, "socket", "req_us", "connection", "seq"), tol)


def stream_protocol_hours(dpi: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Hourly protocol statistics of a stream of protocol rows."""
    return protocol_breakdown(dpi.withWatermark(ts, delay), F.window(ts, "1 hour")).select(
        F.col("hour.start").alias("hour"), "l4", "l7", "flows", "packets", "bytes")


def stream_direction_hours(flows: DataFrame, inside: Column, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Hourly flows, packets and bytes up and down of a stream (l4, c_packets, c_bytes, s_packets, s_bytes), counted as in a batch."""
    counts = [value.alias(name) for name, value in direction_counts(inside).items()]
    hours = flows.withWatermark(ts, delay).groupBy(F.window(ts, "1 hour").alias("_w"), "l4").agg(*counts)
    return hours.select(F.col("_w.start").alias("hour"), "l4", "flows", "packets_up", "packets_down", "bytes_up", "bytes_down")


def stream_sessionize(requests: DataFrame, key: str, ts: str = "ts", gap: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of a stream of requests with their number and bytes."""
    return requests.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("_w"), key).agg(
        F.count("*").alias("requests"), F.sum("size").alias("bytes"), F.max(ts).alias("last")
    ).select(key, F.col("_w.start").alias("start"), "last", "requests", "bytes")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into Parquet files and stop; a restart goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(
        availableNow=True).start()
    query.awaitTermination()


def land_stream(stream: DataFrame, path: str, ts: Column, checkpoint: str, ledger: str | None = None) -> None:
    """Land what is there of a stream below ``date=/hour=/batch=`` folders of its rows' time, each row once whatever fails, and stop.

    A batch writes its own folders and replaces them when it is run again, so a batch that was written but not yet noted by the stream leaves no row twice. A
    batch whose number stands in the ledger (a folder beside the data, by default) was finished and is not written again.
    """
    ledger = ledger or path.rstrip("/") + ".ledger"
    spark = stream.sparkSession

    def done(number: int):
        file = spark._jvm.org.apache.hadoop.fs.Path(f"{ledger}/{number}")
        return file, file.getFileSystem(spark._jsc.hadoopConfiguration())

    def put(batch: DataFrame, number: int) -> None:
        file, system = done(number)
        if system.exists(file):
            return
        placed = batch.withColumns({"date": F.date_format(ts, "yyyy-MM-dd"), "hour": F.date_format(ts, "HH"), "batch": F.lit(number)})
        writer = placed.hint("rebalance", "date", "hour").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("date", "hour", "batch").parquet(path)
        system.mkdirs(file)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
