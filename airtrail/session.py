"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # a generated method over 8000 bytes is never compiled by the JVM; smaller pieces are
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # batches for Python are cut by rows; whole documents are long
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    # plans with tables as literals are not written out whole into the logs
    "spark.sql.maxPlanStringLength": "100000",
    # streams: session pieces are merged before the shuffle, state lives on disk instead of the heap
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build(app: str = "airtrail", master: str | None = None, partitions: int | None = None) -> SparkSession:
    """A session with the settings above; the master stays the cluster's own unless one is named."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return configure(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Log times are read in UTC and skewed joins are split at run time."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in ``spark.checkpoint.dir``, inside the open run folder if there is one.

    Executors must all see that folder, so there is no default for it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "/".join([root.rstrip("/"), *_runs[-1:], f"{name}-{uuid.uuid4().hex}"])


_runs: list[str] = []


@contextmanager
def run_folder(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables made inside the block lie in one folder of the run, which is deleted at its end.

    Results must be written before the block ends: they read those tables.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    name = f"run-{uuid.uuid4().hex}"
    _runs.append(name)
    try:
        yield f"{root.rstrip('/')}/{name}"
    finally:
        _runs.remove(name)
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared folder and read them back.

    For rows that several later steps read: they are made once, the plan behind them is cut, and a lost executor costs
    only its own tasks.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_apart(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``settle`` of what ``make()`` gives; all tables it has written on its way are deleted."""
    path = scratch(spark, name)
    with run_folder(spark):
        df = make()
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
