"""Text lines from plain or gzip files, and typed columns from delimited lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .. import schemas
from ..functions.url import let


def read_lines(spark: SparkSession, path, name_regex: str | None = None, match: bool = True,
               tolerant_gzip: bool = False) -> DataFrame:
    """Lines of text files, compressed or not by suffix, as ``value``.

    ``name_regex`` walks folders and keeps files by name, ignoring case: from the start of the name, or anywhere
    with ``match=False``. ``tolerant_gzip`` keeps what gzip files with wrong checksums, cut ends or damaged members still hold; where the store
    allows it a file is inflated as a stream, whatever its size.
    """
    reader = spark.read.format("binaryFile" if tolerant_gzip else "text")
    if name_regex is not None:
        reader = reader.option("recursiveFileLookup", "true")
    files = reader.load(path)
    if name_regex is not None:
        anchor = "^" if match else ""
        files = files.where(F.col("_metadata.file_name").rlike(f"(?i){anchor}(?:{name_regex})"))
    if tolerant_gzip:
        if _scheme(spark, path) in STREAMED:
            return files.select("path").repartition(max(1, min(files.count(), 10_000)), "path").mapInPandas(_inflate_path, "value STRING")
        return files.select("content").mapInPandas(_inflate, "value STRING")
    return files.select("value")


STREAMED = ("file", "hdfs", "s3", "gs")  # stores that a Python worker opens by itself; of others a task reads a file as one value


def _scheme(spark: SparkSession, path) -> str:
    file = spark._jvm.org.apache.hadoop.fs.Path(path if isinstance(path, str) else path[0])
    return file.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()


def _inflate_path(batches):
    """Unpack files read from their store piece by piece."""
    import pandas as pd
    from pyarrow import fs

    from . import members

    for batch in batches:
        for path in batch["path"]:
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_stream(name, compression=None) as file:
                for some in members.lines(members.inflate(file.read)):
                    yield pd.DataFrame({"value": some})


def _inflate(batches):
    """Unpack whole files."""
    from io import BytesIO

    import pandas as pd

    from . import members

    for batch in batches:
        for content in batch["content"]:
            for some in members.lines(members.inflate(BytesIO(content).read)):
                yield pd.DataFrame({"value": some})


def ordered_lines(spark: SparkSession, path) -> DataFrame:
    """Lines with their place: file, start of the file split, position inside the split.

    ``(file, split, pos)`` is the order of lines in the file, also for a file read by many tasks.
    """
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("pos"), "value",
    )


def trace_lines(spark: SparkSession, path, tie: Column | None = None) -> DataFrame:
    """Lines of many trace files as one trace: file, line_no (from 0, going on over files in the order of their names, or of ``tie``, a
    column of ``file``), value.

    Lines are numbered inside each file split; one row a split carries how many stand before it, so no file and no trace goes through one task.
    """
    rows = ordered_lines(spark, path)
    rows = rows.withColumn("_file", F.struct((tie if tie is not None else F.col("file")).alias("at"), F.col("file").alias("file")))
    before = Window.orderBy("_file", "split").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_file", "split").agg(F.count("*").alias("n"), F.min("pos").alias("_first"))
    # a split is read by one task in order, so positions inside it are consecutive
    starts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("_file", "split", "_first", "_before")
    return rows.join(starts, ["_file", "split"]).select("file", (F.col("_before") + F.col("pos") - F.col("_first")).alias("line_no"), "value")


def split_good_bad(df: DataFrame, n_fields: int, sep: str = " ", line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines with the right number of fields, and the others."""
    good = F.coalesce(F.size(F.split(F.col(line), _quote(sep))) == n_fields, F.lit(False))
    return df.where(good), df.where(~good)


def arity_counts(df: DataFrame, n_fields: int, sep: str = " ", line: str = "value") -> DataFrame:
    """One row: all lines, good ones, bad ones."""
    good = F.coalesce(F.size(F.split(F.col(line), _quote(sep))) == n_fields, F.lit(False))
    return df.agg(F.count("*").alias("lines"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"))


def _quote(sep: str) -> str:
    return "".join(f"\\{c}" if c in r".^$*+?()[]{}|\\" else c for c in sep)


def typed_fields(fields: Column, ddl: str, null: str | None = None) -> list[Column]:
    """Columns of a layout from an array of field texts; a field that does not parse, or is ``null``, becomes null."""
    out = []
    for i, (name, kind) in enumerate(zip(schemas.names(ddl), schemas.types(ddl))):
        text = F.try_element_at(fields, F.lit(i + 1))
        if kind != "STRING":
            text = text.try_cast(kind.lower())
        elif null is not None:
            text = F.nullif(text, F.lit(null))
        out.append(text.alias(name))
    return out


def parse_delimited(df: DataFrame, ddl: str, sep: str, line: str = "value", null: str | None = None,
                    keep: tuple[str, ...] = (), min_fields: int | None = None, max_fields: int | None = None) -> DataFrame:
    """Typed columns from unquoted delimited lines; lines with a wrong number of fields are dropped."""
    n = len(schemas.names(ddl))
    parts = F.split(F.col(line), _quote(sep))
    good = F.size(parts) >= (n if min_fields is None else min_fields)
    if max_fields is not None or min_fields is None:
        good = good & (F.size(parts) <= (n if max_fields is None else max_fields))
    return split_once(df, F.when(good, parts), keep).select(*keep, *typed_fields(F.col("_f"), ddl, null))


def split_once(df: DataFrame, fields: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose field array is not null, as ``_f``. A generator keeps the split from being repeated per column."""
    return df.select(*keep, F.explode(F.array_compact(F.array(fields))).alias("_f"))


def read_delimited(spark: SparkSession, path, ddl: str, sep: str) -> DataFrame:
    """Delimited table files with a declared layout (ads ``^``; mobility traces, trips, fares ``,``)."""
    return spark.read.schema(ddl).csv(path, sep=sep)


def read_avro(spark: SparkSession, path) -> DataFrame:
    """Avro files; needs the Avro module on the session's class path."""
    return spark.read.format("avro").load(path)


def quoted_fields(line: Column) -> Column:
    """38 field texts of a request-log line: 18 before the first ``" "``, then 20 quoted ones; null when they differ."""
    def of_parts(parts: Column) -> Column:
        good = (F.size(parts) == 21) & (F.size(F.split(parts[0], " ")) == 18)
        return F.when(good, F.transform(F.concat(F.split(parts[0], " "), F.slice(parts, 2, 20)), lambda x: F.replace(x, F.lit('"'), F.lit(""))))

    return let(F.split(line, r'"\s"'), of_parts)
