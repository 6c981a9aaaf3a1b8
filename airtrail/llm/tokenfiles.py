"""Flat token files: documents written one after another, and found again by a scan for the end-of-document id."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import encoder

KINDS = {2: "<u2", 4: "<u4"}


def write(docs: DataFrame, path: str, tokenizer: str, end: int, width: int = 2) -> None:
    """Writes the ids of all texts as flat files of little-endian numbers of ``width`` bytes, each text closed by ``end``.

    A null text is an empty document. The files hold nothing else. ``end`` must be an id that no text gives and, because the
    writer sets it between rows as a separator, one whose bytes are ASCII.
    """
    mark = end.to_bytes(width, "little")
    if not mark.isascii():
        raise ValueError("the bytes of the end id must be ASCII")

    def run(batches):
        encode = encoder(tokenizer).encode
        for batch in batches:
            out = []
            for raw in encode(batch.column("text").to_pylist()):
                ids = np.frombuffer(raw, "<u4")
                if (ids == end).any() or (ids >> 8 * width).any():
                    raise ValueError(f"a text gives the end id {end} or an id of more than {width} bytes")
                out.append(ids.astype(KINDS[width]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    docs.select("text").mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("lineSep", mark.decode("ascii")).text(path)


def scan(spark: SparkSession, path: str, end: int, width: int = 2, block: int = 1 << 20) -> DataFrame:
    """``file, document, start, length, closed`` of every document in the token files below ``path``.

    A file is cut into blocks of ``block`` ids, which are searched one by one, a vector at a time. For each block only its number
    of ends and its last end are summed up over the blocks before it; with them the first document of a block gets its
    start and number, so a document may span any number of blocks. ``document`` counts from 0 in its file, ``start`` is the
    place of its first id, ``length`` excludes the end. Ids behind the last end are a document that is not closed. An empty file
    has no document, an empty document has length 0. A file of up to 2 GB is read as one value, as Spark's reader of binary
    files does; bytes beyond a whole id at the end of a file are an error.
    """
    files = spark.read.format("binaryFile").load(path).filter("length > 0")
    size = block * width
    blocks = files.select(
        F.col("path").alias("file"), "length", "content", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / size))).alias("block"))
    blocks = blocks.select("file", "length", "block", F.col("content").substr((F.col("block") * size + 1).cast("int"), F.lit(size)).alias("ids"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                file, length, number, raw = (batch.column(c)[i].as_py() for c in ("file", "length", "block", "ids"))
                if length % width:
                    raise ValueError(f"{file}: {length} bytes are not whole ids")
                at = np.flatnonzero(np.frombuffer(raw, KINDS[width]) == end) + number * block
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([length // width]), pa.array([number], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["file", "total", "block", "ends"])

    found = blocks.mapInArrow(run, "file string, total long, block long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # the prefix scan: documents closed so far and the last end so far
    carried = found.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn(
        "last", F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1).cast("long")))
    tail = (F.col("block") + 1) * block >= F.col("total")
    ends = F.when(tail & (F.coalesce(F.array_max("ends"), F.col("last")) < F.col("total") - 1), F.concat("ends", F.array("total"))).otherwise(F.col("ends"))
    starts = F.concat(F.array(F.col("last") + 1), F.transform("ends", lambda e: e + 1))
    listed = carried.select("file", "total", "done", starts.alias("starts"), F.posexplode(ends).alias("i", "e"))
    start = F.element_at("starts", F.col("i") + 1)
    return listed.select(
        "file", (F.col("done") + F.col("i")).cast("long").alias("document"), start.alias("start"), (F.col("e") - start).alias("length"), (F.col("e") < F.col("total")).alias("closed"))
