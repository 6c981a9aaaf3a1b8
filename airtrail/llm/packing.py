"""Best-fit packing of documents into sequences by minimum bin slack."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import lean
from .tokens import encoder

SPREAD = 1024  # rows of one length are counted in so many parts


def cut(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1, whole: bool = False, checksum: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens: ``doc_id, piece, start, length, ids`` (ids packed as little-endian 32-bit numbers), or with
    ``checksum`` the crc32 of the packed ids, ``ids_crc32``, in their place.

    A document is its ids and then ``end``; a null or empty text is ``end`` alone. Rows are documents: a repeated row is
    packed again, a null doc_id stays null. Other columns are not read.
    """
    def run(batches):
        words = encoder(tokenizer, whole)
        encode = words.encode
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows: list[list] = [[], [], [], [], []]
            held = 0
            for doc, raw in zip(ids, encode(batch.column("text").to_pylist())):
                raw += closing
                for k, at in enumerate(range(0, len(raw), 4 * size)):
                    part = raw[at : at + 4 * size]
                    for column, value in zip(rows, (doc, k, at // 4, len(part) // 4, zlib.crc32(part) if checksum else part)):
                        column.append(value)
                    held += len(part)
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
                    rows, held = [[], [], [], [], []], 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=names)
        words.rest()

    names = ["doc_id", "piece", "start", "length", "ids_crc32" if checksum else "ids"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64() if checksum else pa.binary()]
    last = "ids_crc32 long" if checksum else "ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run, "encoders"), f"doc_id long, piece int, start long, length long, {last}")


def fullest(available: np.ndarray, most: int) -> list[int]:
    """Lengths, each used up to ``available`` times, whose sum is the largest that does not pass ``most``.

    Subset sums are the bits of one whole number: adding a length is a shift. Lengths are taken from the longest down with the
    number of copies split into powers of two, and the steps that filled the sum are walked back.
    """
    full = (1 << (most + 1)) - 1
    reach, steps = 1, []
    for length in np.flatnonzero(available[: most + 1])[::-1].tolist():
        if length == 0:
            continue
        left = min(int(available[length]), most // length)
        part = 1
        while left:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            part *= 2
        if reach >> most & 1:
            break
    total, used = reach.bit_length() - 1, []
    for length, take, before in reversed(steps):
        if not before >> total & 1:  # this sum needs the step
            total -= length * take
            used += [length] * take
    return used


def plan(counts: np.ndarray, size: int) -> list[tuple[list[int], int]]:
    """Bins for ``counts[length]`` pieces: (lengths in one sequence, how many such sequences).

    Each bin takes the longest piece left and the fullest combination of the others beside it. The same bin is repeated while
    the counts allow; after that some length has run short, so the number of different bins depends on ``size``, not on the data.
    """
    left, bins = counts.copy(), []
    for longest in range(size, 0, -1):
        while left[longest]:
            left[longest] -= 1
            used = [longest, *fullest(left, size - longest)]
            left[longest] += 1
            lengths, copies = np.unique(used, return_counts=True)
            times = int((left[lengths] // copies).min())
            left[lengths] -= copies * times
            bins.append((used, times))
    return bins


def place(parts: DataFrame, size: int = 4096) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``doc_id, piece, length``.

    Only the number of pieces of each length, at most ``size`` numbers whatever the data, goes to the driver, where the bins are
    planned. A piece finds its bin by its rank among those of its length; ranks are counted in ``SPREAD`` hashed parts, so that
    a length shared by very many pieces is split. Pieces with equal doc_id and piece stand in any order. An empty table gives an
    empty result.
    """
    spark = parts.sparkSession
    rows = parts.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SPREAD)))
    sizes = rows.groupBy("length", "_part").agg(F.count("*").alias("n"))
    counts = np.zeros(size + 1, np.int64)
    for length, n in parts.groupBy("length").count().collect():
        counts[length] = n
    table, number = [], 0
    upto = np.zeros(size + 1, np.int64)
    for used, times in plan(counts, size):
        at = 0
        lengths, copies = np.unique(used, return_counts=True)
        for length, copy in zip(lengths[::-1].tolist(), copies[::-1].tolist()):
            table.append((length, int(upto[length]), int(upto[length]) + copy * times, copy, number, at))
            upto[length] += copy * times
            at += length * copy
        number += times
    fields = "length long, _from long, _to long, _copies long, _bin long, _at long"
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "_part").orderBy("doc_id", "piece")
    ranked = rows.withColumn("_row", F.row_number().over(within) - 1).join(starts, ["length", "_part"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row"))
    # the intervals of all lengths are as few as the bins planned; size bounds them
    spans = spark.createDataFrame(table, fields).groupBy("length").agg(F.array_sort(F.collect_list(F.struct("_from", "_to", "_copies", "_bin", "_at"))).alias("_spans"))
    found = ranked.join(F.broadcast(spans), "length").withColumn(
        "_span", F.filter("_spans", lambda s: (s["_from"] <= F.col("_rank")) & (F.col("_rank") < s["_to"]))[0])
    place_in = F.col("_rank") - F.col("_span._from")
    copies = F.col("_span._copies")
    return found.select(
        *parts.columns, (F.col("_span._bin") + F.floor(place_in / copies)).cast("long").alias("sequence_id"),
        (F.col("_span._at") + F.pmod(place_in, copies) * F.col("length")).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """Packed pieces with their ids: ``doc_id, piece, start, length, ids, sequence_id, offset``.

    Texts are encoded once and written to the shared folder.
    """
    return place(settle(cut(docs, tokenizer, size, end), "pieces"), size)


def digests(docs: DataFrame, tokenizer: str, size: int = 4096, end: int = 1) -> DataFrame:
    """The same with the ids' crc32 in their place, so that ids are neither written nor shuffled."""
    return place(settle(cut(docs, tokenizer, size, end, checksum=True), "pieces"), size)
