"""Repeated passages: winnowed anchors as seeds, extension both ways, maximal repeats over a length."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import bytes_of, mix, pieces, prefix, stretch, word_hashes

NEVER = (1 << 63) - 1  # stands for a null doc_id, which is no smaller than any other


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value in every window of ``width`` values, the first one among equals."""
    place, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = place[: len(place) - step], place[step:]
        place = np.where(values[right] < values[left], right, left)
        have += step
    return place


def seeds(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all texts: (text number, anchor hash, hash of all words its windows span, first window, number of windows).

    Every window of ``length`` words has the smallest of its ``gram``-word hashes as its anchor, so equal windows have equal
    anchors at equal places. Windows that follow each other and share an anchor are one row; its span reaches from the first
    word of the first window to the last word of the last one, the farthest that the anchor is extended to either side.
    """
    words, at = word_hashes(texts)
    n = len(words)
    if n < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    sums = prefix(words)
    start = np.arange(n - gram + 1)
    grams = stretch(sums, start, start + gram)
    anchor = smallest_in(grams, length - gram + 1)  # of the window that starts here
    begin = np.arange(len(anchor))
    owner = np.searchsorted(at, begin, "right") - 1
    whole = begin + length <= at[owner + 1]  # windows inside one text
    begin, anchor, owner = begin[whole], anchor[whole], owner[whole]
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(begin), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    number = np.diff([*first, len(begin)])
    s, a = begin[first], anchor[first]
    around = mix(stretch(sums, s, s + number + length - 1) + (a - s).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return owner[first], grams[a].view(np.int64), around.view(np.int64), s - at[owner[first]], number


def repeats(docs: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """Spans ``doc_id, text_key, first, last`` of words whose windows of ``length`` words also start in a smaller doc_id.

    Seeds: each text's anchors. Occurrences of a seed whose farthest extension is equal match as a whole with the smallest
    document of theirs. What is left, one occurrence of each different extension, is extended window by window: the windows of
    the seed are joined by hash and again the smallest document wins. That is enough, because the smallest document that holds
    a window is the first with its extension. Work is linear in the occurrences; no pairs are formed. ``first`` to ``last``
    (excluded) count words; overlapping spans are merged by ``remove``.
    """
    keyed = with_keys(docs)

    def find(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("text").to_pylist()
            key = batch.column("text_key").to_numpy()
            for a, b in pieces(texts):
                owner, anchor, around, first, number = seeds([bytes_of(t) for t in texts[a:b]], length, gram)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a:b][owner], key[a:b][owner], anchor, around, first.astype(np.int32), number.astype(np.int32))],
                    names=["id", "text_key", "anchor", "around", "first", "number"])

    found = settle(keyed.mapInArrow(find, "id long, text_key long, anchor long, around long, first int, number int"), "seeds")
    sides = found.groupBy("anchor", "around").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    many = sides.groupBy("anchor").agg((F.count("*") > 1).alias("open"), F.min("least").alias("_a"), F.max("most").alias("_b")).filter("_a <> _b")
    sides = sides.join(many.select("anchor", "open"), "anchor").filter("open OR least <> most").select("anchor", "around", "least", "open")
    hit = settle(found.join(sides, ["anchor", "around"]).filter("id > least OR open").select(
        "id", "text_key", "anchor", "first", "number", (F.col("id") > F.col("least")).alias("whole")), "matches")
    whole = hit.filter("whole").select("id", "text_key", "first", (F.col("first") + F.col("number") + length - 1).alias("last"))

    left = hit.filter("NOT whole").groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "number", "anchor")).alias("places"))

    def extend(batches):
        for batch in batches:
            ids, texts = batch.column("id").to_numpy(), batch.column("text").to_pylist()
            key, places = batch.column("text_key").to_numpy(), batch.column("places")
            for a, b in pieces(texts):
                words, at = word_hashes([bytes_of(t) for t in texts[a:b]])
                part = places.slice(a, b - a)
                rows = part.flatten()
                owner = np.repeat(np.arange(b - a), part.value_lengths().to_numpy())
                first, number, anchor = (rows.field(i).to_numpy() for i in range(3))
                start = np.repeat(first, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                owner, anchor = np.repeat(owner, number), np.repeat(anchor, number)
                spot = at[owner] + start
                window = stretch(prefix(words), spot, spot + length).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (ids[a:b][owner], key[a:b][owner], anchor, window, start.astype(np.int32))], names=["id", "text_key", "anchor", "window", "first"])

    opened = keyed.join(left, ["id", "text_key"]).select("id", "text_key", "text", "places").dropDuplicates(["id", "text_key"])
    windows = settle(opened.mapInArrow(extend, "id long, text_key long, anchor long, window long, first int"), "windows")
    least = windows.groupBy("anchor", "window").agg(F.min("id").alias("least"), F.max("id").alias("_most")).filter("least <> _most")
    partly = windows.join(least, ["anchor", "window"]).filter("id > least").select("id", "text_key", "first", (F.col("first") + length).alias("last"))
    return whole.union(partly).select(F.when(F.col("id") != NEVER, F.col("id")).alias("doc_id"), "text_key", "first", "last")


def with_keys(docs: DataFrame) -> DataFrame:
    """Rows with an id that is never null and a hash of the text, which tells rows of one doc_id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NEVER)).alias("id"), F.xxhash64("text").alias("text_key"), "text")


def remove(docs: DataFrame, length: int = 50, gram: int = 10) -> DataFrame:
    """``doc_id, n_words, repeats, kept_text`` of every row of ``docs (doc_id, text)``.

    ``repeats array<struct<first, last>>`` are the maximal runs of words covered by windows of ``length`` words that also start in
    a document with a smaller doc_id; ``kept_text`` are the other words joined by one space. Words are runs without ASCII white
    space, unchanged. A null text has no words. Of rows with one doc_id none is smaller; a null doc_id is larger than all others.
    Other columns are not read.
    """
    spans = repeats(docs, length, gram).select(F.coalesce("doc_id", F.lit(NEVER)).alias("id"), "text_key", "first", "last")
    spans = spans.groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = with_keys(docs).join(spans, ["id", "text_key"], "left").select("id", "text", "spans")
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), pa.string()]

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column("text").to_pylist(), batch.column("spans")
            for a, b in pieces(texts):
                counts, merged, kept = [], [], []
                for i in range(a, b):
                    words = bytes_of(texts[i]).split()
                    counts.append(len(words))
                    runs = []
                    if spans[i].is_valid:
                        pairs = spans[i].values
                        begin, end = pairs.field(0).to_numpy(), pairs.field(1).to_numpy()
                        mark = np.zeros(len(words) + 1, np.int64)
                        np.add.at(mark, begin, 1)
                        np.add.at(mark, end, -1)
                        inside = np.cumsum(mark[:-1]) > 0
                        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
                        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
                    merged.append([{"first": x, "last": y} for x, y in runs])
                    for x, y in reversed(runs):
                        del words[x:y]
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                columns = [batch.column("id").slice(a, b - a).to_pylist(), counts, merged, kept]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "n_words", "repeats", "kept_text"])

    out = joined.mapInArrow(cut, "id long, n_words long, repeats array<struct<first:int,last:int>>, kept_text string")
    return out.select(F.when(F.col("id") != NEVER, F.col("id")).alias("doc_id"), "n_words", "repeats", "kept_text")
