"""Ranked lexical search: an inverted index in blocks, read term by term, rarest first, with limited accumulators.

The index is written once: a block is a stretch of rows of one input partition (about ``BLOCK`` bytes of text), and has one row a term
with the numbers of its documents and the term's occurrences there. Every block ranks its own documents for every item: terms
are taken from the rarest on; each opens accumulators for the documents that hold it until the sum of what the remaining terms can
give at most lies below the k-th best partial score of the block. From then on only the documents with an accumulator are updated, by
all remaining terms, so their scores are exact, and no other document can reach the first k. The k best of each block are
ranked once more over all blocks. Blocks meet no limit on documents, partners or terms; a common term is split over all blocks.

A null text has no terms; a text without terms counts in no statistic and is never found. Rows that repeat a doc_id are ranked one
by one; a null doc_id comes after all others of equal score. Rows of the benchmark with one item_id are one item with the terms of all their texts; a
null item_id is an id like any other. Empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import ascii_lower, bytes_of

BLOCK = 6_000_000  # bytes of text of an index block; a longer text is a block of its own
PART = 500  # items that are ranked together in a block
SCALE = 1_000_000_000
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# ASCII letters in lower case, digits and all bytes of other characters stay; the rest parts terms
KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the number of terms up to the end of each text."""
    raw = np.frombuffer(b"\n".join([*texts, b""]).translate(KEPT), np.uint8)
    inside = raw != 32
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    return found, np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))


def postings(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, where each one's postings begin (one more at the end), their text numbers and occurrences; terms of each text."""
    found, upto = terms_of(texts)
    coded = found.dictionary_encode()
    length = np.diff(upto, prepend=0)
    key = coded.indices.to_numpy().astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), length)
    key, count = np.unique(key, return_counts=True)
    begin = np.searchsorted(key, np.arange(len(coded.dictionary) + 1) * len(texts))
    return coded.dictionary, begin, key % max(len(texts), 1), count, length


def index(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows ``block, term, rows, counts`` for the terms of each block, and one row without term a block: ``counts`` are the terms of its documents, ``ids`` their doc_ids."""
    schema = "block long, term binary, rows array<int>, counts array<int>, ids array<long>"
    lists = pa.list_(pa.int32())
    arrow = pa.schema([("block", pa.int64()), ("term", pa.binary()), ("rows", lists), ("counts", lists), ("ids", pa.list_(pa.int64()))])

    def written(number: int, ids: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        terms, begin, rows, counts, length = postings(texts)
        yield pa.RecordBatch.from_pylist([{"block": number, "counts": length.tolist(), "ids": ids}], schema=arrow)
        step = 50_000
        for a in range(0, len(terms), step):
            cut = begin[a : a + step + 1]
            part = slice(cut[0], cut[-1])
            offsets = pa.array(cut - cut[0], pa.int32())
            some = pa.array(terms[a : a + step].cast(pa.binary()), pa.binary())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(some), number)), some, pa.ListArray.from_arrays(offsets, pa.array(rows[part], pa.int32())),
                pa.ListArray.from_arrays(offsets, pa.array(counts[part], pa.int32())), pa.nulls(len(some), pa.list_(pa.int64()))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = bytes_of(text)
                if texts and size + len(raw) > block:
                    yield from written(number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(doc_id)
                texts.append(raw)
                size += len(raw)
        if texts:
            yield from written(number, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, schema)


def item_terms(benchmark: DataFrame) -> DataFrame:
    """Distinct ``item_id, term`` of all items."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    return benchmark.select("item_id", F.explode(found).alias("term")).select("item_id", F.col("term").cast("binary")).distinct()


def best(rows: list[np.ndarray], gains: list[np.ndarray], n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (numbers below n) that can be among the k best, and their exact sums; lists come rarest first."""
    most = np.array([g.max() for g in gains], np.int64)
    rest = np.append(np.cumsum(most[::-1])[::-1], 0)  # what the lists from here on can give at most
    sums, made, survivors = np.zeros(n, np.int64), np.zeros(n, bool), None
    for i, (row, gain) in enumerate(zip(rows, gains)):
        if survivors is None:
            sums[row] += gain
            made[row] = True
            if 2 * rest[i + 1] < rest[0]:  # else no partial score can lie above the rest
                live = sums[made]
                if len(live) >= k and rest[i + 1] < np.partition(live, len(live) - k)[len(live) - k]:
                    survivors = np.flatnonzero(made)
        elif 8 * len(survivors) < len(row):
            at = np.minimum(np.searchsorted(row, survivors), len(row) - 1)
            hit = row[at] == survivors
            sums[survivors[hit]] += gain[at[hit]]
        else:
            hit = made[row]
            sums[row[hit]] += gain[hit]
    found = np.flatnonzero(made & (sums > 0))
    return found, sums[found]


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, block: int = BLOCK, part: int = PART) -> DataFrame:
    """``item_id, rank, doc_id, score``: the k documents of highest score above 0 for each item, ties to the smaller doc_id."""
    written = settle(index(docs, block), "index")
    blocks, lists = written.filter("term IS NULL"), written.filter("term IS NOT NULL")
    total = blocks.select(F.size(F.filter("counts", lambda n: n > 0)).alias("n"), F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n).alias("l"))
    n_docs, n_terms = total.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("l"), F.lit(0))).first()

    items = item_terms(benchmark)
    n_items = benchmark.select("item_id").distinct().count()
    items = settle(items.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(-(-max(n_items, 1) // part)))), "items")
    held = items.select("term").distinct().join(lists.select("term", F.size("counts").alias("df")), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    weights = settle(held.select("term", weight.alias("weight")), "weights")
    wanted = items.select("part", "term").distinct().join(weights, "term")
    near = lists.select("block", "term", "rows", "counts").join(wanted, "term")
    # every item once a part: the stated queries meet each block that holds one of their terms
    asked = items.join(weights.select("term"), "term").groupBy("part", "item_id").agg(F.collect_list("term").alias("terms"))
    asked = asked.groupBy("part").agg(F.collect_list(F.struct("item_id", "terms")).alias("items"))
    met = lists.select("block", "term").join(wanted.select("term", "part"), "term").select("block", "part").distinct()
    sides = met.join(blocks.select("block", F.col("counts").alias("lengths"), "ids"), "block").join(asked, "part")
    sides = sides.select(F.col("block").alias("of_block"), F.col("part").alias("of_part"), "lengths", "ids", "items")

    kind = benchmark.schema["item_id"].dataType
    arrow_item = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]
    arrow = pa.schema([("item_id", arrow_item), ("doc_id", pa.int64()), ("score", pa.int64()), ("block", pa.int64()), ("place", pa.int32())])

    def ranked(left: pa.Table, right: pa.Table) -> pa.Table:
        lengths = right["lengths"][0].values.to_numpy().astype(np.int64)
        ids = right["ids"][0].as_py()
        slack = 8 * (10 + 90 * lengths * n_docs // n_terms)
        number = {t: i for i, t in enumerate(left["term"].to_pylist())}
        w = left["weight"].to_numpy()
        rows = [left["rows"][i].values.to_numpy() for i in range(len(number))]
        gains = []
        for i, row in enumerate(rows):
            tf = left["counts"][i].values.to_numpy().astype(np.int64)
            gains.append(w[i] * (SCALE * tf // (1000 * tf + slack[row])))
        out = []
        for item in right["items"][0].as_py():
            terms = sorted((number[t] for t in item["terms"] if t in number), key=lambda i: (-w[i], len(rows[i])))
            if not terms:
                continue
            found, score = best([rows[i] for i in terms], [gains[i] for i in terms], len(lengths), k)
            if len(found) > k:
                near = score >= np.partition(score, len(score) - k)[len(score) - k]
                found, score = found[near], score[near]
            order = sorted(zip((-score).tolist(), found.tolist()), key=lambda x: (x[0], ids[x[1]] is None, ids[x[1]] or 0, x[1]))[:k]
            out += [{"item_id": item["item_id"], "doc_id": ids[d], "score": -s, "block": right["of_block"][0].as_py(), "place": d} for s, d in order]
        return pa.Table.from_pylist(out, schema=arrow)

    schema = f"item_id {kind.simpleString()}, doc_id long, score long, block long, place int"
    each = near.groupBy("block", "part").cogroup(sides.groupBy("of_block", "of_part")).applyInArrow(ranked, schema)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "place")
    return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
