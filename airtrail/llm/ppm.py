"""Language-model scores by prediction by partial matching over bytes, learned from all training documents."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .common import by_key, bytes_of, fold, mix, pieces, word_hashes

ORDER = 5  # bytes of context
END = 0xFF  # never a byte of UTF-8: closes a text, and stands before it as the context of its first bytes
WORD = np.int64(-1 << 63)  # the sign bit marks keys of words; keys of contexts have at most 56 bits
PIECE = 200_000  # characters that are counted or scored in one step


class Lookup:
    """Values by 64-bit key, in arrays: an open-addressed table that is filled and read a whole column at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 2).bit_length())
        self.mask = np.int64((1 << self.bits) - 1)
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.keys, self.values = keys, values
        left, place = np.arange(len(keys)), self.first(keys)
        while len(left):
            free = self.slot[place] < 0
            self.slot[place[free]] = left[free]
            lost = keys[self.slot[place]] != keys[left]
            left, place = left[lost], (place[lost] + 1) & self.mask

    def first(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Values of keys that are all in the table."""
        place = self.first(keys)
        found = self.slot[place]
        wrong = np.flatnonzero(self.keys[found] != keys)
        at = place[wrong]
        while len(wrong):
            at = (at + 1) & self.mask
            found[wrong] = self.slot[at]
            still = self.keys[found[wrong]] != keys[wrong]
            wrong, at = wrong[still], at[still]
        return self.values[found]


def pack(docs: DataFrame, parts: int, rest: int) -> DataFrame:
    """Texts as the model sees them, many to a row: ``block, ids, held, sizes, body``.

    A-Z is lowered, words (runs without ASCII white space) stand apart by one space, ``END`` closes each text. ``body`` is
    compressed; ``block`` is the task that read the texts, so a block is as large as a read task.
    """
    def run(batches):
        block, squeeze = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            held = batch.column("held").to_pylist()
            for a, b in pieces(texts, PIECE):
                bodies = [b" ".join(bytes_of(t).lower().split()) + b"\xff" for t in texts[a:b]]
                row = [block], [ids[a:b]], [held[a:b]], [list(map(len, bodies))], [squeeze.compress(b"".join(bodies))]
                kinds = pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds)], names=["block", "ids", "held", "sizes", "body"])

    marked = docs.select(F.col("doc_id").cast("long"), "text", (fold(F.col("doc_id"), parts) == rest).alias("held"))
    return marked.mapInArrow(run, "block int, ids array<long>, held array<boolean>, sizes array<int>, body binary")


def unpack(table):
    """Rows of ``pack`` as (block, ids, held, sizes, body bytes), one at a time."""
    squeeze = zstandard.ZstdDecompressor()
    for i in range(table.num_rows):
        block, ids, held, sizes, body = (table.column(c)[i] for c in ("block", "ids", "held", "sizes", "body"))
        yield block.as_py(), ids.as_py(), np.array(held.as_py(), bool), np.array(sizes.as_py(), np.int64), squeeze.decompress(body.as_py())


def grams(body: bytes, sizes: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself and the ``order`` bytes before it in one number; before a text stand ``END`` bytes."""
    spread = np.full(len(body) + order * len(sizes), END, np.uint64)
    at = np.arange(len(body)) + order * (1 + np.repeat(np.arange(len(sizes)), sizes))
    spread[at] = np.frombuffer(body, np.uint8)
    value = spread[: len(spread) - order].copy()
    for j in range(1, order + 1):
        value <<= np.uint64(8)
        value |= spread[j : len(spread) - order + j]
    return value[at - order].view(np.int64)


def counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of ``n``."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], (np.add.reduceat(n, new) if len(new) else n)


def count(packed: DataFrame, order: int) -> DataFrame:
    """``key, block, n``: for each block its distinct byte contexts with their next byte, and its words; n in training texts.

    Keys that only held-out texts hold have n 0: they are asked for, not learned from. Words are named by 63-bit hashes; among
    a billion different words two share one with a chance of about 5 in 100.
    """
    def run(batches):
        had: dict[int, list] = {}
        for batch in batches:
            for block, _, held, sizes, body in unpack(batch):
                words, at = word_hashes(body[:-1].split(b"\xff"))
                keys = np.concatenate([grams(body, sizes, order), words.view(np.int64) | WORD])
                weight = np.concatenate([np.repeat(~held, sizes), np.repeat(~held, np.diff(at))]).astype(np.int64)
                old = had.setdefault(block, [])
                old.append(counted(keys, weight))
                if len(old) > 1 and sum(len(x[0]) for x in old[1:]) > len(old[0][0]) + 300_000:
                    had[block] = [counted(*(np.concatenate(x) for x in zip(*old)))]
        for block, parts in had.items():
            keys, n = counted(*(np.concatenate(x) for x in zip(*parts)))
            for i in range(0, len(keys), 100_000):
                k, m = keys[i : i + 100_000], n[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.full(len(k), block, np.int32)), pa.array(m)], names=["key", "block", "n"])

    return packed.mapInArrow(run, "key long, block int, n long")


def low(key: Column, symbols: int) -> Column:
    """The last ``symbols`` bytes of a key."""
    return key.bitwiseAND(F.lit((1 << 8 * symbols) - 1))


def up(key: Column) -> Column:
    """A key without its last byte: the context."""
    return F.shiftrightunsigned(key, 8)


def code_lengths(asked: DataFrame, order: int) -> DataFrame:
    """``key, value``: log10 probability of the last byte of each key after the bytes before it.

    ``asked (key, n)`` holds every context of ``order`` bytes with its next byte, n times in training. The trie of shorter
    contexts follows from it by dropping first bytes. In a context seen t times with d different next bytes a byte seen n times
    has (2 n - 1) / 2 t and the escape d / 2 t. After an escape the bytes of the longer context are excluded: their counts in the
    shorter one leave t, their number leaves d. Below the empty context all bytes not seen at all are alike.
    """
    level = settle(asked.filter("n > 0"), "trie")
    levels, contexts = {order: level}, {}
    for k in range(order - 1, -1, -1):
        level = settle(level.groupBy(low(F.col("key"), k + 1).alias("key")).agg(F.sum("n").alias("n")), "trie")
        levels[k] = level
    for k in range(order, -1, -1):
        nodes = levels[k]
        if k:
            shorter = levels[k - 1].select(F.col("key").alias("_low"), F.col("n").alias("_n"))
            nodes = nodes.withColumn("_low", low(F.col("key"), k)).join(shorter, "_low")
        gone = F.sum("_n" if k else F.lit(0)).alias("gone")
        contexts[k] = settle(nodes.groupBy(up(F.col("key")).alias("context")).agg(F.sum("n").alias("t"), F.count("*").alias("d"), gone), "contexts")
    seen = levels[order].withColumn("context", up(F.col("key"))).join(contexts[order], "context")
    done = seen.select("key", F.log10((2 * F.col("n") - 1) / (2 * F.col("t"))).alias("value"))
    # keys of held-out texts alone walk down the trie
    walk = asked.filter("n = 0").select("key", F.lit(0.0).alias("value"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("out"))
    for k in range(order, -1, -1):
        here = contexts[k].select("context", F.col("t").alias("_t"), F.col("d").alias("_d"), F.col("gone").alias("_gone"))
        walk = walk.withColumn("_key", low(F.col("key"), k + 1)).withColumn("context", up(F.col("_key"))).join(here, "context", "left")
        walk = walk.join(levels[k].select(F.col("key").alias("_key"), F.col("n").alias("_n")), "_key", "left")
        t, d = F.coalesce(F.col("_t") - F.col("gone"), F.lit(0)), F.coalesce(F.col("_d") - F.col("out"), F.lit(0))
        hit = F.log10((2 * F.col("_n") - 1) / (2 * t))
        escape = F.when(d > 0, F.log10(d / (2 * t))).otherwise(0.0)
        walk = settle(walk.select(
            "key", (F.col("value") + F.coalesce(hit, escape)).alias("value"), F.coalesce("_gone", F.lit(0)).alias("gone"),
            F.coalesce("_d", F.lit(0)).alias("out"), F.col("_n").isNotNull().alias("_hit")), "walk")
        done = done.union(walk.filter("_hit").select("key", "value"))
        walk = walk.filter("NOT _hit").drop("_hit")
    return done.union(walk.select("key", (F.col("value") - F.log10(256 - F.col("out"))).alias("value")))


def score(docs: DataFrame, parts: int = 7, rest: int = 2, order: int = ORDER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs (doc_id, text)``.

    Training texts are those whose crc32 of the id is not ``rest`` modulo ``parts``; held-out ones get scores only. ``score`` is the
    log10 probability of the text as ``pack`` writes it, under a byte trie with contexts up to ``order`` bytes counted over
    all training texts. ``base_score`` sums log10((c + 1) / (N + V + 1)) over words and one end. A null text is empty: its
    only token is the end. A null doc_id counts as empty text in the fold. Without training texts all symbols are alike.

    Texts are packed once. The keys are written once in buckets, so that counting them and giving their values back shuffles them no
    more. Each block asks for the keys it holds and gets their values back, so a task holds the part of
    the trie that its block needs, however large the whole is; nothing is broadcast.
    """
    packed = settle(pack(docs, parts, rest), "packed")
    asked = by_key(count(packed, order), "key", "asked")
    total = settle(asked.groupBy("key").agg(F.sum("n").alias("n")), "counts")
    words = total.filter("key < 0")
    size = words.agg(F.sum("n").alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    learned = packed.agg(F.sum(F.aggregate("held", F.lit(0).cast("long"), lambda a, h: a + (~h).cast("long"))).alias("n")).first()["n"] or 0
    n_train, kinds = (size["n"] or 0) + learned, size["v"] + (learned > 0)
    values = words.select("key", F.col("n").cast("double").alias("value")).union(code_lengths(total.filter("key >= 0"), order))
    given = asked.select("key", "block").join(values, "key").select("block", "key", "value")
    bottom = math.log10(n_train + kinds + 1)

    def rate(texts: pa.Table, given: pa.Table) -> pa.Table:
        value_of = Lookup(given.column("key").to_numpy(), given.column("value").to_numpy())
        columns: list[list] = [[], [], [], [], [], []]
        for _, ids, held, sizes, body in unpack(texts):
            model = np.add.reduceat(value_of(grams(body, sizes, order)), np.cumsum(sizes) - sizes)
            words, at = word_hashes(body[:-1].split(b"\xff"))
            c = value_of(words.view(np.int64) | WORD) if len(words) else np.zeros(0)
            sums = np.concatenate([[0.0], np.cumsum(np.log10(c + 1) - bottom)])
            known = np.concatenate([[0], np.cumsum(c > 0)])
            columns[0] += ids
            columns[1] += held.tolist()
            columns[2] += (np.diff(at) + 1).tolist()
            columns[3] += (known[at[1:]] - known[at[:-1]] + (learned > 0)).tolist()
            columns[4] += (sums[at[1:]] - sums[at[:-1]] + math.log10(learned + 1) - bottom).tolist()
            columns[5] += model.tolist()
        shape = (("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))
        return pa.table({name: pa.array(c, k) for (name, k), c in zip(shape, columns)})

    out = packed.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(
        rate, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), "base_score", "score")
