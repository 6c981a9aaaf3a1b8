"""Helpers of the training-data operators: whole texts in bounded pieces, word hashes, folds, linked groups."""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch, settle

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
LONG_WORD = 64  # bytes; longer words are hashed one by one
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_VALUES[SPACE] = 0


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; no other letter changes."""
    return F.translate(text, UPPER, LOWER)


def worker_store(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, across its tasks."""
    box = sys.modules.setdefault("_llm_worker_store", types.ModuleType("_llm_worker_store"))
    return box.__dict__.setdefault(name, {})


def give_back(*kept: str) -> None:
    """Empties the worker's dictionaries but the ``kept`` ones and returns memory that is no longer used to the system."""
    box = sys.modules.get("_llm_worker_store")
    for name, store in list(vars(box).items()) if box else []:
        if isinstance(store, dict) and name not in kept:
            store.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(run: Callable, *kept: str) -> Callable:
    """``run`` for ``mapInArrow``, with ``give_back`` before its first batch and after its last: a worker goes on to other operators' tasks
    and would hold the largest use of each of them."""
    def lighter(batches):
        give_back(*kept)
        try:
            yield from run(batches)
        finally:
            give_back(*kept)

    return lighter


def pieces(texts: list, budget: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of a batch of about ``budget`` characters; a longer text is a range of its own."""
    start = total = 0
    for i, text in enumerate(texts):
        size = len(text) if text else 0
        if total and total + size > budget:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, 0 to n, modulo 2^64; kept by the worker."""
    store = worker_store("powers")
    if store.get("n", -1) < n:
        for key, base in (("up", BASE), ("down", BASE_INVERSE)):
            steps = np.full(n + 1, base, np.uint64)
            steps[0] = 1
            store[key] = np.multiply.accumulate(steps)
        store["n"] = n
    return store["up"][: n + 1], store["down"][: n + 1]


def prefix(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums, for ``stretch``."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values from start to end, the same wherever the sequence stands."""
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs without ASCII white space), and each text's first word as an index (n + 1 of them)."""
    buffer = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends_of_text = np.cumsum([0, *(len(t) + 1 for t in texts)])
    inside = ~SPACE[buffer]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = stretch(prefix(BYTE_VALUES[buffer]), start, end)
    # sums of powers modulo 2^64 agree for some pairs of long words (letters in Thue-Morse order), so those get a hash of their bytes
    for i in np.flatnonzero(end - start > LONG_WORD):
        hashes[i] = int.from_bytes(hashlib.blake2b(buffer[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(start, ends_of_text)


def bytes_of(text: str | None) -> bytes:
    """UTF-8 of a text, nothing for a null one."""
    return text.encode("utf-8", "surrogatepass") if text else b""


def smallest_by_hash(rows: DataFrame, by: list[str], limit: int, *of: str) -> DataFrame:
    """About the ``limit`` rows of each group whose hashed columns ``of`` are smallest, no more than these.

    The group's size tells below which hash about so many rows lie; the others go before any shuffle, so that a large group does
    not meet in one task. Groups are labels or languages: their sizes are few rows and are sent to all tasks.
    """
    from pyspark.sql import Window

    share = F.pmod(F.xxhash64(*of), F.lit(1 << 40)) / float(1 << 40)
    sizes = rows.groupBy(*by).agg(((limit + 8 * limit**0.5 + 8) / F.count("*")).alias("_share"))
    near = rows.join(F.broadcast(sizes), by).filter(share < F.col("_share")).drop("_share")
    order = Window.partitionBy(*by).orderBy(share, *of)
    return near.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= limit).drop("_place")


def by_key(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows written once in as many buckets of ``key`` as there are shuffle partitions: grouping and joining by it shuffle them no more.

    The files lie in the shared folder; the table's name stays in the session's catalog.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[1].replace("-", "_")
    df.repartition(n, key).write.option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(table)
    return spark.table(table)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest reachable id of every id in ``edges (a, b)``: rows ``id, component``.

    Each round ties the neighbours of an id to the smallest of them, first the larger ones, then the smaller ones, with
    grouped minima and joins only; no neighbour list is gathered. Rounds grow with the logarithm of a chain's length. Every
    round is written to the shared folder. Ids that no edge names are not in the result.
    """
    now = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), name)

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    seen = mark(now)
    while seen[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # what is left for an id are its smaller neighbours
        small = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(small, "b")
        tied = joined.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        now = settle(tied, name)
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).union(
        now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
