"""Nearest vectors by cross-polytope hashing: signed axes of pseudo-rotations, several probes, exact distances at the end."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

TABLES, PROBES = 16, 8
BLOCK = 4096  # indexed vectors of a bucket that are compared in one step


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform; x is padded to a power of two."""
    n = x.shape[1]
    for sign in signs:
        x = x * sign
        step = 1
        while step < n:
            x = x.reshape(len(x), -1, 2, step)
            x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
            step *= 2
    return x


def axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of unit vectors after the table's rotation, nearest first: axis, or axis + width if negative."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    signs = np.random.default_rng([table, width]).choice([-1.0, 1.0], (3, width))
    y = rotate(np.pad(x, ((0, 0), (0, width - x.shape[1]))), signs)
    both = np.concatenate([y, -y], 1)
    return np.argsort(-both, axis=1, kind="stable")[:, :probes]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, embedding`` (double) whose vector is not null, empty or zero and has finite components only."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda x: x != 0))


def hashed(points: DataFrame, probes: int, tables: int) -> DataFrame:
    """``point, embedding, cell``: each vector in ``tables`` tables at its ``probes`` nearest axes; vectors of different sizes never share a cell."""
    def run(batches):
        for batch in batches:
            point, column = batch.column("point").to_numpy(), batch.column("embedding")
            sizes = column.value_lengths().to_numpy()
            for d in np.unique(sizes):
                mine = np.flatnonzero(sizes == d)
                part = column.take(pa.array(mine))
                x = part.flatten().to_numpy().reshape(-1, d)
                # a very long vector is shortened before its square is taken
                unit = x / np.abs(x).max(1, keepdims=True)
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                for t in range(tables):
                    found = axes(unit, t, probes)
                    cell = (int(d) * tables + t) * (1 << 20) + found
                    for j in range(found.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(point[mine]), part, pa.array(cell[:, j].astype(np.int64))], names=["point", "embedding", "cell"])

    return points.mapInArrow(run, "point long, embedding array<double>, cell long")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows found for each query, by Euclidean distance in double precision.

    ``queries (vec_id)`` are rows of ``vectors (vec_id, embedding)``; a query is no neighbour of itself. Ties go to the smaller
    vec_id. Equal vectors are one point: no more than the ``k + 1`` smallest ids of a point can be among anyone's nearest, so
    only these are kept with it, whatever the number of copies. Every point is indexed at its nearest signed axis in every table;
    query points look at their ``probes`` nearest axes. A cell is compared in blocks of about ``BLOCK`` points, of which each
    gives the best points of each query, and no pair of points leaves a task otherwise. Fewer candidates than ``k`` in the
    cells (small tables) are completed by comparing such queries with all points in blocks. Null ids and vectors that are null,
    empty, zero or not finite take no part. Rows that repeat a vec_id with the same vector count once.
    """
    rows = usable(vectors).distinct()
    order = Window.partitionBy("embedding").orderBy("vec_id")
    first = rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1)
    points = first.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = settle(points.select(F.monotonically_increasing_id().alias("point"), "embedding", "ids"), "points")
    asked = rows.join(queries.select(F.col("vec_id").cast("long")).distinct(), "vec_id", "left_semi").join(points.select("point", "embedding"), "embedding")
    asked = settle(asked.select(F.col("vec_id").alias("query_id"), "point"), "asked")
    ask = points.join(asked.select("point").distinct(), "point", "left_semi").select("point", "embedding")

    indexed = hashed(points.select("point", "embedding"), 1, tables)
    sizes = indexed.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    sizes = settle(sizes, "cells")
    indexed = indexed.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("point"), F.col("blocks")).cast("int"))
    indexed = indexed.select("cell", "block", "point", "embedding")
    reach = sizes.select(F.col("cell").alias("_cell"), (F.col("blocks") - 1).alias("last"))
    probing = hashed(ask, probes, tables).join(reach, F.col("cell") == F.col("_cell"))
    probing = probing.select("cell", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("block"), "point", "embedding")

    def compare(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return empty
        return best(asking, held, k + 1)

    keys = ["cell", "block"]
    found = probing.groupBy(*keys).cogroup(indexed.groupBy(*keys)).applyInArrow(compare, "query long, point long, score double")
    found = found.groupBy("query", "point").agg(F.min("score").alias("score"))
    near = settle(answers(found, asked, points, k), "near")
    # queries with fewer neighbours than asked for: all points, in blocks
    short = asked.join(near.groupBy("query_id").count(), "query_id", "left").filter(F.coalesce("count", F.lit(0)) < k).select("query_id", "point")
    short = settle(short, "short")
    if short.isEmpty():
        return near
    total = points.count()
    few = short.join(points.select("point", "embedding"), "point").select("point", "embedding").distinct()
    parts = max(1, -(-total // BLOCK))
    spread = few.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = points.select(F.col("point").alias("point"), F.col("embedding").alias("embedding"), F.pmod(F.xxhash64("point"), F.lit(parts)).cast("int").alias("block"))
    found = spread.groupBy("block").cogroup(held.groupBy("block")).applyInArrow(compare, "query long, point long, score double")
    return near.join(short, "query_id", "left_anti").union(answers(found, short, points, k))


empty = pa.table({"query": pa.array([], pa.int64()), "point": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})


def best(asking: pa.Table, held: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest held points of each asking point, and those as near as the last of them."""
    def arrays(table):
        column = table.column("embedding").combine_chunks()
        sizes = column.value_lengths().to_numpy()
        return table.column("point").to_numpy(), column.flatten().to_numpy(), sizes

    qp, qv, qn = arrays(asking)
    hp, hv, hn = arrays(held)
    qs, hs = np.cumsum(qn) - qn, np.cumsum(hn) - hn
    out = [[], [], []]
    for d in np.unique(qn):
        mine, theirs = np.flatnonzero(qn == d), np.flatnonzero(hn == d)
        if not len(theirs):
            continue
        x = hv[hs[theirs][:, None] + np.arange(d)]
        for i in mine:
            far = np.sqrt(((x - qv[qs[i] : qs[i] + d]) ** 2).sum(1))
            if len(far) > k:
                keep = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
            else:
                keep = np.arange(len(far))
            out[0].append(np.full(len(keep), qp[i]))
            out[1].append(hp[theirs[keep]])
            out[2].append(far[keep])
    if not out[0]:
        return empty
    return pa.table({n: pa.array(np.concatenate(c)) for n, c in zip(("query", "point", "score"), out)})


def answers(found: DataFrame, asked: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest ids of each query from ``query, point, score``, the ids of a point in order."""
    top = Window.partitionBy("query").orderBy("score", "point")
    near = found.withColumn("_edge", F.nth_value("score", k + 1).over(top.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    near = near.filter(F.col("_edge").isNull() | (F.col("score") <= F.col("_edge"))).drop("_edge")
    each = near.join(points.select("point", "ids"), "point").select(F.col("query").alias("point"), "score", F.explode("ids").alias("vec_id"))
    ranked = asked.join(each, "point").filter("query_id <> vec_id")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
