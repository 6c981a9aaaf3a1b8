"""Centroid clustering of integer vectors: exact Lloyd rounds that skip most distances by geometric drift tightening.

Vectors are written once in blocks (a matrix a row, in buckets of the block number) and never move again. Each round writes a narrow state per
vector: its cluster, and a lower bound of its distance to every other centroid. When centroids have moved, the bound is loosened. The
vectors of a cluster lie in a sphere around its old centroid; for a centroid that moves from a to b by p = \\|b - a\\|, a point x
seen from the middle of a and b under the angle t from the direction of the move comes nearer by

    |x - a| - |x - b| = 2 p u / (|x - a| + |x - b|) <= p cos t,   u = |x - mid| cos t,

as the sum of the two distances is at least 2 |x - mid|. In the plane through a, b and the sphere's centre the smallest angle of
the sphere's points follows from the angle of its centre and its half-angle asin(radius / distance); beyond a right angle the centroid
moves away from all of them. So a bound is loosened by the largest p cos t of the other centroids, not by the largest p. A
vector whose distance to its own centroid, found exactly, is below the bound keeps its cluster; the others are ambiguous and compared with
all centroids, exactly, in whole numbers.

Only sums, counts and radii of the k clusters reach the driver; k is a parameter. Vectors that are null, of another width, or hold null or
non-finite components take no part. Repeated rows are vectors of their own; a null vec_id comes last when the first centroids are chosen. With fewer than k
vectors all become centroids. Empty tables give an empty result; only ``vec_id`` and the embedding are read. A component of more than
``LIMIT`` after scaling is refused: its squared distances could leave 64 bits.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, settle

BLOCK = 256  # vectors of a block; a batch for Python holds up to 2000 blocks
LIMIT = 1 << 26
SAFE = 1 << 20  # below it squared distances are exact in double precision
SLACK = 1e-9  # relative room for rounding in bounds


def kept(vectors: DataFrame, width: int, scale: int) -> DataFrame:
    """``vec_id, point``: usable vectors as whole numbers floor(scale * x)."""
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x")).filter(F.size("x") == width)
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = F.transform("x", lambda x: F.floor(F.lit(float(scale)) * x))
    wide = F.exists("x", lambda x: F.abs(x) * scale > LIMIT)
    refused = F.raise_error(F.lit(f"a scaled component lies beyond {LIMIT}")).cast("array<bigint>")
    return v.filter(~bad).select("vec_id", F.when(wide, refused).otherwise(scaled).alias("point"))


def first_centroids(points: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors of smallest sha256 of salt and vec_id; equal ids are ordered by components."""
    order = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = points.select(order.alias("order"), "point").orderBy(F.asc_nulls_last("order"), "point").limit(k).collect()
    return np.array([r.point for r in rows], np.int64)


def blocks(points: DataFrame, width: int, size: int) -> DataFrame:
    """Rows ``block, ids, points``: the matrix of up to ``size`` vectors as bytes."""
    schema = "block long, ids array<long>, points binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, n = [], 0

        def written(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal number
            for i in range(0, len(table), size):
                part = table.slice(i, size)
                matrix = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in part["point"].chunks]).astype("<i4")
                yield pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), "ids": pa.array([part["vec_id"].to_pylist()], pa.list_(pa.int64())),
                                                  "points": pa.array([matrix.tobytes()], pa.binary())})
                number += 1

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= size:
                yield from written(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield from written(pa.Table.from_batches(held))

    return points.mapInArrow(run, schema)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every vector to every centroid, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)) * math.sqrt(x.shape[1]) < SAFE:
        a, b = x.astype(np.float64), c.astype(np.float64)  # every sum is a whole number below 2^53
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    x, c = x.astype(np.int64), c.astype(np.int64)
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def loosened(before: np.ndarray, after: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For every cluster, by how much the distance of its vectors to any other centroid can have shrunk; ``radius`` is around the old centroids."""
    k = len(before)
    out = np.zeros(k)
    for j in range(k):
        move = after[j] - before[j]
        p = float(np.sqrt((move * move).sum()))
        if not p:
            continue
        middle = (before[j] + after[j]) / 2
        for i in range(k):
            if i == j:
                continue
            view = before[i] - middle
            far = float(np.sqrt((view * view).sum()))
            if radius[i] >= far:
                nearer = p  # the sphere holds the middle: the full drift
            else:
                angle = math.acos(max(-1.0, min(1.0, float(view @ move) / (far * p)))) - math.asin(radius[i] / far)
                nearer = p * math.cos(angle) if 0 < angle < math.pi / 2 else p if angle <= 0 else 0.0
            out[i] = max(out[i], nearer * (1 + SLACK) + SLACK)
    return out


def assign(x: np.ndarray, c: np.ndarray, cluster: np.ndarray | None, bound: np.ndarray | None, loose: np.ndarray | None) -> tuple:
    """Nearest centroid of each vector (ties to the smaller number), its squared distance, the new bound, and how many were ambiguous."""
    n, own = len(x), np.zeros(len(x), np.int64)
    if cluster is None:
        cluster, bound, ambiguous = np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
    else:
        cluster, bound = cluster.copy(), bound - loose[cluster]
        for i in np.unique(cluster):
            mine = cluster == i
            own[mine] = distances(x[mine], c[i : i + 1])[:, 0]
        ambiguous = ~(np.sqrt(own.astype(np.float64)) * (1 + SLACK) < bound)
    at = np.flatnonzero(ambiguous)
    if len(at):
        d = distances(x[at], c)
        cluster[at] = near = d.argmin(1)
        own[at] = d[np.arange(len(at)), near]
        d[np.arange(len(at)), near] = np.iinfo(np.int64).max
        bound[at] = np.sqrt(d.min(1).astype(np.float64)) * (1 - SLACK)
    return cluster, own, bound, len(at)


def lists_of(rows: DataFrame, c: np.ndarray, loose: np.ndarray | None, schema: str, each) -> DataFrame:
    """Assigns all blocks and writes what ``each(row, x, cluster, distance, bound, scanned)`` makes of a block."""
    width = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["points"], "<i4").reshape(-1, width)
                old = (None, None) if loose is None else (np.frombuffer(row["cluster"], "<i4").astype(np.int64), np.frombuffer(row["bound"], "<f8"))
                yield each(row, x, *assign(x, c, *old, loose))

    return rows.mapInArrow(run, schema)


def state_of(row: dict, x: np.ndarray, cluster: np.ndarray, own: np.ndarray, bound: np.ndarray, scanned: int, k: int) -> pa.RecordBatch:
    """A block's clusters and bounds, and one list of the clusters' sums, counts and radii and of the vectors that were compared with all centroids."""
    sums, counts, radius = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64)
    for i in np.unique(cluster):
        mine = cluster == i
        sums[i], counts[i] = x[mine].sum(0, dtype=np.int64), mine.sum()
        radius[i] = math.ceil(math.sqrt(int(own[mine].max()))) + 1
    numbers = np.concatenate([sums.ravel(), counts, radius, [scanned]]).tolist()
    return pa.RecordBatch.from_pydict({
        "block": pa.array([row["block"]], pa.int64()), "cluster": pa.array([cluster.astype("<i4").tobytes()], pa.binary()),
        "bound": pa.array([bound.astype("<f8").tobytes()], pa.binary()), "numbers": pa.array([numbers], pa.list_(pa.int64()))})


def placed(row: dict, x: np.ndarray, cluster: np.ndarray, own: np.ndarray, bound: np.ndarray, scanned: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"vec_id": pa.array(row["ids"], pa.int64()), "cluster": pa.array(cluster, pa.int32()), "distance": pa.array(own, pa.int64())})


class Buckets:
    """A table written in buckets of ``block`` as long as it is needed: tables of one number of buckets join without a shuffle."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, name)
        self.table, n = self.path.rsplit("/", 1)[1].replace("-", "_"), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, "block").write.option("path", self.path).bucketBy(n, "block").sortBy("block").saveAsTable(self.table)
        self.rows = self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.table}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, salt: str = "3:", block: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[int]]:
    """Rows ``vec_id, cluster, distance`` after ``rounds`` rounds, the final centroids, and how many vectors each assignment compared with all centroids."""
    points = kept(vectors, width, scale)
    c = first_centroids(points, k, salt)
    spark, k = vectors.sparkSession, len(c)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), c, []
    held = Buckets(blocks(points, width, block), "vectors")
    narrow, state, loose, scanned = held.rows.select("block", "points"), None, None, []
    for _ in range(rounds):
        rows = narrow if state is None else narrow.join(state.rows.select("block", "cluster", "bound"), "block")
        now = Buckets(lists_of(rows, c, loose, "block long, cluster binary, bound binary, numbers array<long>", partial(state_of, k=k)), "state")
        if state is not None:
            state.drop()
        state = now
        each = state.rows.select(F.posexplode("numbers").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(28,0)")).alias("sum"), F.max("v").alias("most"))
        found = {r.i: r for r in each.collect()}  # k * (width + 2) + 1 rows
        sums, most = [int(found[i].sum) for i in range(len(found))], [found[i].most for i in range(len(found))]
        counts, after = sums[k * width : k * width + k], c.copy()
        for i in range(k):
            if counts[i]:
                after[i] = [s // counts[i] for s in sums[i * width : (i + 1) * width]]
        loose = loosened(c.astype(np.float64), after.astype(np.float64), np.array(most[k * width + k : -1], np.float64))
        c = after
        scanned.append(sums[-1])
    last = held.rows if state is None else held.rows.join(state.rows.select("block", "cluster", "bound"), "block")
    out = settle(lists_of(last, c, loose, "vec_id long, cluster int, distance long", placed), "clusters")
    held.drop()
    if state is not None:
        state.drop()
    return out, c, scanned


def described(found: DataFrame, c: np.ndarray) -> DataFrame:
    """Clusters with the sums of their squared distances, the sum over all, and the sha256 of their centroid's components."""
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}  # k rows
    names = [hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in c.tolist()]

    def pick(values: list) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]) if values else F.array(F.lit(None)), F.col("cluster"))

    return found.select("vec_id", "cluster", "distance", pick([sums.get(i, 0) for i in range(len(c))]).cast("long").alias("cluster_inertia"),
                        F.lit(sum(sums.values())).cast("long").alias("inertia"), pick(names).cast("string").alias("centroid_sha256"))
