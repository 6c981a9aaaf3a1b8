"""Centroid clustering against plain rounds."""

import hashlib

import numpy as np
import pytest

from airtrail.llm import centroids


def plain(rows: list, k: int = 8, rounds: int = 10, width: int = 64) -> list:
    """Every distance of every round, in Python's whole numbers."""
    import math

    points = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(points, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [list(p) for _, p in order[:k]]

    def nearest(p: list) -> tuple:
        return min((sum((a - b) ** 2 for a, b in zip(p, y)), j) for j, y in enumerate(c))

    for _ in range(rounds):
        sides = [nearest(p)[1] for _, p in points]
        for j in range(len(c)):
            mine = [p for (_, p), s in zip(points, sides) if s == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    ends = [(i, *nearest(p)[::-1]) for i, p in points]
    inertia = [sum(d for _, s, d in ends if s == j) for j in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c]
    return sorted(((i, s, d, inertia[s], sum(inertia), name[s]) for i, s, d in ends), key=str)


def run(spark, rows: list, **options) -> tuple:
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, cluster int").repartition(3)
    found, c, scanned = centroids.cluster(df, **options)
    return sorted((tuple(r) for r in centroids.described(found, c).collect()), key=str), scanned


def test_equals_plain_rounds(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(0, 1, (9, 64))
    data = (middles[rng.integers(0, 9, 400)] + rng.normal(0, 0.25, (400, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[7][1])]
    rows += [(1000, None), (1001, [0.5] * 63), (1002, [float("nan")] + [0.0] * 63), (1003, [None] + [0.0] * 63), (1004, [float("inf")] * 64), (1005, []), (1006, [0.0] * 64)]
    found, scanned = run(spark, rows, block=50)
    assert found == plain(rows)
    assert scanned[0] == 405 and max(scanned[2:]) < 405  # bounds settle most vectors


def test_few_vectors_ties_and_large_components(spark):
    rows = [(1, [0.0] * 64), (2, [0.0] * 64), (3, [1.0] * 64), (4, [0.5] * 64), (5, [-3000.25] * 64), (6, [60000.0] * 64)]
    assert run(spark, rows)[0] == plain(rows)
    assert run(spark, rows * 3)[0] == plain(rows * 3)
    assert run(spark, [(9, None)])[0] == []


def test_refuses_what_64_bits_cannot_hold(spark):
    with pytest.raises(Exception, match="lies beyond"):
        run(spark, [(1, [1e30] * 64)])


def test_loosening_holds_and_is_less_than_the_drift():
    rng = np.random.default_rng(2)
    gained = 0.0
    for _ in range(300):
        before = rng.normal(0, 10, (5, 6))
        after = before + rng.normal(0, rng.choice([0.1, 1, 5]), (5, 6))
        radius = rng.uniform(0, 8, 5)
        loose = centroids.loosened(before, after, radius)
        for i in range(5):
            way = rng.normal(0, 1, (400, 6))
            x = before[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (400, 1)) ** 0.2
            for j in range(5):
                if j != i:
                    shrunk = np.linalg.norm(x - before[j], axis=1) - np.linalg.norm(x - after[j], axis=1)
                    assert shrunk.max() <= loose[i] + 1e-9
        full = np.array([max(np.linalg.norm(after[j] - before[j]) for j in range(5) if j != i) for i in range(5)])
        assert (loose <= full * (1 + 1e-6)).all()
        gained += (full - loose).sum()
    assert gained > 0
