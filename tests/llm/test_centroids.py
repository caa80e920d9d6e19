"""Centroids by n-simplex bounds, against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from likerec.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, CLUSTER string, _llm_point int"


def brute(rows, clusters, rounds, size=64):
    kept = [(r[0], [math.floor(1024 * x) for x in r[1]]) for r in rows
            if r[1] is not None and len(r[1]) == size and all(x is not None and math.isfinite(x) for x in r[1])]
    name = lambda i: "null" if i is None else str(i)
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{name(r[0])}".encode()).hexdigest(), r[1]))
    middle = [v for _, v in order[:clusters]]

    def assign():
        found = []
        for _, v in kept:
            all_ = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in middle]
            found.append((all_.index(min(all_)), min(all_)))
        return found

    for _ in range(rounds):
        found = assign()
        for k in range(len(middle)):
            mine = [v for (_, v), (c, _) in zip(kept, found) if c == k]
            if mine:
                middle[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = assign()
    inertia = [sum(d for c, d in found if c == k) for k in range(len(middle))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, c, d, inertia[c], sum(inertia), digest[c]) for (i, _), (c, d) in zip(kept, found)), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("vec_id", *centroids.OUTPUTS).collect()), key=repr)


def made(seed=0):
    rng = np.random.default_rng(seed)
    middles = 3 * rng.standard_normal((5, 64))
    rows = [(k, (middles[k % 5] + rng.standard_normal(64)).tolist(), 1, "x", 2) for k in range(150)]
    bad = [None, [], [1.0], [0.5] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63, [-float("inf")] * 64]
    rows += [(200 + k, v, 1, "x", 2) for k, v in enumerate(bad)]
    return rows + [rows[0], rows[0], (0, rows[7][1], 1, "x", 2), (None, rows[3][1], None, None, None), (999, [0.0] * 64, 1, "x", 2)]


@pytest.mark.parametrize("limit", [0.0, 0.5, 2.0])
def test_clusters_like_plain_arithmetic(spark, monkeypatch, limit):
    monkeypatch.setattr(centroids, "NEW_PIVOTS", limit)
    rows = made()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert got(centroids.cluster_vectors(frame, rounds=4)) == brute(rows, 8, 4)


def test_few_equal_and_no_vectors(spark):
    rows = [(k, v, 1, "x", 2) for k, v in enumerate([[0.25] * 64] * 9 + [[-0.0001] * 64] * 3)]
    for some in (rows, rows[:3], rows[8:10]):
        assert got(centroids.cluster_vectors(spark.createDataFrame(some, SCHEMA), rounds=3)) == brute(some, 8, 3)
    empty = centroids.cluster_vectors(spark.createDataFrame([], SCHEMA), rounds=3)
    assert empty.count() == 0 and empty.columns[-5:] == centroids.OUTPUTS and empty.schema["distance"].dataType.typeName() == "long"
    with pytest.raises(Exception, match="beyond 64 bits"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>")).count()


def test_bounds_hold_the_true_distance():
    rng = np.random.default_rng(4)
    points = rng.integers(-5000, 5000, (500, 64))
    pivots = rng.integers(-5000, 5000, (8, 64))
    pivots[7] = pivots[0]
    moved = pivots + rng.integers(-300, 300, (8, 64))
    simplex = centroids.Simplex(pivots)
    assert len(simplex.pivots) == 7
    apexes, tops = simplex.apexes(points), simplex.apexes(moved)
    lower = np.sqrt(np.square(apexes[:, None] - tops).sum(axis=2))
    flipped = tops * np.array([1] * 6 + [-1])
    upper = np.sqrt(np.square(apexes[:, None] - flipped).sum(axis=2))
    true = np.sqrt(centroids.squared(points, moved))
    assert (lower <= true + 1e-6).all() and (true <= upper + 1e-6).all()
    found, compared = centroids.nearest(points, apexes, moved, tops)
    assert (found == true.argmin(axis=1)).all() and compared < 0.6 * points.shape[0] * 8
