"""Centroids against a full search in whole numbers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from slotcast.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int, v string, cluster int, x string, upper double, distance string"


def plain(rows, k, rounds, width):
    """Rows of ``cluster_table`` by a full search in Python's whole numbers."""
    kept = [
        (i, [math.floor(256 * x) for x in e]) for i, e in rows
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)
    ]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    first = sorted(kept, key=lambda r: (name(r[0]), r[0] is not None, r[0] or 0, r[1]))[:k]
    centroids = [list(v) for _, v in first]
    for left in range(rounds, -1, -1):
        best = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if left:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, best) if c == j]
                if own:
                    centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    sums = Counter()
    for d, c in best:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for (i, _), (d, c) in zip(kept, best))


def check(spark, monkeypatch, rows, k, rounds=5, width=6, at_a_time=8192):
    monkeypatch.setattr(clusters, "_ROWS", at_a_time)
    frame = spark.createDataFrame([(*r, 1, "v", 7, "x", 0.5, "d") for r in rows], SCHEMA).repartition(3)
    monkeypatch.setattr(clusters.whole_vectors, "__defaults__", (width, 256))
    got = Counter(map(tuple, clusters.cluster_table(frame, k, rounds).collect()))
    assert got == plain(rows, k, rounds, width)


def cloud(n, width, seed, step=1):
    rng = random.Random(seed)
    return [(i, [rng.randint(-3, 3) * step / 256 + rng.choice((0, 1)) for _ in range(width)]) for i in range(n)]


@pytest.mark.parametrize("k, n, seed", [(7, 120, 1), (1, 30, 2), (2, 40, 3), (25, 60, 4), (60, 40, 5), (40, 400, 6)])
def test_equals_full_search(spark, monkeypatch, k, n, seed):
    """Small whole numbers: many ties between centroids and many equal centroids."""
    check(spark, monkeypatch, cloud(n, 6, seed), k, at_a_time=17)


def test_edges(spark, monkeypatch):
    rows = cloud(40, 6, 9) + [
        (50, None), (51, []), (52, [0.5] * 5), (53, [0.5] * 7), (54, [0.5] * 5 + [None]), (55, [float("nan")] * 6),
        (56, [float("inf")] + [0.0] * 5), (57, [-float("inf")] + [0.0] * 5), (None, [0.25] * 6), (None, [-0.25] * 6),
        (3, [-0.001] * 6), (3, [-0.001] * 6), (60, [1000.0, -1000.0, 1e-9, -1e-9, 0.0, -0.0]),
    ]
    check(spark, monkeypatch, rows, 5)
    check(spark, monkeypatch, rows + [(100 + i, [0.125] * 6) for i in range(200)], 9)
    assert clusters.cluster_table(spark.createDataFrame([], SCHEMA)).collect() == []
    assert clusters.cluster_table(spark.createDataFrame([(*r, 1, "v", 7, "x", 0.5, "d") for r in rows[40:45]], SCHEMA)).collect() == []


def test_out_of_range(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="out of range in vector 1"):
        clusters.cluster_table(frame).collect()


def rounds_of(points, centroids, rounds):
    """Distances measured in every round, and the state after each."""
    n, k = len(points), len(centroids)
    cluster, second = np.zeros(n, np.int32), np.full(n, min(1, k - 1), np.int32)
    upper, lower, moved, measured = np.full(n, np.inf), np.zeros(n), np.zeros(k), []
    for _ in range(rounds):
        order, apart = clusters.neighbours(centroids)
        measured.append(clusters.assign(points, cluster, second, upper, lower, centroids, order, apart, moved))
        full = ((points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        assert (cluster == full.argmin(axis=1)).all()
        nearest = np.sqrt(np.sort(full, axis=1).astype(float))
        assert (upper >= nearest[:, 0] - 1e-6).all() and (lower <= nearest[:, 1] + 1e-6).all()
        new = centroids.copy()
        for j in range(k):
            if (cluster == j).any():
                new[j] = points[cluster == j].sum(axis=0) // (cluster == j).sum()
        moved, centroids = clusters.moved_by(centroids, new), new
    return measured


def test_search_is_pruned():
    """Bounds hold, and few of the n * k distances are measured."""
    rng = np.random.default_rng(3)
    centres = rng.integers(-2000, 2000, (40, 8))
    points = centres[rng.integers(0, 40, 4000)] + rng.integers(-60, 60, (4000, 8))
    start = points[rng.permutation(4000)[:40]].copy()
    measured = rounds_of(points, start, 8)
    assert measured[0] < 4000 * 40 and measured[-1] < 0.1 * 4000 * 40


def test_ball_shrinks():
    """A scan ends once the second best so far rules out all further neighbours of the start."""
    centroids = np.array([[0], [2], [100], [102], [200], [300], [400]])
    order, apart = clusters.neighbours(centroids)
    state = [np.array([0], np.int32), np.array([1], np.int32), np.array([np.inf]), np.array([0.0])]
    measured = clusters.assign(np.array([[1]]), *state, centroids, order, apart, np.zeros(7))
    assert measured == 2 and state[0][0] == 0 and state[1][0] == 1
