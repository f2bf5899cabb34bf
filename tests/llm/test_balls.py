"""Centroid clustering by balls against clustering that compares every vector with every centroid."""

import hashlib
from math import isqrt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayroll.llm import balls
from dayroll.llm.balls import Balls, cluster_vectors, limit, squared


def plain(rows, k, rounds, seed):
    """rows: (id, whole numbers). Clusters, squared distances and centroids, with Python's own integers."""
    order = sorted(rows, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [list(v) for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for at in range(rounds + 1):
        best = [min((far(v, c), i) for i, c in enumerate(centroids)) for _, v in rows]
        if at < rounds:
            for i in range(len(centroids)):
                own = [v for (_, v), (_, j) in zip(rows, best) if j == i]
                if own:
                    centroids[i] = [sum(x) // len(own) for x in zip(*own)]
    return best, centroids


def test_clusters_are_those_of_all_comparisons(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 6)) * 3
    x = (centers[rng.integers(0, 12, 400)] + rng.normal(size=(400, 6)) * 0.4).astype(np.float32)
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[7][1]), (500, None), (501, [1.0] * 5), (502, [1.0] * 5 + [None]), (503, [float("nan")] * 6), (504, [float("inf")] + [0.0] * 5), (505, [0.0] * 6), (506, [0.0] * 6)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, centroid string").repartition(3)
    got = cluster_vectors(df, 15, 5, "2", dimension=6)
    kept = [(i, [int(np.floor(256 * float(a))) for a in v]) for i, v in rows if v is not None and len(v) == 6 and all(a is not None and np.isfinite(a) for a in v)]
    best, centroids = plain(kept, 15, 5, "2")
    inertia = sum(d for d, _ in best)
    own = {i: sum(d for d, j in best if j == i) for i in range(15)}
    want = sorted(repr((i, j, d, own[j], inertia, centroids[j])) for (i, _), (d, j) in zip(kept, best))
    assert sorted(repr((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid)) for r in got.collect()) == want


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    few = cluster_vectors(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)], schema), 40, 5, "2", dimension=2).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)] and len({r.cluster for r in few}) == 1  # ties: the smaller number
    assert cluster_vectors(spark.createDataFrame([], schema), 40, 5, "2").count() == 0
    assert cluster_vectors(spark.createDataFrame([(1, None)], schema), 40, 5, "2").count() == 0
    with pytest.raises(Exception, match="no longs"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0])], schema), 2, 1, "2", dimension=2).collect()


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 9), st.integers(1, 3), st.sampled_from([3, 40, 10_000, 3_000_000, 40_000_000]))
def test_balls_assign_as_all_comparisons_do(seed, k, d, size):
    """Ties, equal centroids, centroids that moved or stayed, and numbers too large for doubles."""
    rng = np.random.default_rng(seed)
    v = rng.integers(-size, size + 1, (60, d))
    before = v[rng.integers(0, 60, k)]
    cluster, far, _ = Balls(before).assign(v, np.zeros(60, np.int64))
    assert (cluster == squared(v, before).argmin(axis=1)).all()
    greatest = np.zeros(k, np.int64)
    np.maximum.at(greatest, cluster, far)
    for moves in (0, 1, k):
        after = before.copy()
        after[:moves] += rng.integers(-size // 2, size // 2 + 1, (moves, d))
        got, distance, _ = Balls(after, greatest, before).assign(v, cluster)
        d2 = ((v[:, None].astype(object) - after[None].astype(object)) ** 2).sum(axis=2)
        assert got.tolist() == [int(r.argmin()) for r in d2] and distance.tolist() == [int(r.min()) for r in d2]


def test_cores_and_balls_that_stay_are_not_compared():
    rng = np.random.default_rng(1)
    centers = rng.integers(-9000, 9000, (30, 8))
    v = centers[rng.integers(0, 30, 3000)] + rng.integers(-60, 61, (3000, 8))
    before = centers + 3
    cluster, far, all_of_them = Balls(before).assign(v, np.zeros(3000, np.int64))
    greatest = np.zeros(30, np.int64)
    np.maximum.at(greatest, cluster, far)
    _, _, computed = Balls(centers, greatest, before).assign(v, cluster)
    assert all_of_them == 30 * 3000 and computed < 1.2 * 3000
    assert Balls(before, greatest, before).still.all()
    moved = before.copy()
    moved[0] += 1
    assert not Balls(moved, greatest, before).still[0] and Balls(moved, greatest, before).still.sum() > 20


def test_the_limit_keeps_distances_longs():
    for d in (1, 64, 4096):
        assert 4 * d * (2 * limit(d)) ** 2 < 2**63 <= 4 * d * (2 * (limit(d) + 2)) ** 2
    assert balls.limit(64) > isqrt(2**51)
