"""Centroid clustering by balls, in whole numbers.

A cluster is a ball: its centroid, and a radius that no member lies beyond. Only balls whose centroids lie within twice that
radius are its neighbours; no other centroid can be nearer to a member. A member nearer to its own centroid than half the
way to the nearest neighbour is in the ball's core and stays. The rest of the ball is annuli: a member between half the way
to its j-th neighbour and half the way to the next one is compared with the first j neighbours alone, exactly. A ball none
of whose neighbours moved, nor itself, is left alone.

Each round is two narrow passes over the vectors: assignment, and sums by cluster. Only centroids, counts and greatest
distances (as many as there are clusters) come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written

#: Vectors whose distances are computed at once.
TOGETHER = 8192
#: Components of all centroids together, at most: they are in every task and on the driver.
MOST_COMPONENTS = 4_000_000


def limit(dimension: int) -> int:
    """Components must stay below this, so that four times any squared distance is a long."""
    return isqrt((1 << 63) // (16 * max(dimension, 1))) - 1


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of v to the rows of c, exact: as products of doubles where all sums stay below 2**53."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(c).max(initial=0)))
    if (2 * most) ** 2 * v.shape[1] < 1 << 53:
        x, y = v.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ y.T) + (y * y).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((v - row) ** 2).sum(axis=1) for row in c], axis=1) if len(c) else np.zeros((len(v), 0), np.int64)


class Balls:
    """centroids (whole numbers); far: of each ball the greatest squared distance of a member to before's centroid, from which
    the radius follows, or None in the first round; before: the centroids of the last assignment."""

    def __init__(self, centroids: np.ndarray, far: np.ndarray | None = None, before: np.ndarray | None = None):
        self.centroids, self.first = centroids, far is None
        if self.first:
            return
        gaps = squared(centroids, centroids)
        drift = [int(x) for x in ((centroids - before) ** 2).sum(axis=1)]
        # a member is no farther from the new centroid than from the old one, and the way between them; roots rounded up
        radius = [(isqrt(int(r)) + 1 if r else 0) + (isqrt(m) + 1 if m else 0) for r, m in zip(far, drift)]
        self.neighbours, self.gaps, self.still = [], [], np.zeros(len(centroids), bool)
        moved = np.array(drift) > 0
        for i, r in enumerate(radius):
            near = np.flatnonzero(gaps[i] <= min(4 * r * r, (1 << 63) - 1))
            near = near[near != i]
            near = near[np.argsort(gaps[i][near], kind="stable")]
            self.neighbours.append(near)
            self.gaps.append(gaps[i][near])
            self.still[i] = not moved[i] and not moved[near].any()

    def assign(self, v: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest centroid of each vector (of equally near ones the smaller number), its squared distance, and how many distances were computed."""
        if self.first:
            d = squared(v, self.centroids)
            best = d.argmin(axis=1)
            return best, d[np.arange(len(v)), best], d.size
        out, distance, computed = cluster.astype(np.int64), np.zeros(len(v), np.int64), len(v)
        order = np.argsort(cluster, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
            if not len(rows):
                continue
            i = int(cluster[rows[0]])
            own = squared(v[rows], self.centroids[i : i + 1])[:, 0]
            distance[rows] = own
            if self.still[i]:
                continue
            ring = np.searchsorted(self.gaps[i], 4 * own, side="right")  # how many neighbours lie at twice the distance or nearer
            rows, own, ring = (x[ring > 0] for x in (rows, own, ring))  # the others are the core
            outer = np.argsort(-ring, kind="stable")
            rows, own, ring = rows[outer], own[outer], ring[outer]
            x, best, least = v[rows], np.full(len(rows), i), own
            for t, j in enumerate(self.neighbours[i][: ring[0] if len(ring) else 0]):
                n = int(np.searchsorted(-ring, -t, side="left"))  # those whose annulus reaches to this neighbour
                d = squared(x[:n], self.centroids[j : j + 1])[:, 0]
                computed += n
                nearer = (d < least[:n]) | (d == least[:n]) & (j < best[:n])
                best[:n][nearer], least[:n][nearer] = j, d[nearer]
            out[rows], distance[rows] = best, least
        return out, distance, computed


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """(id, v): the vectors of that many components, none null or not finite, as whole numbers floor(scale * x)."""
    v = F.transform(vectors[vector_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].alias("id"), v.alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where((F.size("v") == dimension) & ~odd).select("id", F.transform("v", lambda x: F.floor(scale * x)).alias("v"))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    v = column.flatten().to_numpy().reshape(-1, dimension)
    if len(v) and max(int(v.max()), -int(v.min())) >= limit(dimension):
        raise ValueError(f"components of {limit(dimension)} and more, times the scale, have squared distances that are no longs")
    return v


def _assigned(rows: DataFrame, balls: Balls, dimension: int) -> DataFrame:
    """rows (id, v, and the cluster they were in) with cluster and distance."""
    id_type = rows.schema["id"].dataType.simpleString()
    again = "cluster" in rows.columns

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, TOGETHER):
                part = b.slice(k, TOGETHER)
                before = part.column(2).to_numpy() if again else np.zeros(part.num_rows, np.int64)
                cluster, distance, _ = balls.assign(_matrix(part.column(1), dimension), before)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cluster.astype(np.int32)), pa.array(distance)], ["id", "v", "cluster", "distance"])

    return rows.mapInArrow(assign, f"id {id_type}, v array<bigint>, cluster int, distance bigint")


def _sums(rows: DataFrame, k: int, dimension: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Of each cluster its members, the greatest squared distance and the sums of components; each task tells one row a cluster."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, dimension), np.int64)
        for b in batches:
            v, cluster, distance = _matrix(b.column(0), dimension), b.column(1).to_numpy(), b.column(2).to_numpy()
            n += np.bincount(cluster, minlength=k)
            np.maximum.at(far, cluster, distance)
            np.add.at(sums, cluster, v)
        on = np.flatnonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(on) + 1) * dimension, pa.int32()), pa.array(sums[on].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int32)), pa.array(n[on]), pa.array(far[on]), lists], ["cluster", "n", "far", "sums"])

    part = rows.select("v", "cluster", "distance").mapInArrow(add, "cluster int, n bigint, far bigint, sums array<bigint>")
    flat = part.select("cluster", "n", "far", F.posexplode("sums").alias("at", "x"))
    total = flat.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.max("far").alias("far"), F.sum("x").alias("x"))
    n, far, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), [[0] * dimension for _ in range(k)]
    for r in total.collect():  # a row for each component of a centroid
        n[r.cluster], far[r.cluster] = r.n, r.far
        sums[r.cluster][r["at"]] = r.x
    return n, far, sums


def cluster_vectors(vectors: DataFrame, k: int, rounds: int, seed: str, id_col: str = "vec_id", vector_col: str = "embedding", dimension: int = 64, scale: int = 256) -> DataFrame:
    """One row for each vector that is kept: id, cluster, distance (squared), cluster_inertia, inertia, centroid (array<long>).

    Kept are vectors of the given dimension without null or non-finite components, as whole numbers floor(scale * component).
    Centroids 0, 1, ... start as the k kept vectors with the smallest lowercase-hex sha256 of seed, ':' and the id (all of them, if
    there are fewer; rows with a null id come last; those with equal ids by their components). Each round assigns all
    vectors and replaces each non-empty centroid by the floor of the mean of its vectors; then all are assigned once more.
    Of equally near centroids that with the smaller number counts. Repeated rows count each; other columns are ignored.
    Components, times the scale, of limit(dimension) or more raise. Without kept vectors there are no rows.

    A round shuffles one row for each task and centroid. Centroids are in every task; their components are bounded by MOST_COMPONENTS.
    """
    if k * dimension > MOST_COMPONENTS:
        raise ValueError(f"{k} centroids of {dimension} components are more than {MOST_COMPONENTS} numbers")
    state = written(whole_vectors(vectors, id_col, vector_col, dimension, scale), "whole-vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = state.orderBy(key.asc_nulls_last(), "v").limit(k).select("v").collect()
    centroids = np.array([r.v for r in start], np.int64).reshape(-1, dimension)
    balls = Balls(centroids)
    for at in range(rounds + 1):
        new = written(_assigned(state, balls, dimension), "clusters")
        forget(state)
        state = new
        if at == rounds or not len(centroids):
            break
        n, far, sums = _sums(state, len(centroids), dimension)
        moved = np.array([[x // int(m) for x in s] if m else list(c) for s, m, c in zip(sums, n, centroids)], np.int64).reshape(-1, dimension)
        balls, centroids = Balls(moved, far, centroids), moved
    spark = vectors.sparkSession
    inertia = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total, own = int(sum(r.s for r in inertia)), {r.cluster: int(r.s) for r in inertia}
    about = [(i, own[i], total, [int(x) for x in c]) for i, c in enumerate(centroids) if i in own]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return state.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")

