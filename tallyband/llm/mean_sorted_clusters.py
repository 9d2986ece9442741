"""Clusters around centroids: Lloyd's rounds in whole numbers, nearest centroids by equal-average equal-variance search.

Centroids are sorted by the mean of their components. The search for a vector starts at the centroid whose mean is next to the
vector's and goes outward on both sides. With n components, means m and deviations v (the root of the squared
distances to the mean), the squared distance of x and c is at least n (m_x - m_c)^2 + (v_x - v_c)^2. A side ends where the first term
alone is over the best distance so far; a centroid is passed over where the sum is. Both bounds are rounded down, and the
distances of all that remain are exact whole numbers, so the result is that of a full search, ties included.

A round sends each task the centroids and gets back count and component sums for each cluster and task, added up by Spark; the driver
holds the centroids alone. A cluster may hold any share of the vectors.

Defined results: vectors that are null, have another number of components, or a null or non-finite one take no part; nor do those
with a component of 2^17 or more, whose distances a long couldn't hold. A null vec_id is hashed as the empty text and stays null;
repeated rows each count. With fewer vectors than clusters each of them starts one; none give an empty result. Only
vec_id and embedding are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyband.llm.common import mapped, work_table

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
#: Components at or over it would make distances that a long can't hold.
MOST = 1 << 17


def _deviations(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Deviation of each row, and how far rounding may have put it off."""
    square = (x.astype(np.float64) ** 2).sum(axis=1)
    return np.sqrt(np.maximum(0.0, square - x.sum(axis=1).astype(np.float64) ** 2 / n)), 1e-6 * np.sqrt(square)


class Centroids:
    """Centroids (whole numbers, a row each) and what the search needs of them."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.int64)
        n = self.points.shape[1]
        total = self.points.sum(axis=1)
        self.order = np.lexsort((np.arange(len(total)), total))
        self.total = total[self.order].astype(np.float64)
        self.deviation, self.room = (v[self.order] for v in _deviations(self.points, n))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For vectors (whole numbers, a row each): the nearest centroid, ties to the smaller number; its squared distance; how many distances were computed."""
        rows, n = x.shape
        k = len(self.order)
        total = x.sum(axis=1).astype(np.float64)
        deviation, room = _deviations(x, n)
        best, number = np.full(rows, np.iinfo(np.int64).max), np.full(rows, k, np.int64)
        computed = 0

        def tried(who: np.ndarray, place: np.ndarray) -> None:
            nonlocal computed
            computed += len(who)
            own = self.order[place]
            away = x[who] - self.points[own]
            distance = np.einsum("ij,ij->i", away, away)
            better = (distance < best[who]) | ((distance == best[who]) & (own < number[who]))
            best[who[better]], number[who[better]] = distance[better], own[better]

        start = np.clip(np.searchsorted(self.total, total), 0, k - 1)
        left = np.maximum(start - 1, 0)
        start = np.where(np.abs(self.total[left] - total) < np.abs(self.total[start] - total), left, start)
        everyone = np.arange(rows)
        tried(everyone, start)
        sides = {1: everyone, -1: everyone}
        for step in range(1, k):
            for side, who in sides.items():
                place = start[who] + side * step
                who, place = who[inside := (place >= 0) & (place < k)], place[inside]
                mean = (self.total[place] - total[who]) ** 2 / n
                limit = best[who].astype(np.float64) * (1 + 1e-9) + 1  # the bounds are floats, so leave them room
                going = mean <= limit  # further out the means differ more
                who, place, mean, limit = who[going], place[going], mean[going], limit[going]
                sides[side] = who
                apart = np.maximum(0.0, np.abs(self.deviation[place] - deviation[who]) - self.room[place] - room[who])
                close = mean + apart**2 <= limit
                tried(who[close], place[close])
        return number, best, computed


def whole_numbers(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id and point (array of int) of the vectors that take part."""
    x = F.col("embedding")
    sound = (F.size(x) == components) & F.forall(x, lambda v: F.coalesce(F.abs(v.cast("double")) < MOST, F.lit(False)))
    point = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("int"))
    return vectors.filter(x.isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), point.alias("point"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.int64).reshape(len(column), -1)


def _sums(centroids: Broadcast):
    """For each cluster that a task has vectors of: cluster, n, sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids.value)
        k, n = search.points.shape
        count, total = np.zeros(k, np.int64), np.zeros((k, n), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("point"))
            number, _, _ = search.nearest(x)
            count += np.bincount(number, minlength=k)
            np.add.at(total, number, x)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Centroids(centroids.value)
        for batch in batches:
            if batch.num_rows:
                number, distance, _ = search.nearest(_matrix(batch.column("point")))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return run


def fitted(points: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """The centroids after all rounds; points: a stored table of whole_numbers()."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = points.orderBy(key, "point").limit(clusters).collect()  # as many rows as there are clusters
    centroids = np.array([r["point"] for r in first], np.int64)
    context = points.sparkSession.sparkContext
    for _ in range(rounds if len(centroids) else 0):
        partial = mapped(points, _sums(context.broadcast(centroids)), "cluster int, n long, sums array<bigint>")
        each = partial.select("cluster", "n", F.posexplode("sums").alias("place", "x"))
        found = each.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()  # clusters x components
        centroids = centroids.copy()
        for r in found:
            centroids[r["cluster"], r["place"]] = int(r["x"]) // r["n"]
    return centroids


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that takes part."""
    spark = vectors.sparkSession
    points = work_table(whole_numbers(vectors, components, scale), "points")
    centroids = fitted(points, clusters, rounds, seed)
    rows = work_table(mapped(points, _assigned(spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long"), "clusters") if len(centroids) else spark.createDataFrame([], "vec_id long, cluster int, distance long")
    digests = [(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    each = rows.groupBy("cluster").agg(total.alias("x"))  # a row a cluster
    whole = each.agg(F.sum("x").try_cast("long").alias("inertia"))
    each = each.select("cluster", F.col("x").try_cast("long").alias("cluster_inertia"))
    out = rows.join(F.broadcast(each), "cluster").join(F.broadcast(named), "cluster").join(F.broadcast(whole))  # one row
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
