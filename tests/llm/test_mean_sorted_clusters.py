"""The clusters against brute force in whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyband.llm import mean_sorted_clusters as clusters

N = 64


def brute(rows, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == N and all(x is not None and math.isfinite(x) for x in e)]
    key = lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    last = [(i, *reversed(nearest(x))) for i, x in kept]
    total = {j: sum(d for _, c, d in last if c == j) for j in range(len(centroids))}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, total[c], sum(total.values()), names[c]) for i, c, d in last), key=str)


def found(spark, rows):
    more = [(i, e, 1, 2, "x") for i, e in rows]
    table = spark.createDataFrame(more, "vec_id long, embedding array<float>, cluster int, distance long, point string").repartition(3)
    return sorted((tuple(r) for r in clusters.clustered(table).collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(2)
    single = lambda e: [float(np.float32(x)) for x in e]
    rows = [(i, single([rng.gauss(i % 5, 0.3 + i % 3) for _ in range(N)])) for i in range(150)]
    rows += rows[:9] + [(None, rows[0][1]), (500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 65), (504, [None, *[1.0] * 63]), (505, [math.nan, *[1.0] * 63]), (506, [math.inf, *[1.0] * 63])]
    rows += [(600 + k, single([0.001 * k] * N)) for k in range(6)] + [(700, [0.0] * N), (701, [0.0] * N)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i)] * N) for i in range(n)]
    assert found(spark, rows) == brute(rows)


def test_components_too_large_take_no_part(spark):
    assert found(spark, [(1, [1e30] * N), (2, [0.5] * N)]) == brute([(2, [0.5] * N)])


@pytest.mark.parametrize("k", [1, 2, 17, 200])
def test_search_is_exact_and_passes_over_centroids(k):
    rng = np.random.default_rng(k)
    points = rng.integers(-3000, 3000, (k, 1)) + rng.integers(-200, 200, (k, 32))
    points[k // 2] = points[0]  # two equal ones: the smaller number wins
    x = rng.integers(-3500, 3500, (500, 1)) + rng.integers(-200, 200, (500, 32))
    x[0] = points[0]
    number, distance, computed = clusters.Centroids(points).nearest(x)
    whole = ((x[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert (number == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
    if k == 200:
        assert computed < 0.2 * 500 * k
