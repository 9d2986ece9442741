import numpy as np
from pyspark.sql import functions as F

from tallyband.llm import pivot_index

SCHEMA = "vec_id long, embedding array<float>, tag string, v string"


def plain(rows, k=5, every=50):
    sound = []
    for i, x, *_ in rows:
        if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            sound.append((i, [int(np.floor(256 * float(np.float32(c)))) for c in x]))
    out = []
    for a, (i, x) in enumerate(sound):
        if i % every == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(sound) if b != a)  # noqa: B905
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def check(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    got = pivot_index.top_k(table, F.col("vec_id") % 50 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain(rows)


def test_random_clustered_and_repeated_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(c) for c in centres[i % 6] + rng.normal(0, 0.1, 8)], "t", "v") for i in range(900)]
    rows += [(900 + i, [0.5] * 8, "t", "v") for i in range(150)]  # one vector, many rows
    check(spark, rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0], None, None), (50, [1.0, 2.0], None, None), (50, [1.0, 2.0], None, None), (1, None, None, None),
        (2, [1.0, None], None, None), (3, [nan, 1.0], None, None), (4, [inf, 1.0], None, None), (None, [9.0, 9.0], None, None),
        (100, [0.0, 0.0], None, None), (5, [-3.0, 0.25], None, None), (6, [2.0], None, None), (-50, [-1.0, 1.0], None, None), (7, [], None, None),
    ]
    check(spark, rows)
    check(spark, rows[:1])
    check(spark, [(0, [1e12, 3.0], None, None), (1, [7.0, 1.0], None, None), (2, [1.0, 1.0], None, None)])
    assert pivot_index.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0


def test_bounds_stop_most_annuli(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16)) * 3
    x = np.floor(256 * (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 0.05, (4000, 16))))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<double>").select(F.col("vec_id").alias("tag"), "vec_id", "v")
    _, _, index = pivot_index.build(rows, pivot_index._fit(rows))
    q = x[:50]
    least = np.sort(q @ x.T, axis=1)[:, -6]
    visited = (index.best_possible(q) >= least[:, None]).mean()
    assert visited < 0.35


def test_rows_are_the_same_however_scans_split_the_files(spark, tmp_path):
    """As where cores join or leave between two scans: a query must still know its own row in the sample."""
    rng = np.random.default_rng(9)
    rows = [(i, [float(c) for c in rng.normal(size=6)], "t", "v") for i in range(400)]
    spark.createDataFrame(rows, SCHEMA).repartition(16).write.parquet(str(tmp_path / "v"))
    real, costs = pivot_index._fit, iter(["0", "4194304"])

    def fit(table):
        found = real(table)
        spark.conf.set("spark.sql.files.openCostInBytes", next(costs))
        return found

    try:
        pivot_index._fit = fit
        got = pivot_index.top_k(spark.read.parquet(str(tmp_path / "v")), F.col("vec_id") % 50 == 0)
        assert sorted(map(tuple, got.collect())) == plain(rows)
    finally:
        pivot_index._fit = real
        spark.conf.set("spark.sql.files.openCostInBytes", "4194304")


def test_an_annulus_is_dealt_to_slices(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "SLICE", 1)
    monkeypatch.setattr(pivot_index, "CHUNK", 40)
    monkeypatch.setattr(pivot_index, "PIVOTS", 1)
    rng = np.random.default_rng(3)
    check(spark, [(i, [float(c) for c in rng.normal(size=4)], "t", "v") for i in range(1200)])
