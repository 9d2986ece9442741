import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyband.llm import rule_ensemble
from tests.llm.helpers import AWKWARD, docs

LABELS = "doc_id long, quality int, toxic int"


def test_lasso_finds_the_weights_that_matter():
    rng = np.random.default_rng(0)
    x = (rng.random((3000, 20)) < 0.5).astype(float)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(3 * x[:, 4] - 2 * x[:, 9] - 0.5)))).astype(float)
    weights, bias = rule_ensemble.lasso_logistic(x, y, penalty=0.01)
    assert set(np.flatnonzero(np.abs(weights) > 0.3)) == {4, 9} and weights[4] > 0 > weights[9]
    assert (weights == 0).sum() > 8


def test_column_equals_the_rules(spark, data):
    table = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    model = rule_ensemble.fit(table, labels)
    x = np.array([rule_ensemble.statistics_of((r.text or "").encode()) for r in table.orderBy("doc_id").collect()])
    z = model.bias + sum(w * rule_ensemble._applies(r, x) for r, w in zip(model.rules, model.weights, strict=True))
    got = [r.score for r in rule_ensemble.score(table, model).orderBy("doc_id").collect()]
    assert got == pytest.approx((1 / (1 + np.exp(-z))).tolist())
    assert len(model.described()) == len(model.rules)


def test_held_out_accuracy(spark):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_ensemble.rated(table, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95


def test_awkward_rows(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    for rows in ([], [(1, 1, 0), (3, None, 0), (None, 0, 0)], [(k, k % 2, 0) for k in range(10)]):
        labels = spark.createDataFrame(rows, LABELS)
        got = rule_ensemble.rated(stored, labels).collect()
        assert len(got) == len(AWKWARD) and all(0 <= r.score <= 1 for r in got)
        assert rule_ensemble.accepted(stored, labels).dtypes == stored.dtypes
        assert rule_ensemble.rated(docs(spark, []), labels).count() == 0


def test_accepted_rows_are_those_predicted(spark, data):
    """Whole rows stay or go by their own scores, with extra columns named like statistics."""
    table = spark.read.parquet(f"{data}/documents.parquet").withColumn("upper", F.lit("u")).withColumn("row", F.array("doc_id")).withColumn("letters", F.struct("lang", "source"))
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = {r.doc_id for r in rule_ensemble.rated(table, labels).filter("predicted = 1").collect()}
    got = rule_ensemble.accepted(table, labels)
    assert got.dtypes == table.dtypes
    key = lambda r: r.doc_id
    want = [r for r in table.collect() if r.doc_id in good]
    assert sorted(got.collect(), key=key) == sorted(want, key=key) and 0 < len(want) < table.count()
    for some in (docs(spark), docs(spark, [])):
        assert rule_ensemble.accepted(some, labels).count() == rule_ensemble.rated(some, labels).filter("predicted = 1").count()
