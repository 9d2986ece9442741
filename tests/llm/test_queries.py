"""The registered queries that SQL can express, against it, and the pipeline as a whole."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyband.llm import queries, similar_texts
from tests.llm.helpers import AWKWARD, docs


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{data}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, duck, data, name):
    got = queries.QUERIES[name](spark, data)
    found = duck.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, found.fetchall()))


def _tables(spark, path, rows, labels):
    docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.mark.parametrize("rows", [AWKWARD, []])
def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path, rows):
    out = corpus_pipeline.run(spark, _tables(spark, tmp_path, rows, [(1, 1, 0), (None, 1, 0), (4, None, None)] if rows else []))
    assert out.columns == ["doc_id", "ids"]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_pipeline_stages_take_effect(spark, tmp_path, data):
    """Each stage on all that the one before kept; all but the last return the columns of documents."""
    base = spark.read.parquet(f"{data}/documents.parquet").filter("length(text) > 200").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, None, None, None, None) for r in base]
    rows += [(100_000 + r.doc_id, r.text, r.lang, r.source, r.n_chars, None, None, None, None) for r in base[:20]]
    rows += [(200_000 + r.doc_id, r.text + " end", r.lang, r.source, r.n_chars, None, None, None, None) for r in base[:20] if len(r.text.split()) > 40]
    sf = _tables(spark, tmp_path, rows, [(r[0], 1, 0) for r in rows])
    table = spark.read.parquet(f"{sf}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    after = kept["exact_copies"](spark, table, sf)
    assert after.columns == table.columns
    ids = {r.doc_id for r in after.collect()}
    best = {}
    for r in rows:
        best[r[1]] = max(best.get(r[1], -1), r[0])
    assert ids == set(best.values())
    near = kept["near_copies"](spark, after, sf)
    assert near.columns == table.columns
    left = {r.doc_id for r in near.collect()}
    same = {r.doc_id: r.component_id for r in similar_texts.similar_rows(after).collect()}
    assert left == set(same.values())
    assert not [i for i in left if 200_000 <= i < 300_000]
    mixed = kept["mix"](spark, near, sf)
    assert mixed.columns == table.columns and {r.doc_id for r in mixed.collect()} <= left
    encoded = kept["encode"](spark, mixed, sf)
    assert encoded.count() == mixed.count() and encoded.filter(F.size("ids") < 1).count() == 0
