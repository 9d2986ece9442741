import json
import random

import pytest
from pyspark.sql import functions as F

from tallyband.jobs import files
from tallyband.sources import readers, splits, writers
from tallyband.sources.casts import cast_columns

TYPES = {"id": "number", "length": "number", "sail": "number"}


def test_ragged_csv(spark, tmp_path):
    path = tmp_path / "boats.csv"
    path.write_text("id,name,port,length,sail\n7,Heron,Ness,40,yes,beyond\n8,Otter,,22,no\n9,Wren,Holm,15e-1\n")
    rows = readers.read_csv(spark, str(path), TYPES).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(7, "Heron", "Ness", 40, 1), (8, "Otter", None, 22, 0), (9, "Wren", "Holm", 1.5, None)]
    assert readers.read_csv(spark, str(path)).dtypes == [(c, "string") for c in ("id", "name", "port", "length", "sail")]


def test_encodings(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name\nárvíz\n".encode("iso-8859-1"))
    assert readers.read_csv(spark, str(path), encoding="ISO-8859-1").first()[0] == "árvíz"


def test_json_and_xml(spark, tmp_path):
    rows = [{"id": 7, "name": "Heron", "length": 40, "sail": "yes"}, {"id": 9, "name": "Wren", "length": "15e-1", "sail": "no"}]
    (tmp_path / "d.json").write_text(json.dumps({"columns": ["id", "name", "length", "sail"], "rows": rows}))
    got = readers.read_json_rows(spark, str(tmp_path / "d.json"), TYPES).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(7, "Heron", 40, 1), (9, "Wren", 1.5, 0)]
    (tmp_path / "e.json").write_text(json.dumps({"columns": ["id", "name"], "coltypes": ["number", "string"], "rows": rows}))
    assert readers.read_json_rows(spark, str(tmp_path / "e.json")).dtypes == [("id", "double"), ("name", "string")]
    (tmp_path / "d.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert readers.read_json_lines(spark, str(tmp_path / "d.jsonl"), ["id", "length"], TYPES).agg(F.sum("length")).first()[0] == 41.5
    cells = "".join(f"<row><col>{r['id']}</col><col>{r['name']}</col></row>" for r in rows)
    (tmp_path / "d.xml").write_text(f'<?xml version="1.0"?><data><rows>{cells}<row><col>11</col></row></rows><fields><field>id</field><field>name</field></fields></data>')
    got = readers.read_xml_rows(spark, str(tmp_path / "d.xml"), types={"id": "number"}).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(7, "Heron"), (9, "Wren"), (11, None)]


def test_jdbc_in_parts(spark, tmp_path):
    """Against the database that Spark brings along."""
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 3).alias("V")).write.jdbc(url, "T", properties=driver)
    whole = readers.read_jdbc(spark, url, "SELECT ID, V FROM T WHERE ID < 50", fetch_rows=7, **driver)
    assert whole.agg(F.count("*"), F.sum("V")).first() == (50, 3675)
    parts = readers.read_jdbc(spark, url, "SELECT ID, V FROM T", partition=("ID", 0, 100, 4), **driver)
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.count("*"), F.sum("V")).first() == (100, 14850)


def test_jdbc_parts_by_the_data(spark, tmp_path):
    """Bounds from histograms: outliers, a value with half of the rows, NULLs, an empty table."""
    url = f"jdbc:derby:{tmp_path}/db2;create=true"
    driver = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    key = F.when(F.col("id") % 2 == 0, 7).when(F.col("id") % 11 == 1, None).when(F.col("id") == 999, 10**9).otherwise(F.col("id"))
    spark.range(1000).select(F.col("id").alias("ID"), key.cast("long").alias("K")).coalesce(1).write.jdbc(url, "T", properties=driver)
    parts = readers.read_jdbc_parts(spark, url, "SELECT ID, K FROM T", "K", 5, **driver)
    assert sorted(r.ID for r in parts.collect()) == list(range(1000)) and parts.schema["K"].nullable
    sizes = [r["count"] for r in parts.filter("K IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 560  # the value with half of the rows and what is beside it
    rest = sorted(r["count"] for r in parts.filter("K <> 7").groupBy(F.spark_partition_id()).count().collect())
    assert rest[-1] < 220
    assert readers.read_jdbc_parts(spark, url, "SELECT ID, K FROM T WHERE ID < 0", "K", 5, **driver).count() == 0


@pytest.fixture
def small_blocks(spark):
    """Files are cut every few bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


CELLS = ["plain", 'q"uote', '"', '""', "a\nb", "\n", "\n\n\"x\n", "one\r\ntwo", "se,p", "", " blank ", "long " * 60 + "\n" + "more\"" * 30, "é\n日本", "back\\slash", "end\\"]


def test_csv_cut_anywhere(spark, tmp_path, small_blocks):
    rng = random.Random(3)
    for name in ("a.csv", "b.csv"):
        rows = [(f"{name}{k}", rng.choice(CELLS), rng.choice(CELLS)) for k in range(60)]
        quoted = lambda x: '"' + x.replace('"', '""') + '"'
        (tmp_path / name).write_bytes(("id,one,two\n" + "".join(f"{i},{quoted(a)},{quoted(b)}\n" for i, a, b in rows)).encode())
        got = {r.id: (r.one, r.two) for r in readers.read_csv(spark, str(tmp_path / name), line_ends=True).collect()}
        assert got == {i: (a or None, b or None) for i, a, b in rows}
        pieces = splits.pieces(spark, str(tmp_path / name), "\n")
        assert pieces.select("__block").distinct().count() > 20
    assert readers.read_csv(spark, str(tmp_path), columns=["id", "one", "two"], line_ends=True).count() == 120
    (tmp_path / "none.csv").write_text("id,one\n")
    assert readers.read_csv(spark, str(tmp_path / "none.csv"), line_ends=True).collect() == []


@pytest.mark.parametrize("indent", [None, 1])
def test_json_cut_anywhere(spark, tmp_path, small_blocks, indent):
    rng = random.Random(4)
    rows = [{"id": k, "text": rng.choice([*CELLS, "}", "{", "]},{", '"rows": [', "\\", '\\"}', None]), "x}y": rng.choice([1.5, True, None, "5e-1"])} for k in range(80)]
    for k, whole in enumerate(({"columns": ["id", "text", "x}y"], "coltypes": ["number", "string", "string"], "rows": rows}, {"rows": rows, "columns": ["id", "text", "x}y"]}, {"columns": ["id", "text", "x}y"], "rows": []})):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(whole, indent=indent))
        got = sorted((int(float(r[0])), r[1], r[2]) for r in readers.read_json_rows(spark, str(path)).collect())
        as_text = {True: "true", None: None, 1.5: "1.5", "5e-1": "5e-1"}
        assert got == [(r["id"], r["text"], as_text[r["x}y"]]) for r in whole["rows"]]


def test_memory_and_own_formats(spark):
    table = readers.from_rows(spark, [("id", "when"), (1, "7/9/2011"), (None, None)], {"id": "number", "when": "datetime"})
    assert [tuple(map(str, r)) for r in table.orderBy("id").collect()] == [("None", "None"), ("1.0", "2011-09-07 00:00:00")]
    readers.register_source(spark, "counting", "n int", lambda o: range(int(o["parts"])), lambda p: [(p * 10,), (p * 10 + 1,)])
    assert sorted(r.n for r in spark.read.format("counting").option("parts", 3).load().collect()) == [0, 1, 10, 11, 20, 21]


def _lines(path):
    return sorted(x for p in path.glob("part-*") for x in p.read_text().splitlines())


def test_csv_quotes(spark, tmp_path):
    table = spark.createDataFrame([(1, 'say "hi", now'), (2, None)], "n int, s string").coalesce(1)
    for quotes in ("all", "strings", "none"):
        writers.write_csv(table, str(tmp_path / quotes), quotes=quotes)
    assert '1,"say ""hi"", now"' in _lines(tmp_path / "strings") and '2,""' in _lines(tmp_path / "strings")
    assert '1,say "hi", now' in _lines(tmp_path / "none")
    assert '"1","say ""hi"", now"' in _lines(tmp_path / "all")
    assert _lines(tmp_path / "none") == ["1,say \"hi\", now", "2,", "n,s"]
    writers.write_csv(table, str(tmp_path / "tabs"), sep="\t", quotes="none")
    writers.write_csv(table.limit(0), str(tmp_path / "empty"))
    assert _lines(tmp_path / "empty") == ['"n","s"'] and readers.read_csv(spark, str(tmp_path / "empty")).columns == ["n", "s"]
    assert "2\t" in _lines(tmp_path / "tabs")


def test_sections_to_files(spark, tmp_path):
    table = spark.createDataFrame([("fielddetails", 1, "ab"), ("reportfooter", 2, None)], "section string, n int, s string").coalesce(1)
    writers.write_json(table, str(tmp_path / "j"))
    assert '{"section":"fielddetails","n":1,"s":"ab"}' in _lines(tmp_path / "j")
    writers.write_xml(table, str(tmp_path / "x"))
    assert any("<section>reportfooter</section>" in x for x in _lines(tmp_path / "x"))
    writers.write_lines(table, [(F.col("s"), 4, "left"), (F.col("n"), 3, "right"), (F.col("section"), 5, "center"), (F.col("s"), 5, "center")], str(tmp_path / "t"))
    assert _lines(tmp_path / "t") == ["      2repor     ", "ab    1field ab  "]


def test_casts_leave_other_columns(spark):
    table = spark.createDataFrame([("1", "x y")], "`a.b` string, c string")
    assert cast_columns(table, {"a.b": "number"}).first() == (1.0, "x y")


def test_documents_are_written_by_many_tasks(spark, tmp_path):
    """One task wrote all rows into one file before; now each file is a document of its own, an empty one too."""
    spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit('a"}],{"'), F.col("id")).alias("text"), F.lit(None).cast("string").alias("lang")).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    found = files.json_document_in_parts(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.lang) for r in found.collect()) == [(float(k), f'a"}}],{{"{k}', None) for k in range(40)]
    assert len(found.inputFiles()) > 1
