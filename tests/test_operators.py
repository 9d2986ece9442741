import contextlib
import io
import random
import re
from fractions import Fraction

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallyband.functions.exact import exact, exact_decimal, exact_text
from tallyband.operators import breaks, fold, followers, prefix, projection, sections
from tallyband.operators.variables import CustomVariable, Variable, custom_totals, custom_variables, grand_totals, group_totals, in_rounds, running_of_breaks, running_variables
from tallyband.sources.casts import cast_columns

#: Boats: id, name, length, under sail.
BOATS = [(1, "Heron", 40.0, 1), (2, "Otter", 22.5, 1), (3, "Wren", 3.0, 1), (4, "Badger", 35.0, 0), (5, "Lynx", 19.0, 0), (6, "Mole", 1.5, 0)]


@pytest.fixture
def boats(spark):
    return spark.createDataFrame(BOATS, "id int, name string, length double, sail int")


@pytest.mark.parametrize(("per_bucket", "partitions"), [(3, 1), (7, 32), (1000, 4)])
def test_scans_do_not_depend_on_buckets(spark, per_bucket, partitions):
    rng = random.Random(3)
    rows = [(None if k % 3 == 0 else k // 3, k, rng.choice([None, *range(9)]), rng.choice("aab")) for k in range(120)]
    table = spark.createDataFrame(rows, "a int, b int, v int, g string").repartition(partitions)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        columns = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "low": ("min", F.col("v")), "c": ("count", F.col("v"))}
        whole = {r.b: r for r in prefix.running(table, ["a", "b"], columns, rows_per_bucket=per_bucket).collect()}
        groups = {r.b: r for r in prefix.running(table, ["a", "b"], columns, ["g"], per_bucket).collect()}
        before = {r.b: r for r in prefix.previous(table, ["a", "b"], {"p": F.col("v"), "q": F.col("g")}, per_bucket).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, by = [], {}
    for k, (_, b, v, g) in enumerate(rows):
        assert (before[b].p, before[b].q) == ((None, None) if k == 0 else (rows[k - 1][2], rows[k - 1][3]))
        seen.append(v)
        by.setdefault(g, []).append(v)
        for got, values in ((whole[b], seen), (groups[b], by[g])):
            known = [x for x in values if x is not None]
            assert (got.n, got.s, got.low, got.c) == (len(values), sum(known) if known else None, min(known, default=None), len(known))


def test_one_key_with_most_rows(spark):
    table = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"))
    out = running_variables(table, ["id"], {"n": Variable("countall")}, ["k"], rows_per_bucket=100)
    assert out.filter("k = 0").agg(F.max("n")).first()[0] == 4500
    assert out.filter("k <> 0").agg(F.max("n")).first()[0] == 1


def test_buckets_are_spread_over_tasks(spark):
    """Above a few thousand rows no scan runs in one task, nor does one break of nine tenths of the rows."""
    table = spark.range(9000).select(F.col("id"), F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), (F.col("id") % 7 + 1).alias("v"))
    made = {
        "rows": prefix.row_numbers(table, ["id"]),
        "breaks": breaks.break_row_numbers(table, ["id"], ["k"]),
        "growth": fold.iterate(table, F.lit(1.0), 1 + F.col("v") / 1000, ["id"], ["k"], "g"),
        "fold": fold.running_fold(table, lambda x, v: (x * 3 + v) % 101, 5, "v", ["id"], ["k"], "f", "bigint", fold.affine(3, 101)),
        "whole fold": fold.running_fold(table, lambda x, v: (x * 3 + v) % 101, 5, "v", ["id"], [], "f", "bigint", fold.affine(3, 101)),
    }
    for name, df in made.items():
        sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        # a join of few bytes may be put together in one task at the end; the buckets may not
        assert sum(sizes) == 9000 and (max(sizes) < 9000 or name == "fold"), name
    rows = made["whole fold"].orderBy("id").collect()
    x = 5
    for r in rows:
        x = (x * 3 + r.v) % 101
        assert r.f == x
    last = made["fold"].filter("k = 0").orderBy(F.desc("id")).first()
    x = 5
    for i in range(9000):
        if i % 10 < 9:
            x = (x * 3 + i % 7 + 1) % 101
    assert last.f == x
    assert breaks.break_row_numbers(table, ["id"], ["k"]).filter("k = 0").agg(F.max("brrownum")).first()[0] == 8100
    assert breaks.matched(table, ["id"], "k").agg(F.sum("matched")).first()[0] == 8099


def test_nested_breaks(boats):
    out = breaks.break_islands(boats.withColumn("long", F.col("length") > 10), ["id"], {"sail": ["sail"], "long": ["long"]}, rows_per_bucket=2).orderBy("id").collect()
    assert [(r.sail_starts, r.long_starts) for r in out] == [(True, True), (False, False), (False, True), (True, True), (False, False), (False, True)]
    assert [(r.sail_no, r.long_no) for r in out] == [(1, 1), (1, 1), (1, 2), (2, 3), (2, 3), (2, 4)]


def test_null_break_fields_always_differ(spark):
    table = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, f string")
    assert [r.f_starts for r in breaks.break_flags(table, ["id"], {"f": ["f"]}).orderBy("id").collect()] == [True, True, True, False]


def test_averages_before_and_without_outliers(spark, boats):
    assert grand_totals(boats, {"a": Variable("average", F.col("length"))}).first().a == pytest.approx(121 / 6)
    lengths = spark.createDataFrame([(k, x) for k, x in enumerate([10.0, 20.0, 30.0, 40.0, 900.0])], "id int, length double")
    ignore = F.col("length") > 0.9 * F.col("top")
    rows = in_rounds(lengths, [([], {"top": Variable("highest", F.col("length")), "mean": Variable("average", F.col("length"))}), ([], {"fair": Variable("average", F.col("length"), ignore)})])
    got = rows.first()
    assert (got.top, got.mean, got.fair) == (900, 200, 25)


def test_variables_of_nothing_and_ignored_rows(spark):
    table = spark.createDataFrame([("a", None), ("a", None), ("b", 4), ("b", None), ("b", 8)], "g string, v int")
    made = {k: Variable(k, F.col("v"), F.col("v") > 5) for k in ("count", "sum", "average", "averageall", "lowest", "highest")} | {"countall": Variable("countall", None, F.col("v") > 5)}
    got = {r.g: r for r in group_totals(table, ["g"], made).collect()}
    assert (got["a"]["count"], got["a"]["sum"], got["a"].average, got["a"].averageall, got["a"].lowest, got["a"].countall) == (0, 0, None, 0, None, 2)
    assert (got["b"]["count"], got["b"]["sum"], got["b"].average, got["b"].averageall, got["b"].highest, got["b"].countall) == (1, 4, 4, pytest.approx(4 / 3), 4, 2)
    with pytest.raises(ValueError):
        Variable("median")


def test_matched_never_matches_null(spark):
    table = spark.createDataFrame([(1, "p"), (2, "q"), (3, "q"), (4, "p"), (5, None), (6, None)], "id int, port string")
    assert [r.matched for r in breaks.matched(table, ["id"], "port").orderBy("id").collect()] == [0, 0, 1, 1, 0, 0]


#: Ports, their quays (none at the fourth) and the quays' cranes (at some only).
PORTS = [("1", "Ness"), ("2", "Holm"), ("3", "Vik"), ("4", "Sund")]
QUAYS = [("10", "1", "north"), ("11", "1", "east"), ("12", "1", "west"), ("13", "2", "old"), ("14", "3", "fish"), ("15", "3", "coal")]
CRANES = [("11", "red"), ("11", "blue"), ("13", "grey"), ("15", "green"), ("15", "black")]


def test_chains_and_first_matches(spark):
    port = spark.createDataFrame(PORTS, "id string, name string")
    quay = spark.createDataFrame(QUAYS, "quay string, port_id string, side string").withColumn("ord", -F.col("quay").cast("int"))
    crane = spark.createDataFrame(CRANES, "at string, crane string")
    rows = followers.chain(port, (quay, F.col("id") == F.col("port_id")), (crane, F.col("quay") == F.col("at"))).collect()
    assert len(rows) == 9 and [tuple(r)[2:] for r in rows if r.id == "4"] == [(None,) * 6]
    assert sorted(r.crane for r in rows if r.id == "1" and r.crane) == ["blue", "red"]
    first = followers.first_match(port, quay, {"id": "port_id"}, ["ord"]).orderBy("id").collect()
    assert [r.side for r in first] == ["west", "old", "coal", None]
    same = followers.first_match_where(port, ["id"], quay, F.col("id") == F.col("port_id"), ["ord"]).orderBy("id").collect()
    assert [r.side for r in same] == [r.side for r in first]


def test_zip(spark):
    left = spark.createDataFrame([(k, f"l{k}") for k in range(5)], "a int, l string")
    right = spark.createDataFrame([(k, f"r{k}") for k in range(3)], "b int, r string")
    for per in (1, 100):
        rows = followers.zip_follower(left, ["a"], right, ["b"], per).orderBy("a").collect()
        assert [r.r for r in rows] == ["r0", "r1", "r2", None, None]
    assert followers.zip_follower(right, ["b"], left, ["a"]).count() == 3


@pytest.mark.parametrize("hot", [3, 20_000])
@pytest.mark.parametrize("scale", [1.0, 1e-12, 1e14])
def test_range_joins_against_all_pairs(spark, scale, hot):
    """Narrow, wide, empty, nested, repeated and unknown ranges; values that are far out, repeated or unknown; hot nodes."""
    rng = random.Random(8)
    inf, nan = float("inf"), float("nan")
    xs = [*enumerate([*(scale * rng.uniform(-5, 20) for _ in range(80)), *[scale * 3.25] * 20, 0.0, -0.0, None, 1e300, -1e300, inf, -inf])]
    bands = [(lo := scale * rng.uniform(-5, 20), lo + scale * rng.uniform(-1, 6) * 10 ** rng.uniform(-6, 0)) for _ in range(40)]
    bands += [(-inf, inf), (-1e9 * scale, 1e9 * scale), (scale * 3.25, scale * 3.25), (None, scale), (0.0, None), (scale * 5, inf), (-inf, 0.0)] + [(scale * 2, scale * 4)] * 15
    bands = [(k, *b) for k, b in enumerate(bands)]
    left = spark.createDataFrame(xs, "x int, v double").repartition(3)
    right = spark.createDataFrame(bands, "b int, v2 double, hi double").withColumnRenamed("v2", "lo").repartition(3)
    hits = {x: [b for b, lo, hi in bands if None not in (v, lo, hi) and lo <= v <= hi] or [None] for x, v in xs}
    got = followers.range_join(left, "v", right, "lo", "hi", hot)
    assert got.columns == ["x", "v", "b", "lo", "hi"]
    assert sorted(((r.x, r.b) for r in got.collect()), key=str) == sorted(((x, b) for x, bs in hits.items() for b in bs), key=str)
    first = followers.first_match_in_range(left, "v", right, "lo", "hi", ["b"], hot).collect()
    assert {r.x: r.b for r in first} == {x: bs[0] for x, bs in hits.items()} and len(first) == len(xs)
    assert nan not in hits


def test_a_wide_range_is_a_row_or_two(spark):
    """An interval over the whole domain is no longer copied to the bins that it spans."""
    left = spark.range(2000).select(F.col("id").alias("v"))
    right = spark.createDataFrame([(1, 0, 10**9), (2, 5, 5), (3, 10, 9)], "b int, lo long, hi long")
    out = followers.range_join(left, "v", right, "lo", "hi")
    assert out.count() == 2001 and out.filter("b = 3").count() == 0
    dates = spark.sql("SELECT DATE'2024-01-01' + CAST(id AS INT) AS d FROM range(50)")
    spans = spark.sql("SELECT 1 AS b, DATE'2024-01-10' AS lo, DATE'2024-01-12' AS hi")
    assert followers.range_join(dates, "d", spans, "lo", "hi").filter("b = 1").count() == 3
    assert followers.range_join(dates, "d", spans.limit(0), "lo", "hi").count() == 50


def shuffled_rows(spark, run):
    """Rows that the stages of run() write to shuffles."""
    store, array = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, array, spark._jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


def test_group_totals_of_a_source(spark):
    """Totals are read from the table that a scan's rows come from; the scan isn't run twice."""
    table = spark.range(0, 40_000, 1, 4).select("id", (F.col("id") % 7).alias("g"), (F.col("id") % 10).alias("v"))
    found = []

    def run():
        rows = prefix.running(table, ["id"], {"s": ("sum", F.col("v"))}, ["g"])
        found.append(group_totals(rows, ["g"], {"t": Variable("sum", F.col("v"))}, table).agg(F.sum("s"), F.sum("t"), F.count("*")).first())

    assert shuffled_rows(spark, run) < 40_000 * 1.8
    sums, running = [0] * 7, 0
    for k in range(40_000):
        sums[k % 7] += k % 10
        running += sums[k % 7]
    assert [tuple(r) for r in found] == [(running, sum(sums[k % 7] for k in range(40_000)), 40_000)]


@pytest.mark.parametrize("by", [[], ["g"]])
def test_scans_shuffle_rows_once(spark, by):
    """Also with as many groups as a tenth of the rows; what is carried is sums. One group has half of the rows."""
    table = spark.range(0, 40_000, 1, 4).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 4001).alias("g"), (F.col("id") % 10).alias("v"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = []
        run = lambda: found.append(prefix.running(table, ["id"], {"s": ("sum", F.col("v"))}, by).agg(F.sum("s"), F.max("s")).first())
        assert shuffled_rows(spark, run) < 40_000 * 1.8
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    sums, all_, most = {}, 0, 0
    for k in range(40_000):
        g = (-1 if k % 2 == 0 else k % 4001) if by else None
        sums[g] = sums.get(g, 0) + k % 10
        all_, most = all_ + sums[g], max(most, sums[g])
    assert [tuple(r) for r in found] == [(all_, most)]


@pytest.mark.parametrize("name", ["first_match_in_range", "range_join"])
def test_pairs_of_ranges_are_not_shuffled(spark, name):
    """Of 20,000 values, 300 different ranges hold nearly all: six million pairs, which no exchange takes."""
    left = spark.range(20_000).select((F.col("id") * 0.5).alias("v"))
    right = spark.range(300).select(F.col("id").alias("b"), (F.col("id") * 0.25 - 1).alias("lo"), (F.lit(10_000.0) - F.col("id") * 0.125).alias("hi"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = []
        if name == "range_join":
            run = lambda: found.append(followers.range_join(left, "v", right, "lo", "hi").agg(F.count("b"), F.sum("b")).first())
            held = [(b, sum(b * 0.25 - 1 <= k * 0.5 <= 10_000 - b * 0.125 for k in range(20_000))) for b in range(300)]
            expected = [(sum(n for _, n in held), sum(b * n for b, n in held))]
        else:
            run = lambda: found.append(followers.first_match_in_range(left, "v", right.withColumn("back", -F.col("b")), "lo", "hi", ["back"]).agg(F.count("b"), F.sum("b")).first())
            best = [max((b for b in range(300) if b * 0.25 - 1 <= k * 0.5 <= 10_000 - b * 0.125), default=None) for k in range(20_000)]
            expected = [(sum(b is not None for b in best), sum(b or 0 for b in best))]
        assert shuffled_rows(spark, run) < 200_000
        assert [tuple(r) for r in found] == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)


def test_wide_ranges_have_few_copies(spark):
    """3,000 ranges of 512 values each, at blocks of 64: two copies a range or so, not nine, and values are shuffled twice, not three times."""
    left = spark.range(6000).select("id", F.col("id").cast("double").alias("v"))
    right = spark.range(3000).select(F.col("id").alias("b"), F.col("id").cast("double").alias("lo"), (F.col("id") + 511.0).alias("hi"))
    found = []
    assert shuffled_rows(spark, lambda: found.append(followers.range_join(left, "v", right, "lo", "hi", block=64).agg(F.count("b"), F.sum("b"), F.sum("id"), F.count("*")).first())) < 50_000
    pairs = [(b, v) for b in range(3000) for v in range(b, b + 512)]
    alone = [v for v in range(6000) if v > 2999 + 511]
    assert found == [(len(pairs), sum(b for b, _ in pairs), sum(v for _, v in pairs) + sum(alone), len(pairs) + len(alone))]


@pytest.mark.parametrize("name", ["first_match_in_range", "range_join"])
def test_rows_outside_all_ranges_are_not_shuffled(spark, name):
    """All rows went through a shuffle and a table on disk before. Below, above and without a value, 19,000 of 20,000 rows can be in no range; none is lost."""
    left = spark.range(20_000).select("id", F.when(F.col("id") % 5000 != 7, F.col("id").cast("double")).alias("v"))
    right = spark.range(50).select(F.col("id").alias("b"), (F.col("id") * 20 + 8000.0).alias("lo"), (F.col("id") * 20 + 8009.0).alias("hi"))
    found = []

    def run():
        rows = followers.range_join(left, "v", right, "lo", "hi") if name == "range_join" else followers.first_match_in_range(left, "v", right, "lo", "hi", ["b"])
        found.append(rows.agg(F.count("*"), F.sum("id"), F.count("b"), F.sum("b")).first())

    assert shuffled_rows(spark, run) < 10_000
    assert [tuple(r) for r in found] == [(20_000, sum(range(20_000)), 500, 10 * sum(range(50)))]


def test_bounds_of_other_types(spark):
    """The least and the greatest bound are compared as values are."""
    left = spark.createDataFrame([(k, v) for k, v in enumerate([-3, 0, 1, 2, 9, None])], "x int, v int")
    right = spark.createDataFrame([(1, -0.0, 0.5), (2, 1.5, float("nan")), (3, None, 9.0)], "b int, lo double, hi double")
    assert sorted((r.x, r.b) for r in followers.range_join(left, "v", right, "lo", "hi").filter("b IS NOT NULL").collect()) == [(1, 1), (3, 2), (4, 2)]
    nans = left.withColumn("v", F.when(F.col("x") == 0, float("nan")).otherwise(-F.col("v").cast("float")))
    assert sorted((r.x, r.b) for r in followers.range_join(nans, "v", right, "lo", "hi").filter("b IS NOT NULL").collect()) == [(0, 2), (1, 1)]
    words = spark.createDataFrame([("b",), ("B",), ("zz",), ("",), (None,)], "w string")
    spans = spark.createDataFrame([(1, "a", "c"), (2, "b", "b"), (3, "x", "a")], "b int, lo string, hi string")
    got = followers.range_join(words, "w", spans, "lo", "hi").select("w", "b").collect()
    assert sorted((str(r.w), str(r.b)) for r in got) == sorted([("b", "1"), ("b", "2"), ("B", "None"), ("zz", "None"), ("", "None"), ("None", "None")])


@pytest.mark.parametrize(("block", "hot"), [(4, 1), (16, 3), (64, 2048)])
def test_hot_blocks_and_lines(spark, monkeypatch, block, hot):
    """Ranges over parts of lines, whole lines and many blocks, rows that no range holds between them, equal rows and equal ranges; blocks that many tasks share."""
    monkeypatch.setattr(followers, "HOT", hot)
    monkeypatch.setattr(followers, "SHORTEST", 3)
    rng = random.Random(block)
    values = [float(rng.choice([7, rng.randrange(900), 3000 + rng.randrange(50)])) for _ in range(700)]
    bands = [(lo := rng.randrange(-20, 400), lo + rng.choice([0, 3, 40, 300])) for _ in range(90)] + [(7, 7)] * 20 + [(3010, 3020)] * 5
    left = spark.createDataFrame(list(enumerate(values)), "x int, v double").repartition(3)
    right = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(bands)], "b int, lo double, hi double").repartition(3)
    got = sorted((r.x, -1 if r.b is None else r.b) for r in followers.range_join(left, "v", right, "lo", "hi", block).collect())
    assert got == sorted((x, b) for x, v in enumerate(values) for b in ([k for k, (lo, hi) in enumerate(bands) if lo <= v <= hi] or [-1]))


def test_wide_ranges_are_copied_to_long_blocks(spark, monkeypatch):
    """400 ranges of half of the rows at blocks of 4: they were copied to blocks of 64 rows at most, three copies for each row; now copies are as many as rows."""
    monkeypatch.setattr(followers, "HOT", 1_000_000)
    left = spark.range(4000).select("id", F.col("id").cast("double").alias("v"))
    right = spark.range(400).select(F.col("id").alias("b"), F.col("id").cast("double").alias("lo"), (F.col("id") + 1999.0).alias("hi"))
    found = []
    assert shuffled_rows(spark, lambda: found.append(followers.range_join(left, "v", right, "lo", "hi", block=4).agg(F.count("b"), F.sum("b"), F.sum("id")).first())) < 16_000
    alone = range(399 + 2000, 4000)
    assert found == [(800_000, 2000 * sum(range(400)), sum(2000 * b + 1999 * 1000 for b in range(400)) + sum(alone))]


def test_pairs_take_few_bytes_in_columnar_files(spark, tmp_path):
    """Pairs come line by line, so files repeat them: 3,276,800 took 1.75 bytes each where every range went over all rows of a long block."""
    left = spark.range(16_384).select(F.col("id").alias("a"), F.col("id").cast("double").alias("v"))
    right = spark.range(200).select(F.col("id").alias("b"), F.lit(0.0).alias("lo"), F.lit(1e6).alias("hi"))
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        followers.range_join(left, "v", right, "lo", "hi").select("a", "b").write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    assert sum(p.stat().st_size for p in (tmp_path / "pairs").glob("*.parquet")) < 0.3 * 200 * 16_384
    assert spark.read.parquet(str(tmp_path / "pairs")).agg(F.count("*"), F.sum("a"), F.sum("b")).first() == (200 * 16_384, 200 * sum(range(16_384)), 16_384 * sum(range(200)))


def test_pairs_come_line_by_line(spark):
    """Blocks of several lines: a line with all of its ranges, then the next, not all lines of a block for each range."""
    left = spark.range(512).select(F.col("id").alias("a"), F.col("id").cast("double").alias("v"))
    right = spark.range(200).select(F.col("id").alias("b"), F.lit(0.0).alias("lo"), F.lit(1e6).alias("hi"))
    rows = followers.range_join(left, "v", right, "lo", "hi", block=16).select("a", "b", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.a, r.b) for r in rows) == [(a, b) for a in range(512) for b in range(200)]
    assert sum((x.p, x.a // 16) != (y.p, y.a // 16) for x, y in zip(rows[:-1], rows[1:], strict=True)) < 40


def test_links():
    assert followers.check_links([("a", "b"), ("b", "c"), ("a", "d")]) == ["a", "b", "c", "d"]
    for bad in ([("a", "a")], [("a", "b"), ("b", "a")], [("a", "c"), ("b", "c")]):
        with pytest.raises(ValueError):
            followers.check_links(bad)


def test_projection(spark, boats):
    described = spark.createDataFrame([(2, "twice", "length * 2"), (1, "who", "upper(name)")], "k int, label string, value string")
    assert projection.generated_columns(boats, described, "label", "value", ["k"]).columns == ["who", "twice"]
    assert projection.with_first_row(boats, described.filter("k > 5"), ["k"]).filter("label IS NOT NULL").count() == 0
    assert projection.with_first_row(boats, described.select("label", "k"), ["k"]).select("label").distinct().collect() == [Row(label="who")]
    assert projection.suppress_lines(boats, F.col("length") > 22).count() == 3
    assert boats.select(projection.parameter({}, "x").alias("x")).first().x is None


def test_folds(spark, boats):
    words = spark.createDataFrame([(1, "tide"), (2, "under"), (3, None), (4, "gull")], "id int, t string").withColumn("g", F.lit(1))
    got = fold.string_fold(words, F.upper(F.left("t", F.lit(1))), ["id"], ["g"], "letters").orderBy("id").collect()
    assert [r.letters for r in got] == ["T", "TU", "TU", "TUG"]
    out = fold.running_fold(boats, max, 0.0, "length", ["id"], ["sail"], "top", "double").orderBy("id").collect()
    assert [r.top for r in out] == [40, 40, 40, 35, 35, 35]
    none = fold.running_fold(boats.limit(0), max, 0.0, "length", ["id"], ["sail"], "top", "double")
    assert none.collect() == [] and none.columns == [*boats.columns, "top"]


def _held(x, v):
    return max(-20, min(30, x + (v or 0)))


def _next(x, v):
    """A lock: opens by 1, 2, 3 in a row."""
    return x if x == "open" else {("none", 1): "one", ("one", 2): "two", ("two", 3): "open"}.get((x, v), "one" if v == 1 else "none")


@pytest.mark.parametrize("per_bucket", [150, 100_000])
@pytest.mark.parametrize("keys", ["hot", "none", "null"])
def test_folds_over_one_hot_group(spark, keys, per_bucket):
    """With composing maps, and handed on from bucket to bucket: the same as row by row."""
    rng = random.Random(4)
    rows = [("big" if rng.random() < 0.9 else None if rng.random() < 0.3 else f"g{k % 40}", k, rng.choice([None, 1, 2, 3, -7, 9])) for k in range(1800)]
    if keys == "null":
        rows = [(None if g == "big" else g, k, v) for g, k, v in rows]
    table = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    by = [] if keys == "none" else ["g"]
    folds = {
        "clamped": (_held, 5, "bigint", fold.clamped(-20, 30)),
        "machine": (_next, "none", "string", fold.machine(["none", "one", "two", "open"], _next)),
        "highest": (lambda x, v: max(x, v or 0), 0, "bigint", None),
    }
    for name, (step, first, kind, maps) in folds.items():
        want, at = {}, {}
        for g, k, v in sorted(rows, key=lambda r: r[1]):
            own = g if by else 0
            at[own] = want[k] = step(at.get(own, first), v)
        for how in {maps, None}:
            out = fold.running_fold(table, step, first, "v", ["k"], by, "x", kind, how, per_bucket)
            assert {r.k: r.x for r in out.select("k", "x").collect()} == want, (name, how)


@pytest.mark.parametrize("per_bucket", [2, 1000])
def test_custom_variables(boats, per_bucket):
    made = {
        "average": CustomVariable(F.col("length"), ("sum", lambda b: b), ("count", lambda b, s: b), lambda b, s, n: s / n, ignore=F.col("name") == "Otter"),
        "from_one": CustomVariable(F.col("sail"), ("sum", lambda b: b), initial=1),
        "first_name": CustomVariable(F.col("name"), ("min", lambda b: b)),
    }
    out = custom_variables(boats, ["id"], made, ["sail"], per_bucket).orderBy("id").collect()
    assert [r.average for r in out] == [40, 40, 21.5, 35, 27, 18.5]
    assert [r.from_one for r in out] == [2, 3, 4, 1, 1, 1]
    assert [r.first_name for r in out] == ["Heron", "Heron", "Heron", "Badger", "Badger", "Badger"]
    totals = {r.sail: r for r in custom_totals(boats, ["sail"], made).collect()}
    assert (totals[1].average, totals[0].average, totals[1].from_one, totals[0].first_name) == (21.5, 18.5, 4, "Badger")


@pytest.mark.parametrize("most", [3, 100_000])
def test_user_aggregate(spark, most):
    """A group of most rows, many small ones; NULL and NaN keys are groups; tables of states that fill up."""
    nan = float("nan")
    table = spark.createDataFrame([(None if k % 50 == 0 else "big" if k % 10 else f"small{k}", rng, k if k % 7 else None) for k in range(1000) for rng in (nan if k % 3 else None if k % 2 else -0.0 if k % 4 else 0.0,)], "g string, f double, v long")
    how = (lambda: [0, 0], lambda s, v: [s[0] + (v or 0), s[1] + 1], lambda a, b: [a[0] + b[0], a[1] + b[1]], lambda s: s[0] / s[1], "mean", "double", "array<bigint>")
    for keys in (["g"], ["g", "f"], []):
        want = {}
        for r in table.collect():
            want.setdefault(tuple("nan" if r[k] != r[k] else r[k] for k in keys), []).append(r.v or 0)
        got = [(tuple("nan" if r[k] != r[k] else r[k] for k in keys), r["mean"]) for r in fold.user_aggregate(table.repartition(5), keys, "v", *how, most_states=most).collect()]
        assert len(got) == len(want) and dict(got) == {k: sum(v) / len(v) for k, v in want.items()}
    assert fold.user_aggregate(table.limit(0), ["g"], "v", *how).collect() == []


def test_sections_in_order(spark):
    rows = [(1, "north", "Ness", 3), (2, "north", "Orme", 1), (3, "south", None, 2), (4, "south", "x", 5), (5, None, "Holm", 4)]
    table = spark.createDataFrame(rows, "id int, coast string, port string, boats int")
    report = sections.sectioned(table, ["id"], ["coast", "port"], {"n": F.col("id")}, {"all_boats": Variable("sum", F.col("boats"))}, suppress_blank=True)
    got = [(r.section, r.break_name, r.coast, r.port, r.n, r.all_boats) for r in sections.in_output_order(report, 3).collect()]
    details = lambda i, a, b: ("fielddetails", None, a, b, i, None)
    assert got == [
        ("reportheader", None, None, None, 1, 15),
        ("break_header", "port", None, "Holm", 5, 4), details(5, None, "Holm"), ("break_footer", "port", None, "Holm", 5, 4),
        ("break_header", "coast", "north", None, 1, 4),
        ("break_header", "port", "north", "Ness", 1, 3), details(1, "north", "Ness"), ("break_footer", "port", "north", "Ness", 1, 3),
        ("break_header", "port", "north", "Orme", 2, 1), details(2, "north", "Orme"), ("break_footer", "port", "north", "Orme", 2, 1),
        ("break_footer", "coast", "north", None, 2, 4),
        ("break_header", "coast", "south", None, 3, 7),
        details(3, "south", None),
        ("break_header", "port", "south", "x", 4, 5), details(4, "south", "x"), ("break_footer", "port", "south", "x", 4, 5),
        ("break_footer", "coast", "south", None, 4, 7),
        ("reportfooter", None, None, None, 5, 15),
    ]
    numbered = sections.numbered(report, rows_per_bucket=4).orderBy("line").collect()
    assert [(r.section, r.break_name, r.coast, r.port, r.n, r.all_boats) for r in numbered] == got
    none = sections.sectioned(table.limit(0), ["id"], ["coast"], {"n": F.col("id")}, {}, no_data="nodata")
    assert [r.section for r in none.collect()] == ["nodata"]


def test_numeric_breaks_sort_as_numbers(spark):
    table = spark.createDataFrame([(k, v) for k, v in enumerate([9, 10, -1, 100])], "id int, v int")
    report = sections.in_output_order(sections.sectioned(table, ["id"], ["v"], {"n": F.col("id")}, {}), 2)
    assert [r.v for r in report.collect() if r.section == "fielddetails"] == [-1, 9, 10, 100]


def test_sections_over_islands(spark):
    table = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, None), (6, None)], "id int, g string")
    report = sections.sectioned(table, ["id"], ["g"], {"n": F.col("id")}, {"rows": Variable("countall")}, islands=True, suppress_blank=True)
    got = [(r.section[-6:], r.g, r.n, r.rows) for r in sections.in_output_order(report, 2).collect()]
    assert got == [
        ("header", None, 1, 6), ("header", "a", 1, 2), ("etails", "a", 1, None), ("etails", "a", 2, None), ("footer", "a", 2, 2), ("header", "b", 3, 1), ("etails", "b", 3, None), ("footer", "b", 3, 1),
        ("header", "a", 4, 1), ("etails", "a", 4, None), ("footer", "a", 4, 1), ("etails", None, 5, None), ("etails", None, 6, None), ("footer", None, 6, 6),
    ]


def test_exact_numbers(spark):
    texts = ["100000000000000.0000001", "-100000000000000.0000001", "0", "-0", "1e3", "-1.5E-3", "  12.50 ", ".5", "7.", "abc", "", None, "12d", "1e400", "0e400", "9" * 36, "9" * 37, "-0." + "0" * 35 + "1", "1e-40", "1.2.3", "12\n", "--5", "123456789012345678901234567890.123456789012345678901234567890"]
    want = ["100000000000000.0000001", "-100000000000000.0000001", "0", "0", "1000", "-0.0015", "12.5", "0.5", "7", None, None, None, None, None, "0", "9" * 36, None, "-0." + "0" * 35 + "1", "0", None, "12", None, "123456789012345678901234567890.12345678901234567890123456789"]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3)
    rows = table.select("k", exact(F.col("t")).alias("x")).orderBy("k").select(exact_text(F.col("x")).alias("x"), exact_decimal(F.col("x"), 7).alias("d")).collect()
    assert [r.x for r in rows] == want
    assert [str(rows[k].d) for k in (0, 5, 6)] == ["100000000000000.0000001", "-0.0015000", "12.5000000"]


@pytest.mark.parametrize("per_bucket", [7, 1000])
def test_exact_sums(spark, per_bucket):
    """Against rational arithmetic; order and partitions don't matter."""
    rng = random.Random(9)
    texts = [rng.choice(["100000000000000.0000001", "0.0000001", "-99999999999999999999.5", f"{rng.randrange(-10**17, 10**17)}e{rng.randrange(-12, 8)}", None]) for _ in range(300)]
    rows = [(k, k % 3, t) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "k int, g int, t string").repartition(5).withColumn("x", exact(F.col("t")))
    made = {"s": Variable("sum", F.col("x"), exact=True), "a": Variable("average", F.col("x"), exact=True), "z": Variable("averageall", F.col("x"), exact=True), "low": Variable("lowest", F.col("x")), "top": Variable("highest", F.col("x"))}
    values = {k: Fraction(t) for k, t in enumerate(texts) if t}

    def cut(x):
        whole = abs(x) * 10**36 // 1
        return Fraction(whole if x >= 0 else -whole, 10**36)

    got = running_variables(table, ["k"], made, ["g"], per_bucket).select("k", "g", *(exact_text(F.col(n)).alias(n) for n in made)).collect()
    for r in got:
        own = [values[k] for k in range(r.g, r.k + 1, 3) if k in values]
        assert Fraction(r.s) == sum(own) and Fraction(r.z) == cut(sum(own) / len(range(r.g, r.k + 1, 3)))
        assert (r.a, r.low, r.top) == (None, None, None) if not own else [Fraction(x) for x in (r.a, r.low, r.top)] == [cut(sum(own) / len(own)), min(own), max(own)]
    total = table.agg(made["s"].aggregate().alias("s")).select(exact_text(F.col("s")).alias("s")).first().s
    assert Fraction(total) == sum(values.values())
    assert table.limit(0).agg(made["s"].aggregate().alias("s"), made["a"].aggregate().alias("a")).select(exact_text(F.col("s")).alias("s"), "a").first()[:] == ("0", None)


def test_exact_sums_of_any_sign(spark):
    """Carries and borrows over all limbs, sums that cancel out, and sums of too many digits."""
    near = ["9" * 36, "-" + "9" * 36, "0." + "0" * 35 + "1", "-0." + "0" * 35 + "1", "1" + "0" * 18, "-1" + "0" * 18, "0.999999999", "-0.000000001", "5" + "0" * 35, "-0." + "9" * 36]
    rng = random.Random(5)
    texts = [rng.choice(near) for _ in range(400)]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    table = cast_columns(table.repartition(3), {"t": "exact"})
    made = {"s": Variable("sum", F.col("t"), exact=True)}
    got = running_variables(table, ["k"], made, rows_per_bucket=50).select("k", exact_text(F.col("s")).alias("s")).orderBy("k").collect()
    total = Fraction(0)
    for r, t in zip(got, texts, strict=True):
        total += Fraction(t)
        assert (r.s is None) == (abs(total) >= 10**36) and (r.s is None or Fraction(r.s) == total)


def test_exact_running_of_breaks(spark):
    """Several breaks in one order, by one shuffle, equal one after the other."""
    rows = [(k, k * 7 % 3 or None, f"{(-1) ** k * k}.{k % 10}") for k in range(500)]
    table = cast_columns(spark.createDataFrame(rows, "k int, g int, t string").repartition(3), {"t": "exact"})
    total = Variable("sum", F.col("t"), exact=True)
    want = running_variables(running_variables(table, ["k"], {"s": total}), ["k"], {"own": total}, ["g"])
    got = running_of_breaks(table, ["k"], [([], {"s": total}), (["g"], {"own": total})], 40)
    texts = [exact_text(F.col(n)).alias(n) for n in ("s", "own")]
    assert sorted(got.select("k", *texts).collect()) == sorted(want.select("k", *texts).collect())


def test_code_for_rows_stays_short(spark):
    """Java compiles no method over 8,000 bytes: one that finds buckets or adds exact numbers would be interpreted for every row."""
    table = spark.range(2000).select((F.col("id") % 50).alias("a"), F.col("id").cast("string").alias("b"), F.col("id").alias("k")).repartition(3)
    table = cast_columns(table.withColumn("x", F.col("k")), {"x": "exact"})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = running_variables(table, ["a", "b", "k"], {"s": Variable("sum", F.col("x"), exact=True)}, rows_per_bucket=10)
        shown = io.StringIO()
        with contextlib.redirect_stdout(shown):
            out.select("k", exact_text(F.col("s"))).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000


def test_exact_columns_need_no_rows_made(spark):
    """As exact() reads them, but by projections, which are compiled; an explode of numbers isn't."""
    texts = ["100000000000000.0000001", "-0.5", "-0", "7.", "1e3", " 12.50 ", "-1.5E-3", "abc", "", None, "--5", "9" * 37, "0." + "1" * 40]
    table = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    read = cast_columns(table, {"t": "exact"})
    want = [r.x for r in table.orderBy("k").select(exact_text(exact(F.col("t"))).alias("x")).collect()]
    assert [r.x for r in read.orderBy("k").select(exact_text(F.col("t")).alias("x")).collect()] == want
    assert "Generate" not in read._jdf.queryExecution().optimizedPlan().toString()
