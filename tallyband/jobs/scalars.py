"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyband.functions import datetimes as D
from tallyband.functions import formatting as M
from tallyband.functions import logic as L
from tallyband.functions import numeric as N
from tallyband.functions import text as S
from tallyband.jobs.common import Catalog, table
from tallyband.functions.registry import Functions
from tallyband.sources.casts import cast_columns, cast_datetime, cast_moment, cast_number
from tallyband.sources.readers import from_rows

CATALOG = Catalog()
_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@CATALOG.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(-l_quantity) AS absolute, l_quantity + l_linenumber + 1 AS added, l_quantity - l_linenumber - 1 AS subtracted,
  l_quantity * l_linenumber AS product, CASE WHEN l_tax <> 0 THEN l_quantity / l_tax END AS quotient, (l_partkey % 7) AS remainder7, l_quantity + 1 AS inc, l_quantity - 1 AS dec,
  (l_quantity::BIGINT & 12) AS anded, (l_quantity::BIGINT | 12) AS ored, xor(l_quantity::BIGINT, 12) AS xored, ~(l_quantity::BIGINT) AS inverted,
  (l_quantity::BIGINT << 3) AS shifted_left, (l_quantity::BIGINT >> 2) AS shifted_right, l_quantity / 100 AS fixed_point, factorial(l_linenumber)::DOUBLE AS fact
FROM lineitem
""")
def numeric_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic and bits."""
    lines = table(spark, sf_dir, "lineitem")
    q, n, twelve = F.col("l_quantity"), F.col("l_linenumber"), F.lit(12)
    return lines.select(
        *_KEY,
        N.abs_(N.uminus(q)).alias("absolute"), N.add(q, n, F.lit(1)).alias("added"), N.sub(q, n, F.lit(1)).alias("subtracted"), N.mul(q, n).alias("product"),
        N.div(q, F.col("l_tax")).alias("quotient"), N.mod(F.col("l_partkey"), F.lit(7)).alias("remainder7"), N.inc(q).alias("inc"), N.dec(q).alias("dec"),
        N.bit_and(q, twelve).alias("anded"), N.bit_or(q, twelve).alias("ored"), N.bit_xor(q, twelve).alias("xored"), N.bit_not(q).alias("inverted"),
        N.shl(q, 3).alias("shifted_left"), N.shr(q, 2).alias("shifted_right"), N.fxpval(q, 2).alias("fixed_point"), N.factorial(n).alias("fact"),
    )


@CATALOG.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ceil(x)::BIGINT AS up, floor(x)::BIGINT AS down, round_even(x, 0) AS nearest_even, sign(x) * floor(abs(x) + 0.5) AS away, trunc(x)::BIGINT AS cut,
  round(pow(l_tax + 1, l_linenumber), 9) AS power, l_tax * l_tax AS square, round(sqrt(l_quantity), 9) AS root, round(ln(l_quantity), 9) AS ln, round(log2(l_quantity), 9) AS log2,
  round(log10(l_quantity), 9) AS log10, round(exp(l_tax), 9) AS exp, round(pow(2, l_tax), 9) AS exp2, round(pow(10, l_tax), 9) AS exp10, round(sin(l_quantity), 9) AS sin, round(cos(l_quantity), 9) AS cos,
  round(tan(l_tax), 9) AS tan, round(asin(l_tax), 9) AS asin, round(acos(l_tax), 9) AS acos, round(atan(l_quantity), 9) AS atan, round(1 / cos(l_tax), 9) AS sec, round(1 / sin(l_quantity), 7) AS csc, round(cot(l_quantity), 7) AS cot
FROM (SELECT *, (l_extendedprice::DECIMAL(18,2) * 5)::DOUBLE / 2 - 60000 AS x FROM lineitem)
""")
def rounding_and_trigonometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("x", (F.col("l_extendedprice").cast("decimal(18,2)") * 5).cast("double") / 2 - 60000)
    x, q, t, n = F.col("x"), F.col("l_quantity"), F.col("l_tax"), F.col("l_linenumber")

    def r(c, places: int = 9):
        return F.round(c, places)

    return lines.select(
        *_KEY,
        N.ceil(x).alias("up"), N.floor(x).alias("down"), N.rint(x).alias("nearest_even"), N.round_away(x).alias("away"), N.trunc(x).alias("cut"),
        r(N.pow_(t + 1, n)).alias("power"), N.sqr(t).alias("square"), r(N.sqrt(q)).alias("root"), r(N.ln(q)).alias("ln"), r(N.log2(q)).alias("log2"), r(N.log10(q)).alias("log10"),
        r(N.exp(t)).alias("exp"), r(N.exp2(t)).alias("exp2"), r(N.exp10(t)).alias("exp10"), r(N.sin(q)).alias("sin"), r(N.cos(q)).alias("cos"), r(N.tan(t)).alias("tan"),
        r(N.asin(t)).alias("asin"), r(N.acos(t)).alias("acos"), r(N.atan(q)).alias("atan"), r(N.sec(t)).alias("sec"), r(N.csc(q), 7).alias("csc"), r(N.cot(q), 7).alias("cot"),
    )


@CATALOG.add("""
SELECT p_partkey, p_name || '/' || p_brand AS joined, left(p_name, 4) AS first4, right(p_name, 3) AS last3, substr(p_name, 3, 4) AS mid3, substr(p_name, greatest(length(p_name) - 4, 1), 3) AS mid_back,
  lower(p_type) AS low, upper(p_name) AS up, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS proper, length(p_name) AS len, printf('%10.3f', p_retailprice) AS price
FROM part
""")
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        S.concat(name, F.lit("/"), F.col("p_brand")).alias("joined"), S.left(name, 4).alias("first4"), S.right(name, 3).alias("last3"), S.mid(name, 3, 4).alias("mid3"), S.mid(name, -5, 3).alias("mid_back"),
        S.lower(F.col("p_type")).alias("low"), S.upper(name).alias("up"), S.proper(name).alias("proper"), S.strlen(name).cast("long").alias("len"), S.str_(F.col("p_retailprice"), 10, 3).alias("price"),
    )


@CATALOG.add("""
SELECT doc_id, left(text, 9) AS first9, right(text, 7) AS last7, upper(left(text, 1)) || lower(substr(text, 2, 20)) AS opening, length(text) AS len FROM documents
""")
def string_functions_on_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on long texts with letters of more than one byte."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", S.left(text, 9).alias("first9"), S.right(text, 7).alias("last7"), S.proper(S.left(text, 21)).alias("opening"), S.strlen(text).cast("long").alias("len")
    )


@CATALOG.add("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'kész' WHEN 'O' THEN 'nyitott' ELSE o_orderstatus END AS status FROM orders
""")
def translated_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a small catalog; unknown ones stay."""
    catalog = from_rows(spark, [("msgid", "msgstr"), ("F", "kész"), ("O", "nyitott")])
    return S.translate(table(spark, sf_dir, "orders"), "o_orderstatus", catalog, "status").select("o_orderkey", "status")


@CATALOG.add("""
SELECT o_orderkey, year(d)::INT AS y, month(d)::INT AS m, day(d)::INT AS d, day(last_day(d))::INT AS days_in_month, strftime(d, '%U')::INT AS wiy, strftime(d, '%W')::INT AS wiy1,
  (CASE WHEN strftime(d - INTERVAL 3 DAY, '%U')::INT > strftime(d, '%U')::INT THEN 0 ELSE strftime(d - INTERVAL 3 DAY, '%U')::INT END) AS wiyo3, week(d)::INT AS iso_week
FROM (SELECT o_orderkey, o_orderdate AS d FROM orders)
""")
def date_parts_and_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.year(d).alias("y"), D.month(d).alias("m"), D.day(d).alias("d"), D.dim(d).alias("days_in_month"), D.wiy(d).alias("wiy"), D.wiy1(d).alias("wiy1"), D.wiyo(d, 3).alias("wiyo3"), D.stdwiy(d).alias("iso_week")
    )


@CATALOG.add("""
SELECT event_id, ts::DATE AS date_part, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT AS seconds, (ts::DATE + INTERVAL 40 DAY)::DATE AS forty_days_on, date_trunc('second', ts) + INTERVAL 90 SECOND AS later,
  date_trunc('second', ts) + INTERVAL 13 MONTH + INTERVAL 20 DAY + INTERVAL 7384 SECOND AS shifted, ts::DATE + INTERVAL 3600 SECOND AS at_one, TIMESTAMP '2000-02-29 00:00:00' + (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INT * INTERVAL 1 SECOND AS moved
FROM events
""")
def date_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    leap = F.to_timestamp_ntz(F.lit("2000-02-29 11:00:00"))
    return table(spark, sf_dir, "events").select(
        "event_id", D.dateof(F.col("ts")).alias("date_part"), D.gettimeinsecs(F.col("ts")).alias("seconds"), D.add_days(F.col("ts"), F.lit(40.7)).alias("forty_days_on"), D.add_seconds(ts, F.lit(90)).alias("later"),
        D.add_interval(ts, D.interval(years=1, months=1, days=20, hours=2, minutes=3, seconds=4)).alias("shifted"), D.settimeinsecs(F.col("ts"), F.lit(3600)).alias("at_one"), D.chgdateof(ts, leap).alias("moved"),
    )


@CATALOG.add("""
WITH o AS (SELECT o_orderkey, o_orderdate AS a, TIMESTAMP '1996-02-29 12:00:00' AS b FROM orders)
SELECT o_orderkey, ((year(a) - year(b)) * 12 + month(a) - month(b))::BIGINT AS months, (day(a) - day(b) - 1)::BIGINT AS days, 43200::BIGINT AS seconds FROM o
""")
def date_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field by field, the time of day with a day borrowed."""
    gap = D.difference(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1996-02-29 12:00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", gap.alias("gap")).select("o_orderkey", "gap.*")


@CATALOG.add("""
SELECT o_orderkey, printf('%.2f', o_totalprice) AS price, printf('%15.2f', o_totalprice) AS wide, left(o_orderpriority, 5) AS short, lpad(left(o_orderstatus, 3), 3, ' ') AS padded,
  strftime(o_orderdate, '%m/%d/%y') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
  'Order ' || o_orderkey || ' of ' || strftime(o_orderdate, '%Y-%m-%d') || ': ' || o_orderstatus || ', 100%' AS line
FROM orders
""")
def format_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, day = F.col("o_totalprice"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", M.number(price, "%.2d").alias("price"), M.number(price, "%12.2d").alias("wide"), M.string(F.col("o_orderpriority"), "%5s").alias("short"), M.string(F.col("o_orderstatus"), "% 3s").alias("padded"),
        M.dtos(day).alias("day"), M.dtosf(day, "%Y-%m-%d %H:%M:%S").alias("stamp"), M.printf("Order %d of !@{%Y-%m-%d}: %s, 100%%", F.col("o_orderkey"), day, F.col("o_orderstatus")).alias("line"),
    )


@CATALOG.add("""
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 1.0 WHEN event_id % 5 = 1 THEN 0.0 WHEN event_id % 5 = 2 THEN json_extract_string(props, '$.k')::DOUBLE WHEN event_id % 5 = 3 THEN event_id::DOUBLE * 1000 END AS parsed,
  CASE WHEN event_id % 2 = 0 THEN ts::DATE::TIMESTAMP ELSE date_trunc('second', ts) END AS stamp, (event_id % 5 = 4 OR event_id % 10 = 5)::INT AS wrong
FROM events
""")
def parse_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words (in their own case only) and numbers of several shapes, what only looks like a number, dates of two shapes."""
    k, odd = F.col("event_id") % 5, F.col("event_id") % 2 == 1
    text = F.when(k == 0, F.when(odd, "Yes").otherwise("yes")).when(k == 1, "f").when(k == 2, F.get_json_object("props", "$.k")).when(k == 3, F.concat(F.col("event_id").cast("string"), F.lit("e3"))).when(odd, "12d").otherwise("n/a")
    day = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "d/M/yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("t"), day.alias("d"))
    return rows.select("event_id", cast_number(F.col("t")).alias("parsed"), cast_datetime(F.col("d")).alias("stamp"), L.iserror(F.col("t"), "number").alias("wrong"))


@CATALOG.add("""
WITH j AS (SELECT c_custkey, (o_totalprice > 250000)::INT AS big, (o_orderstatus = 'F')::INT AS done, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority = '1-URGENT')
SELECT c_custkey, o_totalprice, CASE WHEN big IS NOT NULL AND done IS NOT NULL THEN (big <> 0 AND done <> 0)::INT END AS both, CASE WHEN big IS NOT NULL THEN 1 END AS strict_or, (big = 0)::INT AS opposite,
  CASE WHEN big IS NOT NULL THEN CASE WHEN big <> 0 THEN 'big' ELSE 'small' END END AS size, (o_totalprice IS NULL)::INT AS missing
FROM j
""")
def logic_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL in any operand gives NULL, also where SQL would know the answer."""
    orders = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_totalprice", "o_orderstatus")
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    big, done = L.gt(F.col("o_totalprice"), F.lit(250_000)), L.eq(F.col("o_orderstatus"), F.lit("F"))
    return rows.select(
        "c_custkey", "o_totalprice", L.land(big, done).alias("both"), L.lor(F.lit(1), big).alias("strict_or"), L.lnot(big).alias("opposite"), L.iif(big, F.lit("big"), F.lit("small")).alias("size"), L.isnull(F.col("o_totalprice")).alias("missing")
    )


@CATALOG.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity < 25 AND l_discount < 0.05)::INT AS both_less, (l_returnflag = 'A' AND l_linestatus = 'F')::INT AS same, (l_returnflag <> 'A' AND l_linestatus <> 'F')::INT AS all_differ
FROM lineitem
""")
def vector_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element by element: less means all are less."""
    flags, wanted = [F.col("l_returnflag"), F.col("l_linestatus")], [F.lit("A"), F.lit("F")]
    return table(spark, sf_dir, "lineitem").select(
        *_KEY, L.vector("<", [F.col("l_quantity"), F.col("l_discount")], [F.lit(25), F.lit(0.05)]).alias("both_less"), L.vector("=", flags, wanted).alias("same"), L.vector("!=", flags, wanted).alias("all_differ")
    )


_KINDS = """CASE event_id % 7 WHEN 0 THEN 'date' WHEN 1 THEN 'datetime' WHEN 2 THEN 'time' WHEN 3 THEN 'interval' WHEN 4 THEN 'datetime' WHEN 5 THEN 'time' END"""
_SECONDS = "(hour(ts) * 3600 + minute(ts) * 60 + second(ts))::BIGINT"


def _moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts and m: dates, datetimes (with a zone, too), times, intervals and what is none of these, from texts."""
    k, ts = F.col("event_id") % 7, F.col("ts")
    text = (
        F.when(k == 0, F.date_format(ts, "d/M/yyyy")).when(k == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(k == 2, F.date_format(ts, "HH:mm:ss"))
        .when(k == 3, F.concat(F.month(ts).cast("string"), F.lit(" months "), F.dayofmonth(ts).cast("string"), F.lit(" days 3 hours")))
        .when(k == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:30"))).when(k == 5, F.date_format(ts, "HHmmss")).otherwise("25:61")
    )
    rows = table(spark, sf_dir, "events").select("event_id", "ts", text.alias("m"))
    return cast_columns(rows, {"m": "moment"})


@CATALOG.add(f"""
SELECT event_id, {_KINDS} AS kind,
  CASE event_id % 7 WHEN 0 THEN ts::DATE::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) WHEN 4 THEN date_trunc('second', ts) - INTERVAL 5400 SECOND END AS stamp,
  CASE WHEN event_id % 7 = 3 THEN month(ts)::BIGINT END AS months, CASE WHEN event_id % 7 = 3 THEN day(ts)::BIGINT END AS days,
  CASE WHEN event_id % 7 IN (2, 5) THEN {_SECONDS} WHEN event_id % 7 = 3 THEN 10800 END AS seconds
FROM events
""")
def datetime_load_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datetime column takes a date, a datetime, a time or an interval; all else is an error, NULL here."""
    return _moments(spark, sf_dir).select("event_id", "m.*")


@CATALOG.add(f"""
WITH e AS (SELECT *, {_KINDS} AS kind, {_SECONDS} AS s, event_id % 7 AS k FROM events)
SELECT event_id,
  CASE k WHEN 0 THEN (ts::DATE + INTERVAL 1 DAY)::TIMESTAMP WHEN 1 THEN date_trunc('second', ts) + INTERVAL 1 SECOND WHEN 4 THEN date_trunc('second', ts) - INTERVAL 5399 SECOND END AS stamp_up,
  CASE WHEN k IN (2, 5) THEN (s + 86399) % 86400 WHEN k = 3 THEN 10799 END AS seconds_down,
  CASE WHEN k IN (2, 5) THEN (s + 90) % 86400 WHEN k = 3 THEN 10890 END AS seconds_plus,
  CASE k WHEN 0 THEN 'datetime' ELSE kind END AS kind_with_interval,
  CASE k WHEN 0 THEN ts::DATE + INTERVAL 1 MONTH + INTERVAL 3600 SECOND WHEN 1 THEN date_trunc('second', ts) + INTERVAL 1 MONTH + INTERVAL 3600 SECOND
    WHEN 4 THEN (date_trunc('second', ts) - INTERVAL 5400 SECOND) + INTERVAL 1 MONTH + INTERVAL 3600 SECOND END AS stamp_with_interval,
  CASE WHEN k IN (2, 5) THEN s - 3600 END AS since_one
FROM e
""")
def moment_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plus for all kinds: up and down by one, by a number, by an interval, and a difference."""
    m = F.col("m")
    rows = _moments(spark, sf_dir)
    made = rows.select(
        "event_id", D.inc(m).alias("up"), D.dec(m).alias("down"), D.plus_number(m, F.lit(90.9)).alias("plus"), D.plus_interval(m, D.interval(months=1, hours=1)).alias("with_interval"),
        D.minus_moment(m, cast_moment(F.lit("01:00"))).alias("less"),
    )
    return made.select(
        "event_id", F.col("up.stamp").alias("stamp_up"), F.col("down.seconds").alias("seconds_down"), F.col("plus.seconds").alias("seconds_plus"), F.col("with_interval.kind").alias("kind_with_interval"),
        F.col("with_interval.stamp").alias("stamp_with_interval"), F.col("less.seconds").alias("since_one"),
    )


@CATALOG.add("""
SELECT o_orderkey, (14 + o_orderkey % 5)::BIGINT AS months, (-3 - o_orderkey % 4)::BIGINT AS days, (14706 - 60)::BIGINT AS seconds, (o_orderdate::DATE > DATE '1996-02-29')::INT AS after_leap_day, (o_orderdate::DATE = DATE '1996-02-29')::INT AS on_leap_day
FROM orders
""")
def interval_sums_and_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals field by field, read from words; a date and a datetime are compared as dates."""
    key = F.col("o_orderkey")
    total = D.sum_intervals(D.parse_interval(F.lit("1 year 2 mons -3 days 04:05:06")), D.negated(D.interval(months=-(key % 5), days=key % 4, minutes=1)))
    a, b = D.compare_dates(F.col("o_orderdate"), F.to_timestamp_ntz(F.lit("1996-02-29 12:00:00")))
    return table(spark, sf_dir, "orders").select("o_orderkey", total.alias("i"), L.gt(a, b).alias("after_leap_day"), L.eq(a, b).alias("on_leap_day")).select("o_orderkey", "i.*", "after_leap_day", "on_leap_day")


@CATALOG.add("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN 'doboz' ELSE 'dobozok' END AS boxes,
  CASE WHEN l_returnflag = 'A' THEN '-' ELSE '' END || '$' || printf('%,.2f', l_extendedprice) AS price
FROM lineitem
""")
def plural_labels_and_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by number through a small catalog, and amounts of money, some below zero."""
    lines = table(spark, sf_dir, "lineitem").withColumns({"one": F.lit("box"), "many": F.lit("boxes")})
    catalog = from_rows(spark, [("msgid", "form", "msgstr"), ("box", 0, "doboz"), ("box", 1, "dobozok")], {"form": "number"})
    signed = F.when(F.col("l_returnflag") == "A", -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice"))
    return S.translate2(lines, "one", "many", "l_linenumber", catalog, "boxes").select(*_KEY, "boxes", M.money(signed).alias("price"))


_SLAVIC = "nplurals=3; plural=(n%10==1 && n%100!=11 ? 0 : n%10>=2 && n%10<=4 && (n%100<10 || n%100>=20) ? 1 : 2);"


@CATALOG.add("""
SELECT o_orderkey, CASE WHEN k % 10 = 1 AND k % 100 <> 11 THEN 'zamek' WHEN k % 10 BETWEEN 2 AND 4 AND NOT k % 100 BETWEEN 10 AND 19 THEN 'zamki' ELSE CASE WHEN k = 1 THEN 'lock' ELSE 'locks' END END AS locks
FROM (SELECT o_orderkey, o_orderkey % 230 AS k FROM orders)
""")
def plural_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language of three forms by its catalog's rule; the catalog lacks the third."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 230).alias("k"), F.lit("lock").alias("one"), F.lit("locks").alias("many"))
    catalog = from_rows(spark, [("msgid", "form", "msgstr"), ("lock", 0, "zamek"), ("lock", 1, "zamki")], {"form": "number"})
    return S.translate2(orders, "one", "many", "k", catalog, "locks", _SLAVIC).select("o_orderkey", "locks")


@CATALOG.add("""
SELECT event_id, (event_id % 3 = 0)::INT AS nan, 1 AS number_kind, 0 AS text_is_number, 1 AS text_kind, 1 AS date_kind, NULL::DOUBLE AS no_number, NULL::VARCHAR AS no_text, NULL::TIMESTAMP AS no_time FROM events
""")
def kinds_and_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    x = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return events.select(
        "event_id", L.isnan(x).alias("nan"), L.is_kind(events, "value", "number").alias("number_kind"), L.is_kind(events, "event_type", "number").alias("text_is_number"), L.is_kind(events, "event_type", "string").alias("text_kind"),
        L.is_kind(events, "ts", "datetime").alias("date_kind"), L.null("number").alias("no_number"), L.null("string").alias("no_text"), L.null("datetime").alias("no_time"),
    )


@CATALOG.add("SELECT count(*) AS n, count(*) AS in_range, count(*) AS dated, count(DISTINCT event_id) > 100 AS varied FROM events")
def random_and_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has no fixed value: random numbers lie in [0, 1) and differ, today is the day of now."""
    x = N.random(7)
    rows = table(spark, sf_dir, "events").select(x.alias("x"), (D.date() == F.to_date(D.now())).alias("today"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("x") >= 0) & (F.col("x") < 1)).alias("in_range"), F.count_if("today").alias("dated"), (F.count_distinct("x") > 100).alias("varied"))


@CATALOG.add("SELECT p_partkey, upper(left(p_name, 3)) || '!' AS shout, p_size * 2 AS twice FROM part")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions by name: one that replaces a built-in one, one that is new, and a built-in one."""
    functions = Functions()
    functions.add("upper", lambda s: F.concat(F.upper(s), F.lit("!")))
    functions.add("twice", lambda x: x * 2)
    return table(spark, sf_dir, "part").select("p_partkey", functions["upper"](functions["left"](F.col("p_name"), 3)).alias("shout"), functions["twice"](F.col("p_size")).alias("twice"))
