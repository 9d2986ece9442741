"""Running and look-ahead totals, breaks, sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyband.functions import formatting
from tallyband.functions.exact import exact_text
from tallyband.jobs.common import Catalog, doubles, money, table
from tallyband.operators.breaks import break_islands, break_row_numbers, matched
from tallyband.operators.fold import affine, best, clamped, iterate, machine, running_fold, string_fold, user_aggregate
from tallyband.operators.prefix import previous, row_numbers
from tallyband.operators.sections import in_output_order, numbered, sectioned
from tallyband.operators.variables import CustomVariable, Variable, at_last_row, custom_totals, custom_variables, grand_totals, group_totals, in_rounds, nested_totals, running_of_breaks, running_variables
from tallyband.sources.casts import cast_columns
from tallyband.storage import stored

CATALOG = Catalog()
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate"]
_LINE_ORDER = ", ".join(LINE_ORDER)


@CATALOG.add(f"""
SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey,
  row_number() OVER w AS brrownum,
  (sum(l_extendedprice::DECIMAL(18,2)) OVER w)::DOUBLE AS running_price,
  count(*) OVER w AS running_count,
  (sum(l_quantity::DECIMAL(18,2)) OVER (PARTITION BY l_suppkey))::DOUBLE / count(l_quantity) OVER (PARTITION BY l_suppkey) AS average_quantity,
  (sum(l_extendedprice::DECIMAL(18,2)) OVER ())::DOUBLE AS total_price,
  printf('%.2f', l_extendedprice) AS price_text
FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY {_LINE_ORDER} ROWS UNBOUNDED PRECEDING)
""")
def detail_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by supplier with running, group and report totals."""
    lines = table(spark, sf_dir, "lineitem").select(*LINE_ORDER)
    rows = running_variables(lines, LINE_ORDER, {"running_price": Variable("sum", money("l_extendedprice")), "running_count": Variable("countall")}, ["l_suppkey"])
    rows = rows.withColumn("brrownum", F.col("running_count").cast("int"))  # a row's number in its break is how many there were
    rows = group_totals(rows, ["l_suppkey"], {"average_quantity": Variable("average", money("l_quantity"))}, lines)
    total = lines.agg(Variable("sum", money("l_extendedprice")).aggregate().alias("total_price"))
    rows = rows.join(F.broadcast(total))  # one row
    rows = doubles(rows, "running_price", "total_price").withColumn("price_text", formatting.number(F.col("l_extendedprice"), "%.2d"))
    return rows.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "brrownum", "running_price", "running_count", "average_quantity", "total_price", "price_text")


@CATALOG.add("""
SELECT o_orderkey, row_number() OVER w AS rownum, (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE AS running_total,
  count(*) OVER w AS running_count, min(o_totalprice) OVER w AS lowest, max(o_totalprice) OVER w AS highest,
  (sum(o_totalprice::DECIMAL(18,2)) OVER w)::DOUBLE / count(*) OVER w AS running_average
FROM orders WINDOW w AS (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)
""")
def running_totals_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running variables over the whole report, in order of the key."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    price = F.col("o_totalprice")
    out = running_variables(
        orders,
        ["o_orderkey"],
        {
            "rownum": Variable("countall"),
            "running_total": Variable("sum", money("o_totalprice")),
            "running_count": Variable("count", price),
            "lowest": Variable("lowest", price),
            "highest": Variable("highest", price),
            "running_average": Variable("average", money("o_totalprice")),
        },
    )
    return doubles(out, "running_total").drop("o_totalprice")


@CATALOG.add("""
SELECT o_orderpriority, count(v) AS n, count(*) FILTER (WHERE NOT ign) AS n_all, coalesce(sum(v::DECIMAL(18,2)), 0)::DOUBLE AS total,
  sum(v::DECIMAL(18,2))::DOUBLE / count(v) AS average, coalesce(sum(v::DECIMAL(18,2)), 0)::DOUBLE / count(*) AS average_all, min(v) AS lowest, max(v) AS highest
FROM (SELECT *, o_orderstatus = 'P' AS ign, CASE WHEN o_orderstatus <> 'P' AND o_totalprice >= 50000 THEN o_totalprice END AS v FROM orders)
GROUP BY o_orderpriority
""")
def variables_all_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind of variable with an ignore expression; cheap orders count as having no value."""
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    ignore = F.col("o_orderstatus") == "P"
    value = F.when(F.col("o_totalprice") >= 50_000, F.col("o_totalprice"))
    exact = F.when(F.col("o_totalprice") >= 50_000, money("o_totalprice"))
    made = {
        "n": Variable("count", value, ignore),
        "n_all": Variable("countall", None, ignore),
        "total": Variable("sum", exact, ignore),
        "average": Variable("average", exact, ignore),
        "average_all": Variable("averageall", exact, ignore),
        "lowest": Variable("lowest", value, ignore),
        "highest": Variable("highest", value, ignore),
    }
    return doubles(orders.groupBy("o_orderpriority").agg(*(v.aggregate().alias(n) for n, v in made.items())), "total")


@CATALOG.add("""
SELECT r_name, n_name, (CASE WHEN grouping(r_name) = 1 THEN 0 WHEN grouping(n_name) = 1 THEN 1 ELSE 2 END)::INT AS depth,
  count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance, min(c_custkey) AS first_customer, max(c_custkey) AS last_customer
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)
""")
def nested_break_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of both levels and the report in one pass."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    out = nested_totals(
        rows,
        ["r_name", "n_name"],
        {
            "customers": Variable("countall"),
            "balance": Variable("sum", money("c_acctbal")),
            "first_customer": Variable("lowest", F.col("c_custkey")),
            "last_customer": Variable("highest", F.col("c_custkey")),
        },
    )
    return doubles(out, "balance").withColumn("depth", F.col("depth").cast("int"))


@CATALOG.add("""
WITH m AS (SELECT max(o_totalprice) AS top FROM orders), v AS (SELECT o_orderpriority, o_orderkey, top, CASE WHEN o_totalprice <= 0.9 * top THEN o_totalprice::DECIMAL(18,2) END AS p FROM orders, m)
SELECT o_orderkey, top, (sum(p) OVER ())::DOUBLE / count(p) OVER () AS report_average,
  (sum(p) OVER g)::DOUBLE / count(p) OVER g AS priority_average FROM v WINDOW g AS (PARTITION BY o_orderpriority)
""")
def outlier_free_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest price first, then averages that ignore what is over nine tenths of it."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    ignore = F.col("o_totalprice") > 0.9 * F.col("top")
    average = Variable("average", money("o_totalprice"), ignore)
    rows = in_rounds(orders, [([], {"top": Variable("highest", F.col("o_totalprice"))}), ([], {"report_average": average}), (["o_orderpriority"], {"priority_average": average})])
    return rows.select("o_orderkey", "top", "report_average", "priority_average")


@CATALOG.add("""
SELECT event_id, arg_max(event_type, event_id) OVER () AS last_type, arg_max(value * 2, event_id) OVER () AS last_value_doubled FROM events
""")
def delayed_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions of the last row, on every row."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return at_last_row(events, ["event_id"], {"last_type": F.col("event_type"), "last_value_doubled": F.col("value") * 2}).select("event_id", "last_type", "last_value_doubled")


@CATALOG.add("""
WITH p AS (SELECT *, lag(user_id) OVER w AS pu, lag(event_type) OVER w AS pt FROM events WINDOW w AS (ORDER BY ts, event_id)),
f AS (SELECT *, pu IS NULL OR pu <> user_id AS user_starts, pu IS NULL OR pu <> user_id OR pt <> event_type AS type_starts FROM p)
SELECT event_id, user_starts, type_starts, (sum(user_starts::INT) OVER w)::BIGINT AS user_no, (sum(type_starts::INT) OVER w)::BIGINT AS type_no
FROM f WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def break_islands_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal users, and of equal types in them, in time order: the input isn't sorted by them."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type")
    out = break_islands(events, ["ts", "event_id"], {"user": ["user_id"], "type": ["event_type"]})
    return out.select("event_id", "user_starts", "type_starts", "user_no", "type_no")


@CATALOG.add("SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1 AND user_id IS NOT NULL)::INT AS matched FROM events")
def matched_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the user was seen before."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return matched(events, ["ts", "event_id"], "user_id").drop("ts")


@CATALOG.add("SELECT event_id, value, lag(value) OVER (ORDER BY ts, event_id) AS previous_value, lag(event_type) OVER (ORDER BY ts, event_id) AS previous_type FROM events")
def prev_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of the row before."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "value")
    out = previous(events, ["ts", "event_id"], {"previous_value": F.col("value"), "previous_type": F.col("event_type")})
    return out.drop("ts", "event_type")


@CATALOG.add("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rownum, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INT AS brrownum FROM events")
def row_number_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number in the report and in the break."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    return break_row_numbers(row_numbers(events, ["ts", "event_id"]), ["ts", "event_id"], ["user_id"]).select("event_id", "rownum", "brrownum")


@CATALOG.add("""
SELECT event_id, user_id, (sum(value::DECIMAL(18,2)) OVER w)::DOUBLE AS running_value, count(*) FILTER (WHERE event_type <> 'error') OVER w AS sound_events,
  max(value) OVER w AS highest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def running_reset_on_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running variables that start anew with each user."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    made = {"running_value": Variable("sum", money("value")), "sound_events": Variable("countall", None, F.col("event_type") == "error"), "highest": Variable("highest", F.col("value"))}
    out = running_variables(events, ["ts", "event_id"], made, ["user_id"])
    return doubles(out, "running_value").drop("ts", "event_type", "value")


@CATALOG.add("""
SELECT event_id, user_id, string_agg(upper(left(event_type, 1)), '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS letters FROM events
""")
def custom_fold_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First letters of the user's events so far."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type")
    return string_fold(events, F.upper(F.substring("event_type", 1, 1)), ["ts", "event_id"], ["user_id"], "letters").drop("ts", "event_type")


@CATALOG.add("""
SELECT event_id, user_id, round(exp(sum(ln(1 + value / 1000)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)), 6) AS growth FROM events
""")
def iterative_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value made from its own last one: growth by each event's share."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "value")
    out = iterate(events, F.lit(1.0), 1 + F.col("value") / 1000, ["ts", "event_id"], ["user_id"], "growth")
    return out.select("event_id", "user_id", F.round("growth", 6).alias("growth"))


@CATALOG.add("""
WITH RECURSIVE e AS (SELECT event_id, user_id, (round(value))::BIGINT AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, user_id, k, (7 * 31 + v) % 1000 AS fold FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.user_id, e.k, (r.fold * 31 + e.v) % 1000 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT event_id, user_id, fold FROM r
""")
def iterative_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that no window expresses: 31 times the last value plus this one, modulo 1000. Its steps compose, so users are split."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", F.round("value").cast("long").alias("v"))
    out = running_fold(events, _mixed, 7, "v", ["ts", "event_id"], ["user_id"], "fold", "bigint", affine(31, 1000))
    return out.select("event_id", "user_id", "fold")


def _mixed(last: int, value: int) -> int:
    return (last * 31 + value) % 1000


@CATALOG.add("""
WITH c AS (SELECT r_name, n_name, c_custkey, c_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (
SELECT 'reportheader' AS section, NULL AS break_name, NULL AS r_name, NULL AS n_name, arg_min(c_name, c_custkey) AS customer, count(*) AS customers, sum(c_acctbal::DECIMAL(18,2))::DOUBLE AS balance FROM c
UNION ALL SELECT 'reportfooter', NULL, NULL, NULL, arg_max(c_name, c_custkey), count(*), sum(c_acctbal::DECIMAL(18,2))::DOUBLE FROM c
UNION ALL SELECT 'break_header', 'r_name', r_name, NULL, arg_min(c_name, c_custkey), count(*), sum(c_acctbal::DECIMAL(18,2))::DOUBLE FROM c GROUP BY r_name
UNION ALL SELECT 'break_footer', 'r_name', r_name, NULL, arg_max(c_name, c_custkey), count(*), sum(c_acctbal::DECIMAL(18,2))::DOUBLE FROM c GROUP BY r_name
UNION ALL SELECT 'break_header', 'n_name', r_name, n_name, arg_min(c_name, c_custkey), count(*), sum(c_acctbal::DECIMAL(18,2))::DOUBLE FROM c GROUP BY r_name, n_name
UNION ALL SELECT 'break_footer', 'n_name', r_name, n_name, arg_max(c_name, c_custkey), count(*), sum(c_acctbal::DECIMAL(18,2))::DOUBLE FROM c GROUP BY r_name, n_name
UNION ALL SELECT 'fielddetails', NULL, r_name, n_name, c_name, NULL, NULL FROM c)
SELECT * FROM s
""")
def sectioned_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by region and nation as tagged sections, in output order."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select("r_name", "n_name", "c_custkey", "c_name", "c_acctbal")
    made = {"customers": Variable("countall"), "balance": Variable("sum", money("c_acctbal"))}
    report = sectioned(rows, ["c_custkey"], ["r_name", "n_name"], {"customer": F.col("c_name")}, made, no_data="nodata")
    return doubles(in_output_order(report), "balance").select("section", "break_name", "r_name", "n_name", "customer", "customers", "balance")


@CATALOG.add("""
WITH c AS (SELECT nullif(c_mktsegment, 'MACHINERY') AS segment, c_custkey FROM customer)
SELECT 'reportheader' AS section, NULL AS segment, min(c_custkey) AS customer, count(*) AS customers FROM c
UNION ALL SELECT 'reportfooter', NULL, max(c_custkey), count(*) FROM c
UNION ALL SELECT 'break_header', segment, min(c_custkey), count(*) FROM c WHERE segment <> '' GROUP BY segment
UNION ALL SELECT 'break_footer', segment, max(c_custkey), count(*) FROM c WHERE segment <> '' GROUP BY segment
UNION ALL SELECT 'fielddetails', segment, c_custkey, NULL FROM c
""")
def suppress_blank_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without a segment have details, but neither header nor footer."""
    segment = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    rows = table(spark, sf_dir, "customer").select(segment.alias("segment"), "c_custkey")
    report = sectioned(rows, ["c_custkey"], ["segment"], {"customer": F.col("c_custkey")}, {"customers": Variable("countall")}, suppress_blank=True)
    return in_output_order(report).select("section", "segment", "customer", "customers")


@CATALOG.add("""
WITH p AS (SELECT *, lag(event_type) OVER (ORDER BY ts, event_id) AS pt FROM events), f AS (SELECT *, sum((pt IS NULL OR pt <> event_type)::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p)
SELECT event_id, row_number() OVER (PARTITION BY run ORDER BY ts, event_id)::INT AS detailcnt FROM f
""")
def detail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows since the last header, in a report that isn't sorted by its break."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    runs = break_islands(events, ["ts", "event_id"], {"type": ["event_type"]})
    return break_row_numbers(runs, ["ts", "event_id"], ["type_no"], "detailcnt").select("event_id", "detailcnt")


@CATALOG.add("SELECT n_name, count(*) OVER () AS nations, (SELECT count(*) FROM region) AS regions FROM nation")
def grand_total_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report totals known before the first detail."""
    nations = grand_totals(table(spark, sf_dir, "nation").select("n_name"), {"nations": Variable("countall")})
    regions = table(spark, sf_dir, "region").agg(Variable("countall").aggregate().alias("regions"))
    return nations.join(F.broadcast(regions))  # one row


@CATALOG.add("""
WITH o AS (SELECT (year(o_orderdate) - 1995)::INT AS y, date_trunc('month', o_orderdate)::DATE AS d, o_orderkey, o_totalprice::DECIMAL(18,2) AS p FROM orders),
s AS (
SELECT 'reportheader' AS section, NULL AS break_name, NULL::INT AS y, NULL::DATE AS d, arg_min(o_orderkey, o_orderkey) AS order_key, sum(p)::DOUBLE AS total, 0 AS r0, NULL::INT AS k0, 0 AS r1, NULL::DATE AS k1, 0 AS r2 FROM o
UNION ALL SELECT 'reportfooter', NULL, NULL, NULL, max(o_orderkey), sum(p)::DOUBLE, 2, NULL, 0, NULL, 0 FROM o
UNION ALL SELECT 'break_header', 'y', y, NULL, min(o_orderkey), sum(p)::DOUBLE, 1, y, 0, NULL, 0 FROM o GROUP BY y
UNION ALL SELECT 'break_footer', 'y', y, NULL, max(o_orderkey), sum(p)::DOUBLE, 1, y, 2, NULL, 0 FROM o GROUP BY y
UNION ALL SELECT 'break_header', 'd', y, d, min(o_orderkey), sum(p)::DOUBLE, 1, y, 1, d, 0 FROM o GROUP BY y, d
UNION ALL SELECT 'break_footer', 'd', y, d, max(o_orderkey), sum(p)::DOUBLE, 1, y, 1, d, 2 FROM o GROUP BY y, d
UNION ALL SELECT 'fielddetails', NULL, y, d, o_orderkey, NULL, 1, y, 1, d, 1 FROM o)
SELECT section, break_name, y, d, order_key, total,
  row_number() OVER (ORDER BY r0, k0 NULLS FIRST, r1, k1 NULLS FIRST, r2, CASE WHEN section = 'fielddetails' THEN order_key END NULLS FIRST) AS line FROM s
""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by year (a number, also below zero) and month (a date); each row with its place in the output."""
    day = F.col("o_orderdate")
    rows = table(spark, sf_dir, "orders").select((F.year(day) - 1995).alias("y"), F.trunc(day, "month").alias("d"), "o_orderkey", "o_totalprice")
    report = sectioned(rows, ["o_orderkey"], ["y", "d"], {"order_key": F.col("o_orderkey")}, {"total": Variable("sum", money("o_totalprice"))})
    return doubles(numbered(report), "total")


@CATALOG.add("""
WITH p AS (SELECT ts, event_id, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS pt FROM events),
e AS (SELECT *, sum((pt IS NULL OR pt <> event_type)::INT) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM p),
s AS (
SELECT 'reportheader' AS section, NULL AS event_type, arg_min(event_id, (ts, event_id)) AS event, count(*) AS events, 0 AS r0, NULL AS run, 0 AS r1, NULL::TIMESTAMP AS ts FROM e
UNION ALL SELECT 'reportfooter', NULL, arg_max(event_id, (ts, event_id)), count(*), 2, NULL, 0, NULL FROM e
UNION ALL SELECT 'break_header', any_value(event_type), arg_min(event_id, (ts, event_id)), count(*), 1, run, 0, NULL FROM e GROUP BY run
UNION ALL SELECT 'break_footer', any_value(event_type), arg_max(event_id, (ts, event_id)), count(*), 1, run, 2, NULL FROM e GROUP BY run
UNION ALL SELECT 'fielddetails', event_type, event_id, NULL, 1, run, 1, ts FROM e)
SELECT section, event_type, event, events, row_number() OVER (ORDER BY r0, run NULLS FIRST, r1, ts NULLS FIRST, CASE WHEN section = 'fielddetails' THEN event END) AS line FROM s
""")
def sections_over_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time order, which isn't that of their types: each run of equal types has a header and a footer."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type")
    report = sectioned(events, ["ts", "event_id"], ["event_type"], {"event": F.col("event_id")}, {"events": Variable("countall")}, islands=True)
    return numbered(report).drop("break_name")


@CATALOG.add("SELECT 'nodata' AS section, NULL::VARCHAR AS segment, NULL::BIGINT AS customer WHERE (SELECT count(*) FROM customer WHERE c_acctbal > 1e12) = 0")
def no_data_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of a query without rows."""
    rows = table(spark, sf_dir, "customer").filter("c_acctbal > 1e12").select(F.col("c_mktsegment").alias("segment"), "c_custkey")
    report = sectioned(rows, ["c_custkey"], ["segment"], {"customer": F.col("c_custkey")}, {"customers": Variable("countall")}, no_data="nodata")
    return in_output_order(report).select("section", "segment", "customer")


@CATALOG.add("""
WITH e AS (SELECT event_id, ts, user_id, event_type, value::DECIMAL(18,2) AS v, CASE WHEN event_type <> 'error' THEN value::DECIMAL(18,2) END AS b FROM events)
SELECT event_id, user_id, (coalesce(sum(b) OVER w, 0))::DOUBLE / nullif(count(b) OVER w, 0) AS average, min(event_type) OVER w AS first_type, max(ts) OVER w AS latest,
  (10 + coalesce(sum(v) OVER w, 0))::DOUBLE AS from_ten, sum(running) OVER w AS of_sums
FROM (SELECT *, (sum(round(v)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS running FROM e)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def custom_variable_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables that are spelled out: a number made of two intermediary values, a string, a datetime, a start value, and a running sum of a running sum."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id", "event_type", "value")
    average = CustomVariable(money("value"), ("sum", lambda b: F.coalesce(b, F.lit(0))), ("count", lambda b, s: b), lambda b, s, n: F.try_divide(s.cast("double"), n), ignore=F.col("event_type") == "error")
    made = {
        "average": average,
        "first_type": CustomVariable(F.col("event_type"), ("min", lambda b: b)),
        "latest": CustomVariable(F.col("ts"), ("max", lambda b: b)),
        "from_ten": CustomVariable(money("value"), ("sum", lambda b: b), initial=10),
        "of_sums": CustomVariable(F.round("value").cast("long"), ("sum", lambda b: b), ("sum", lambda b, s: s), lambda b, s, t: t),
    }
    out = custom_variables(events, ["ts", "event_id"], made, ["user_id"])
    return doubles(out, "from_ten").drop("ts", "event_type", "value")


@CATALOG.add("""
SELECT l_suppkey, sum(l_extendedprice::DECIMAL(18,2) * l_quantity::BIGINT)::DOUBLE / sum(l_quantity::BIGINT) AS weighted, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_suppkey
""")
def custom_variable_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as aggregates of groups: a weighted average and a datetime."""
    lines = table(spark, sf_dir, "lineitem")
    quantity = F.col("l_quantity").cast("long")
    weighted = CustomVariable(money("l_extendedprice"), ("sum", lambda b: b * quantity.cast("decimal(18,0)")), ("sum", lambda b, s: quantity), lambda b, s, n: s.cast("double") / n)
    return custom_totals(lines, ["l_suppkey"], {"weighted": weighted, "first_ship": CustomVariable(F.col("l_shipdate"), ("min", lambda b: b))})


#: Amounts as text, two for each line: ten millionths, and such numbers beside hundreds of billions, some of them below zero.
_AMOUNTS = """(SELECT *, CASE WHEN kind = 'small' THEN '' WHEN l_orderkey % 10 = 3 THEN '-100000000000000' ELSE '100000000000000' END ||
  CASE WHEN kind = 'small' THEN '0.000000' ELSE '.000000' END || (l_linenumber % 9 + 1) AS amount FROM lineitem, (VALUES ('large'), ('small')) v(kind))"""


def _amounts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """These columns of the lines, kind and amount."""
    # a small file is one task, and reading numbers is work
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *columns).repartition("l_orderkey", "l_linenumber")
    lines = lines.withColumn("kind", F.explode(F.array(F.lit("large"), F.lit("small"))))
    small = F.col("kind") == "small"
    large = F.when(small, "").when(F.col("l_orderkey") % 10 == 3, "-100000000000000").otherwise("100000000000000")
    text = F.concat(large, F.when(small, "0.000000").otherwise(".000000"), (F.col("l_linenumber") % 9 + 1).cast("string"))
    return cast_columns(lines.withColumn("amount", text), {"amount": "exact"})


def _plain(text: str) -> str:
    return f"regexp_replace(regexp_replace(({text})::VARCHAR, '0+$', ''), '\\.$', '')"


@CATALOG.add(f"""
SELECT l_returnflag, kind, count(*) AS n, {_plain("sum(amount::DECIMAL(38,7))")} AS total, {_plain("min(amount::DECIMAL(38,7))")} AS lowest,
  ((sum((amount::DECIMAL(38,7) * 10000000)::HUGEINT) * 100000) // count(*))::VARCHAR AS average_scaled
FROM {_AMOUNTS} GROUP BY l_returnflag, kind
""")
def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and averages of numbers that a double can't hold, by group; the average as a whole number of billionths of thousandths."""
    amount = F.col("amount")
    made = {"n": Variable("countall"), "total": Variable("sum", amount, exact=True), "lowest": Variable("lowest", amount), "average": Variable("average", amount, exact=True)}
    rows = _amounts(spark, sf_dir, "l_returnflag").groupBy("l_returnflag", "kind").agg(*(v.aggregate().alias(n) for n, v in made.items()))
    scaled = F.regexp_replace(F.concat(exact_text(F.col("average"), 0), F.rpad(F.regexp_extract(exact_text(F.col("average"), 12), r"\.([0-9]+)", 1), 12, "0")), r"^(-?)0+(?=[0-9])", "$1")
    return rows.select("l_returnflag", "kind", "n", exact_text(F.col("total")).alias("total"), exact_text(F.col("lowest")).alias("lowest"), scaled.alias("average_scaled"))


@CATALOG.add(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, kind, {_plain("sum(amount::DECIMAL(38,7)) OVER w")} AS running, {_plain("sum(amount::DECIMAL(38,7)) OVER (PARTITION BY l_returnflag ORDER BY " + _LINE_ORDER + ", kind ROWS UNBOUNDED PRECEDING)")} AS running_in_flag
FROM {_AMOUNTS} WINDOW w AS (ORDER BY {_LINE_ORDER}, kind ROWS UNBOUNDED PRECEDING)
""")
def exact_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running sums of both magnitudes at once, over the report and over each flag, which three values share."""
    order = [*LINE_ORDER, "kind"]
    total = Variable("sum", F.col("amount"), exact=True)
    rows = stored(_amounts(spark, sf_dir, *LINE_ORDER[2:], "l_returnflag"), "amounts")
    rows = running_of_breaks(rows, order, [([], {"running": total}), (["l_returnflag"], {"running_in_flag": total})])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "kind", *(exact_text(F.col(n)).alias(n) for n in ("running", "running_in_flag")))


_HELD = "greatest(-500, least(500, r.balance + e.v))"


@CATALOG.add(f"""
WITH RECURSIVE e AS (SELECT event_id, round(value)::BIGINT * (CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END) AS v, event_type, CASE WHEN user_id % 10 = 0 THEN user_id ELSE -1 END AS who,
  row_number() OVER (PARTITION BY CASE WHEN user_id % 10 = 0 THEN user_id ELSE -1 END ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT event_id, who, k, greatest(-500, least(500, v)) AS balance, greatest(0, v) AS highest, (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS alarm FROM e WHERE k = 1
  UNION ALL SELECT e.event_id, e.who, e.k, {_HELD}, greatest(r.highest, e.v), (CASE WHEN e.event_type = 'error' THEN least(r.alarm + 1, 3) WHEN r.alarm = 3 THEN 3 ELSE 0 END) FROM r JOIN e ON e.who = r.who AND e.k = r.k + 1)
SELECT event_id, who, balance::BIGINT AS balance, highest::BIGINT AS highest, alarm::BIGINT AS alarm FROM r
""")
def folds_of_a_hot_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine tenths of the events are one group: a balance held between bounds, the highest value, and an alarm that three errors in a row set off for good."""
    sign = F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)
    who = F.when(F.col("user_id") % 10 == 0, F.col("user_id")).otherwise(-1)
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", who.alias("who"), (F.round("value").cast("long") * sign).alias("v"))
    order = ["ts", "event_id"]
    rows = running_fold(events, _held, 0, "v", order, ["who"], "balance", "bigint", clamped(-500, 500))
    rows = running_fold(rows, _higher, 0, "v", order, ["who"], "highest", "bigint", best(max, "bigint"))
    rows = running_fold(rows, _alarm, 0, "event_type", order, ["who"], "alarm", "bigint", machine([0, 1, 2, 3], _alarm))
    return rows.select("event_id", "who", "balance", "highest", "alarm")


def _held(x: int, v: int) -> int:
    return max(-500, min(500, x + v))


def _higher(x: int, v: int) -> int:
    return max(x, v)


def _alarm(state: int, event_type: str) -> int:
    return min(state + 1, 3) if event_type == "error" else 3 if state == 3 else 0


@CATALOG.add("SELECT user_id, bit_xor(event_id::BIGINT) AS xored FROM events GROUP BY user_id")
def user_aggregate_xor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate that Spark is not asked for: a user's own in Python, with states that merge."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id")
    return user_aggregate(events, ["user_id"], "event_id", _no_bits, _with_bits, _both_bits, _bits, "xored", "bigint", "array<bigint>")


def _no_bits() -> list:
    return [0]


def _with_bits(state: list, value: int) -> list:
    return [state[0] ^ int(value)]


def _both_bits(a: list, b: list) -> list:
    return [int(a[0]) ^ int(b[0])]


def _bits(state: list) -> int:
    return int(state[0])
