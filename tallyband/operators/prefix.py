"""Scans in row order without putting all rows in one task.

Rows are dealt to buckets by ranges of the order columns, so that bucket numbers rise with the order. Bounds are read off a
bounded sample of the order keys; a row's bucket is then a fixed expression of its keys, the same in every pass.
Windows run inside buckets; what goes from one bucket to the next is a row for each bucket, which is small, carried
over by a window on that small table, and joined back.

Order columns ascend, NULLs first; for the other direction negate the column.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
ROWS_PER_BUCKET = 1_000_000
#: Below ROWS_PER_BUCKET there are as many buckets as shuffle partitions, but none is planned for fewer rows than this.
LEAST_PER_BUCKET = 2_000
KEYS_PER_BUCKET = 20
MOST_BUCKETS = 4096


def _placed(df: DataFrame, order: Sequence[str], bounds: list[Column]) -> DataFrame:
    """df with BUCKET: the number of bounds at or below the keys, by halving. A column for each step, so that code stays short for any number of bounds."""
    # of one type, or each comparison would cast a bound
    keys = T.StructType([T.StructField(c, df.schema[c].dataType) for c in order])
    out = df.withColumns({"__keys": F.struct(*order).cast(keys), "__bounds": F.array(*bounds).cast(T.ArrayType(keys)), BUCKET: F.lit(0)})
    step = 1 << max(len(bounds).bit_length() - 1, 0)
    while step:
        on = F.col(BUCKET) + step
        # NULL past the last bound
        out = out.withColumn(BUCKET, F.when(F.col("__keys") >= F.get("__bounds", on - 1), on).otherwise(F.col(BUCKET)))
        step //= 2
    return out.drop("__keys", "__bounds")


def _dealt(df: DataFrame, order: Sequence[str], rows_per_bucket: int) -> tuple[DataFrame, int]:
    """df with BUCKET, rows where they were, and how many tasks whole buckets should have."""
    keys = df.select(*order)
    total = keys.count()
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MOST_BUCKETS, max(math.ceil(total / rows_per_bucket), min(tasks, total // LEAST_PER_BUCKET)))
    if buckets < 2:
        return df.withColumn(BUCKET, F.lit(0)), 1  # few rows
    share = min(1.0, 2 * buckets * KEYS_PER_BUCKET / total)
    sample = keys.filter(F.pmod(F.xxhash64(*order), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000))).limit(4 * buckets * KEYS_PER_BUCKET)
    rows = sample.orderBy(*order).collect()  # at most 4 * KEYS_PER_BUCKET short rows a bucket
    bounds = sorted({tuple(rows[len(rows) * k // buckets]) for k in range(1, buckets)}, key=lambda r: [(v is not None, v) for v in r]) if rows else []
    typed = [F.struct(*(F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in zip(order, b, strict=True))) for b in bounds]
    return _placed(df, order, typed) if typed else df.withColumn(BUCKET, F.lit(0)), max(buckets, tasks)


def _gathered(dealt: DataFrame, tasks: int) -> DataFrame:
    # dealt by number, so that few bytes are not put together in one task again
    return dealt.repartition(1) if tasks == 1 else dealt.repartition(tasks, BUCKET)


def bucketed(df: DataFrame, order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """df with BUCKET, a number that rises with the order, in tasks of whole buckets."""
    return _gathered(*_dealt(df, order, rows_per_bucket))


def join_same(df: DataFrame, small: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """df with the columns of small, which has a row for each combination of its keys, NULLs included."""
    if not keys:
        return df.join(F.broadcast(small.select(*columns)))  # one row
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    return df.alias("l").join(small.alias("r"), same).select("l.*", *(F.col(f"r.`{c}`") for c in columns))


def _carry(df: DataFrame, totals: Mapping[str, Column], before: Mapping[str, Column], by: Sequence[str]) -> DataFrame:
    """Join to each row what `before` makes of the earlier buckets' totals. One row a bucket (and group) is carried."""
    small = df.groupBy(*by, BUCKET).agg(*(c.alias(n) for n, c in totals.items()))
    small = small.select(*by, BUCKET, *(c.alias(n) for n, c in before.items()))
    if not by:
        return df.join(F.broadcast(small), BUCKET)  # at most MOST_BUCKETS rows
    return join_same(df, small, [*by, BUCKET], list(before))


def earlier(by: Sequence[str] = ()) -> Window:
    """Of the table of buckets: all before this one."""
    return Window.partitionBy(*by).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)


def running(df: DataFrame, order: Sequence[str], columns: Mapping[str, tuple[str, Column]], by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add inclusive running aggregates. columns: name to (sum, count, min or max, input); by: groups in which they start anew.

    Groups are split over buckets as well, so one group may hold any share of the rows. Rows are dealt by group and order, so a bucket goes on with
    one group as a rule, and what is carried is a row a bucket; rows that have a BUCKET by the order alone are left in it.
    """
    if BUCKET in df.columns:
        before = _before(df, columns, by)
        return _scanned(df, before if by else F.broadcast(before), order, columns, by)  # without groups at most MOST_BUCKETS rows
    # groups stand in the order of their hash, so their keys may have any type
    dealt, tasks = _dealt(df.withColumn("__group", F.xxhash64(*by)), ["__group", *order], rows_per_bucket) if by else _dealt(df, order, rows_per_bucket)
    dealt = dealt.drop("__group")
    # totals are taken where the rows are, so that only sums are shuffled for them; a row a bucket, but for groups of equal hash
    return _scanned(_gathered(dealt, tasks), F.broadcast(_before(dealt, columns, by)), order, columns, by).drop(BUCKET)


def dealt_once(df: DataFrame, order: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, DataFrame]:
    """df with BUCKET where its rows are, and the same in tasks of whole buckets: for several scan()s in one order, with one shuffle."""
    dealt, tasks = _dealt(df, order, rows_per_bucket)
    return dealt, _gathered(dealt, tasks)


def scan(rows: DataFrame, dealt: DataFrame, order: Sequence[str], columns: Mapping[str, tuple[str, Column]], by: Sequence[str] = ()) -> DataFrame:
    """running() for rows that dealt_once() has gathered.

    A row for each bucket and group in it is broadcast, so groups should be few, whatever their sizes; for many take running().
    """
    return _scanned(rows, F.broadcast(_before(dealt, columns, by)), order, columns, by)


_KINDS = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def _before(rows: DataFrame, columns: Mapping[str, tuple[str, Column]], by: Sequence[str]) -> DataFrame:
    """What the earlier buckets add up to, for each bucket and group that has some."""
    small = rows.groupBy(*by, BUCKET).agg(*(_KINDS[kind](x).alias(f"__{n}") for n, (kind, x) in columns.items()))
    before = [(F.sum if kind == "count" else _KINDS[kind])(f"__{n}").over(earlier(by)).alias(f"__{n}") for n, (kind, _) in columns.items()]
    return small.select(*by, BUCKET, *before, F.count(F.lit(1)).over(earlier(by)).alias("__parts")).filter("__parts > 0").drop("__parts")


def _scanned(rows: DataFrame, before: DataFrame, order: Sequence[str], columns: Mapping[str, tuple[str, Column]], by: Sequence[str]) -> DataFrame:
    """Running aggregates in each bucket, and then what comes from those before: so it isn't sorted with the rows."""
    upto = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__own_{n}": _KINDS[kind](x).over(upto) for n, (kind, x) in columns.items()})
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in [*by, BUCKET]]
    out = out.alias("l").join(before.alias("r"), same, "left").select("l.*", *(F.col(f"r.`__{n}`") for n in columns))
    made = {}
    for n, (kind, _) in columns.items():
        own, old = F.col(f"`__own_{n}`"), F.col(f"`__{n}`")
        if kind in ("sum", "count"):
            # NULL only where nothing has been added yet
            made[n] = F.when(own.isNotNull() | old.isNotNull(), F.coalesce(own, F.lit(0)) + F.coalesce(old, F.lit(0)))
        else:
            made[n] = (F.least if kind == "min" else F.greatest)(own, old)  # these pass over NULL
    return out.withColumns(made).drop(*(f"__own_{n}" for n in columns), *(f"__{n}" for n in columns))


def previous(df: DataFrame, order: Sequence[str], columns: Mapping[str, Column], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add each input's value in the previous row (NULL in the first)."""
    rows = df if BUCKET in df.columns else bucketed(df, order, rows_per_bucket)
    last = {f"__{n}": F.max_by(F.struct(x.alias("v")), F.struct(*order)) for n, x in columns.items()}
    before = {f"__{n}": F.last(f"__{n}").over(earlier()) for n in columns}
    out = _carry(rows, last, before, ())
    inside = Window.partitionBy(BUCKET).orderBy(*order)
    first = F.row_number().over(inside) == 1
    for n, x in columns.items():
        out = out.withColumn(n, F.when(first, F.col(f"__{n}.v")).otherwise(F.lag(x).over(inside)))
    return out.drop(*before, *([] if BUCKET in df.columns else [BUCKET]))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "rownum", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the row's number, from 1."""
    return running(df, order, {name: ("count", F.lit(1))}, rows_per_bucket=rows_per_bucket)
