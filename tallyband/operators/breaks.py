"""Control breaks: places where watched fields differ from the previous row's. NULL differs from all, also from NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyband.operators.prefix import BUCKET, ROWS_PER_BUCKET, bucketed, earlier, previous, running

Levels = Mapping[str, Sequence[str]]
"""Break name to its fields, outermost first."""


def break_flags(df: DataFrame, order: Sequence[str], levels: Levels, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add a flag <break>_starts to each row: where the break starts anew. An outer break starts all inner ones."""
    fields = [f for fs in levels.values() for f in fs]
    out = previous(df, order, {f"__p_{f}": F.col(f) for f in fields}, rows_per_bucket)
    outer: list[Column] = []
    for name, own in levels.items():
        outer += [~F.coalesce(F.col(f) == F.col(f"__p_{f}"), F.lit(False)) for f in own]
        out = out.withColumn(f"{name}_starts", reduce(lambda a, b: a | b, outer))
    return out.drop(*(f"__p_{f}" for f in fields))


def break_islands(df: DataFrame, order: Sequence[str], levels: Levels, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add flags and the number <break>_no of each run of rows: for input that isn't sorted by the breaks.

    One row a bucket is carried over: its first and last fields and how many runs start inside it. So the input is read twice.
    """
    rows = bucketed(df, order, rows_per_bucket)
    fields = list(dict.fromkeys(f for own in levels.values() for f in own))
    inside = Window.partitionBy(BUCKET).orderBy(*order)
    rows = rows.withColumn("__first", F.row_number().over(inside) == 1).withColumns({f"__p_{f}": F.lag(F.col(f"`{f}`")).over(inside) for f in fields})
    starts, outer = {}, []
    for name, own in levels.items():
        outer += [~F.coalesce(F.col(f"`{f}`") == F.col(f"`__p_{f}`"), F.lit(False)) for f in own]
        starts[name] = ~F.col("__first") & reduce(lambda a, b: a | b, outer)
    rows = rows.withColumns({f"__s_{name}": x for name, x in starts.items()}).drop(*(f"__p_{f}" for f in fields))

    values, place = F.struct(*(F.col(f"`{f}`").alias(f"f{k}") for k, f in enumerate(fields))), F.struct(*order)
    small = rows.groupBy(BUCKET).agg(F.min_by(values, place).alias("__a"), F.max_by(values, place).alias("__z"), *(F.sum(F.col(f"__s_{n}").cast("long")).alias(f"__n_{n}") for n in levels))
    small = small.withColumn("__before", F.lag("__z").over(Window.orderBy(BUCKET)))  # at most MOST_BUCKETS rows
    number, outer, opens = {f: k for k, f in enumerate(fields)}, [], {}
    for name, own in levels.items():
        outer += [~F.coalesce(F.col(f"__a.f{number[f]}") == F.col(f"__before.f{number[f]}"), F.lit(False)) for f in own]
        opens[f"__o_{name}"] = reduce(lambda a, b: a | b, outer)
    small = small.withColumns(opens)
    earlier_runs = {f"__n_{n}": F.coalesce(F.sum(F.col(f"__n_{n}") + F.col(f"__o_{n}").cast("long")).over(earlier()), F.lit(0)) for n in levels}
    small = small.select(BUCKET, *opens, *(x.alias(n) for n, x in earlier_runs.items()))

    out = rows.join(F.broadcast(small), BUCKET)  # a row a bucket
    out = out.withColumns({f"{n}_starts": F.when(F.col("__first"), F.col(f"__o_{n}")).otherwise(F.col(f"__s_{n}")) for n in levels})
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({f"{n}_no": F.col(f"__n_{n}") + F.sum(F.col(f"{n}_starts").cast("long")).over(upto) for n in levels})
    return out.select(*df.columns, *(f"{n}_starts" for n in levels), *(f"{n}_no" for n in levels))


def break_row_numbers(df: DataFrame, order: Sequence[str], keys: Sequence[str], name: str = "brrownum", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the row's number in its break, for input where the keys are the break. A break may hold any share of the rows."""
    return running(df, order, {name: ("count", F.lit(1))}, keys, rows_per_bucket).withColumn(name, F.col(name).cast("int"))


def matched(df: DataFrame, order: Sequence[str], key: str, name: str = "matched") -> DataFrame:
    """Add 1 where the key was in an earlier row, else 0. NULL keys never match. First rows are found by an aggregate, not by gathering a key."""
    firsts = df.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min(F.struct(*order)).alias("__first"))
    later = F.col("__first").isNotNull() & (F.struct(*order) > F.col("__first"))
    return df.join(firsts, F.col(f"`{key}`") == F.col("__key"), "left").withColumn(name, later.cast("int")).drop("__key", "__first")
