"""Detail columns: expressions, suppression, parameters, and columns that a small side table describes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a table of generated columns may have.
MOST_COLUMNS = 1000


def fields(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    return df.select(*(c.alias(n) for n, c in columns.items()))


def expression(df: DataFrame, name: str, value: Column, ignore: Column | None = None) -> DataFrame:
    """Add a named expression; NULL where `ignore` is true."""
    return df.withColumn(name, value if ignore is None else F.when(~F.coalesce(ignore, F.lit(False)), value))


def suppress_lines(df: DataFrame, when: Column) -> DataFrame:
    return df.filter(~F.coalesce(when, F.lit(False)))


def suppress_field(value: Column, when: Column) -> Column:
    return F.when(~F.coalesce(when, F.lit(False)), value)


def parameter(params: Mapping[str, object], name: str) -> Column:
    """A constant from outside; NULL if there is none."""
    return F.lit(params.get(name))


def generated_columns(df: DataFrame, described: DataFrame, label: str, value: str, order: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Each row of `described` (a small table) becomes a column: its label the name, its value an SQL expression over df."""
    rows = described.orderBy(*order).select(label, value).limit(MOST_COLUMNS + 1).collect()
    if len(rows) > MOST_COLUMNS:
        raise ValueError(f"over {MOST_COLUMNS} columns")
    return df.select(*keep, *(F.expr(r[1]).alias(r[0]) for r in rows))


def with_first_row(df: DataFrame, side: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add the columns of the side table's first row to all rows; NULLs if it is empty."""
    first = side.agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in side.columns)), F.struct(*order)).alias("__first"))
    return df.join(F.broadcast(first)).select("*", *(F.col(f"__first.`{c}`").alias(c) for c in side.columns)).drop("__first")  # one row
