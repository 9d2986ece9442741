"""Comparison, logic, NULL and type tests. Truth is 1 or 0 as a whole number; numbers are true when not zero."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyband.sources.casts import cast_datetime, cast_number


def _number(test: Column) -> Column:
    return test.cast("int")


def eq(a: Column, b: Column) -> Column:
    return _number(a == b)


def ne(a: Column, b: Column) -> Column:
    return _number(a != b)


def lt(a: Column, b: Column) -> Column:
    return _number(a < b)


def le(a: Column, b: Column) -> Column:
    return _number(a <= b)


def gt(a: Column, b: Column) -> Column:
    return _number(a > b)


def ge(a: Column, b: Column) -> Column:
    return _number(a >= b)


def _strict(xs: tuple[Column, ...], join: Callable[[Column, Column], Column]) -> Column:
    """NULL if any operand is, also where SQL would decide without it."""
    missing = reduce(lambda a, b: a | b, (x.isNull() for x in xs))
    return F.when(~missing, _number(reduce(join, (x != 0 for x in xs))))


def land(*xs: Column) -> Column:
    return _strict(xs, lambda a, b: a & b)


def lor(*xs: Column) -> Column:
    return _strict(xs, lambda a, b: a | b)


def lnot(x: Column) -> Column:
    return _number(x == 0)


def iif(test: Column, then: Column, other: Column) -> Column:
    """A NULL test gives NULL."""
    return F.when(test.isNotNull(), F.when(test != 0, then).otherwise(other))


def isnull(x: Column) -> Column:
    return _number(x.isNull())


def isnan(x: Column) -> Column:
    return F.when(x.isNotNull(), _number(F.isnan(x)))


def _kind(df: DataFrame, name: str) -> str:
    kind = df.schema[name].dataType
    if isinstance(kind, T.NumericType | T.BooleanType):
        return "number"
    return "string" if isinstance(kind, T.StringType) else "datetime"


def is_kind(df: DataFrame, name: str, kind: str) -> Column:
    """1 if the column is a number, string or datetime by its type, else 0."""
    return F.lit(int(_kind(df, name) == kind))


def iserror(x: Column, kind: str) -> Column:
    """1 where a string is there but can't be read as a number or datetime."""
    read = {"number": cast_number, "datetime": cast_datetime}[kind](x)
    return _number(x.isNotNull() & read.isNull())


def error(message: str) -> Column:
    return F.raise_error(F.lit(message))


def null(kind: str) -> Column:
    """A NULL of kind number, string or datetime."""
    return F.lit(None).cast({"number": "double", "string": "string", "datetime": "timestamp_ntz"}[kind])


def vector(op: str, left: list[Column], right: list[Column]) -> Column:
    """Element by element, all of them: also <, and != too."""
    if len(left) != len(right):
        raise ValueError("vectors differ in length")
    compare = {"=": eq, "!=": ne, "<": lt, "<=": le, ">": gt, ">=": ge}[op]
    return land(*(compare(a, b) for a, b in zip(left, right, strict=True)))
