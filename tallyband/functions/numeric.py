"""Arithmetic, bitwise, rounding, exponential and trigonometric functions. n-ary ones fold from the left."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 171! is over the largest double.
LARGEST_FACTORIAL = 170


def whole(x: Column) -> Column:
    """To a 64-bit whole number, to nearest."""
    return F.rint(x).cast("long")


def add(*xs: Column) -> Column:
    return reduce(lambda a, b: a + b, xs)


def sub(*xs: Column) -> Column:
    return reduce(lambda a, b: a - b, xs)


def mul(*xs: Column) -> Column:
    return reduce(lambda a, b: a * b, xs)


def div(*xs: Column) -> Column:
    """Division by zero gives NULL."""
    return reduce(F.try_divide, xs)


def mod(a: Column, b: Column) -> Column:
    """Remainder of the quotient cut toward zero; by zero NULL."""
    return F.try_mod(a, b)


remainder = fmod = mod


def uminus(x: Column) -> Column:
    return -x


def uplus(x: Column) -> Column:
    return x


def inc(x: Column) -> Column:
    return x + 1


def dec(x: Column) -> Column:
    return x - 1


def factorial(n: Column) -> Column:
    """Double; NULL below 0 and over LARGEST_FACTORIAL."""
    values = F.array(*(F.lit(float(math.factorial(k))) for k in range(LARGEST_FACTORIAL + 1)))
    return F.get(values, n.cast("int"))


def bit_and(*xs: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseAND(b), map(whole, xs))


def bit_or(*xs: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), map(whole, xs))


def bit_xor(*xs: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), map(whole, xs))


def bit_not(x: Column) -> Column:
    return F.bitwise_not(whole(x))


def shl(x: Column, n: int) -> Column:
    return F.shiftleft(whole(x), n)


def shr(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(whole(x), n)


def fxpval(x: Column, places: int) -> Column:
    """A number, or a string of one, with the decimal point moved `places` to the left."""
    return x.try_cast("double") / F.lit(10.0**places)


def random(seed: int | None = None) -> Column:
    return F.rand(seed)


def round_away(x: Column) -> Column:
    """Halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def sqr(x: Column) -> Column:
    return x * x


def exp2(x: Column) -> Column:
    return F.pow(F.lit(2.0), x)


def exp10(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


abs_ = F.abs
ceil, floor, rint = F.ceil, F.floor, F.rint
pow_, sqrt = F.pow, F.sqrt
ln, log, log2, log10, exp = F.ln, F.ln, F.log2, F.log10, F.exp
sin, cos, tan, asin, acos, atan, sec, csc, cot = F.sin, F.cos, F.tan, F.asin, F.acos, F.atan, F.sec, F.csc, F.cot
