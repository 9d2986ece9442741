"""Strings to typed columns. What can't be read becomes NULL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.functions.exact import exact, exact_columns, let

#: Words that are numbers, in this case only.
TRUE_WORDS = ("yes", "true", "t")
FALSE_WORDS = ("no", "false", "f")

_CLOCK = r"(?:([01]?[0-9]|2[0-3]):([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]*)?)?\s*|(0?[0-9]|1[01]):([0-9]{1,2})(?::([0-9]{1,2}))?p\s*)"
_AFTER_DATE = rf"(?:[T ]+{_CLOCK}(?:([+-][0-9]{{2}}):?([0-9]{{2}})?)?)?\s*$"
#: Shapes of a date with or without a time, and what makes year|month|day|hour|minute|second and the same of the afternoon|zone of it.
_TIMES = "|$4|$5|$6|$7|$8|$9|$10|$11|"
_SHAPES = (
    (r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4}|[0-9]{2})" + _AFTER_DATE, "$3|$2|$1" + _TIMES),
    (r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})" + _AFTER_DATE, "$1|$2|$3" + _TIMES),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$", "$1|$2|$3|$4|$5|$6||||||"),
)
#: A time alone: a clock, or six or four digits.
_TIME = (
    (rf"^{_CLOCK}$", "$1|$2|$3|$4|$5|$6|"),
    (r"^([0-9]{2})([0-9]{2})([0-9]{2})?$", "$1|$2|$3||||"),
    (r"^(0[0-9]|1[01])([0-9]{2})([0-9]{2})?p$", "|||$1|$2|$3|"),
)
DAY = 86_400


def _parts(text: Column, shapes: Sequence[tuple[str, str]]) -> Column:
    """Array of the parts of the first shape that fits; NULL if none does."""
    found = F.lit(None).cast("string")
    for pattern, parts in reversed(shapes):
        found = F.when(text.rlike(pattern), F.regexp_replace(text, F.lit(pattern), F.lit(parts))).otherwise(found)
    return F.split(found, r"\|")


def _number(part: Column) -> Column:
    """A part is a few digits or empty. A try_cast of the empty string would throw inside Spark for each, which takes far longer than the rest."""
    return F.when(part != "", part.cast("int"))


def _time_of(p: Column, k: int) -> Column:
    """Seconds of the day of the six parts from k on: morning or 24 hours, then afternoon. NULL if there are none or they are no time."""
    hour, minute, second = (F.coalesce(_number(p[k + i]), _number(p[k + 3 + i])) for i in range(3))
    hour = F.when(p[k + 3] != "", hour + 12).otherwise(hour)
    second = F.coalesce(second, F.lit(0))
    return F.when((hour < 24) & (minute < 60) & (second < 61), hour * 3600 + minute * 60 + second)


def _moment(p: Column) -> Column:
    """TIMESTAMP_NTZ of the parts of a date with or without a time."""
    year = _number(p[0])
    # two digits: 69 to 99 are of the last century
    year = F.when(F.length(p[0]) == 2, year + F.when(year > 68, 1900).otherwise(2000)).otherwise(year)
    date = F.try_make_timestamp_ntz(year, _number(p[1]), _number(p[2]), F.lit(0), F.lit(0), F.lit(0))
    zone = F.coalesce(_number(p[9]), F.lit(0)) * 3600 + F.coalesce(_number(p[10]), F.lit(0)) * F.when(p[9].startswith("-"), -60).otherwise(60)
    seconds = F.when((p[3] == "") & (p[6] == ""), 0).otherwise(_time_of(p, 3)) - zone
    return date + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def cast_number(s: Column) -> Column:
    """yes, true and t are 1, no, false and f 0; else the whole string as a number in base ten, also with an exponent; NULL for all else."""
    # digits before the cast: it would take suffixes of number literals, too
    number = F.when(s.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$|(?i)^\s*(?:nan|[+-]?inf(?:inity)?)\s*$"), F.trim(s).try_cast("double"))
    return F.when(s.isin(*TRUE_WORDS), 1.0).when(s.isin(*FALSE_WORDS), 0.0).otherwise(number)


def cast_datetime(s: Column) -> Column:
    """TIMESTAMP_NTZ from d/m/y, year-month-day or 14 digits, the first two with or without a time.

    A `p` right after a time before 12 is for the afternoon; a zone (+hh, +hhmm, +hh:mm) is taken off, so that the result is in UTC.
    """
    return let(_parts(F.trim(s), _SHAPES), _moment)


def cast_time(s: Column) -> Column:
    """Seconds of the day (INT) of a time alone."""
    return let(_parts(F.trim(s), _TIME), lambda p: _time_of(p, 0))


#: Units of an interval, by field: all words for it, and what one is worth.
_UNITS = {
    "months": (("years?|yrs|y", 12), ("months?|mons?|mo", 1)),
    "days": (("weeks?", 7), ("days?|d", 1)),
    "seconds": (("hours?|hrs?|h", 3600), ("minutes?|mins?|m", 60), ("seconds?|secs?|s", 1)),
}
_ANY_UNIT = "|".join(word for units in _UNITS.values() for word, _ in units)
_CLOCK_AT_END = r"(?:-?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)?"


def cast_interval(s: Column) -> Column:
    """Struct (months, days, seconds) of numbers with units, such as '1 year 2 mons -3 days 04:05:06'. A unit given twice counts as it was given last; NULL for all else, and where all numbers are zero."""
    sizes = {}
    for words, _ in (unit for units in _UNITS.values() for unit in units):
        # all that can stand before is taken first, so the last number of the unit is found
        found = F.regexp_extract(s, rf"(?is)^(?:.*[^0-9+-])?([+-]?[0-9]+)\s*(?:{words})(?![a-z])", 1)
        sizes[words] = F.when((found != "") & (F.length(found) < 19), found.cast("long")).otherwise(0)

    def field(name: str) -> Column:
        return reduce(lambda a, b: a + b, (sizes[words] * worth for words, worth in _UNITS[name]))

    clock = F.split(F.regexp_extract(s, r"(-?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?)\s*$", 1), ":")
    size = F.abs(clock[0].cast("long")) * 3600 + F.get(clock, F.lit(1)).cast("long") * 60 + F.coalesce(F.get(clock, F.lit(2)).cast("long"), F.lit(0))
    size = F.when(F.size(clock) > 1, F.when(clock[0].startswith("-"), -size).otherwise(size)).otherwise(0)
    found = F.struct(field("months").alias("months"), field("days").alias("days"), (field("seconds") + size).alias("seconds"))
    some = reduce(lambda a, b: a | b, (x != 0 for x in (*sizes.values(), size)))
    return F.when(s.rlike(rf"(?i)^\s*(?:[+-]?[0-9]+\s*(?:{_ANY_UNIT})(?![a-z])\s*)+{_CLOCK_AT_END}\s*$") & some, found)


def cast_moment(s: Column) -> Column:
    """Struct (kind, stamp, months, days, seconds) of a date, datetime, time or interval: the first of these that the string is; else NULL.

    stamp is that of a date or datetime, seconds are those of the day for a time.
    """
    text = F.trim(s)

    def made(kind: Column | str, stamp: Column | None = None, i: Column | None = None, seconds: Column | None = None) -> Column:
        none = F.lit(None).cast("long")
        fields = [i["months"], i["days"], i["seconds"]] if i is not None else [none, none, none if seconds is None else seconds.cast("long")]
        stamp = F.lit(None).cast("timestamp_ntz") if stamp is None else stamp
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), stamp.alias("stamp"), *(f.alias(n) for f, n in zip(fields, ("months", "days", "seconds"), strict=True)))

    def dated(p: Column) -> Column:
        kind = F.when((p[3] == "") & (p[6] == ""), "date").otherwise("datetime")
        return F.when(_moment(p).isNotNull(), made(kind, _moment(p)))

    time, interval = cast_time(text), cast_interval(text)
    other = F.when(time.isNotNull(), made("time", seconds=time)).when(interval.isNotNull(), made("interval", i=interval))
    return F.coalesce(let(_parts(text, _SHAPES), dated), other)


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """types: column to string, number, exact (see functions.exact), datetime (TIMESTAMP_NTZ), time (seconds of the day), interval or moment (any of these three); others stay as they are."""
    casts = {"string": lambda c: c.cast("string"), "number": cast_number, "exact": exact, "datetime": cast_datetime, "time": cast_time, "interval": cast_interval, "moment": cast_moment}
    out = df.select(*(casts[types[c]](F.col(f"`{c}`")).alias(c) if types.get(c, "moment") not in ("moment", "exact") else F.col(f"`{c}`") for c in df.columns))
    for c in (c for c in df.columns if types.get(c) == "moment"):
        # what has several fields is parsed once, whatever is made of it: an explode isn't merged with the projections above it
        out = out.select(*(F.explode(F.array(cast_moment(F.col(f"`{c}`")))).alias(c) if x == c else F.col(f"`{x}`") for x in df.columns))
    numbers = [c for c in df.columns if types.get(c) == "exact"]
    return exact_columns(out, numbers) if numbers else out
