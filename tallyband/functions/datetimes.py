"""Dates, times and intervals.

A date is DATE, a date with a time TIMESTAMP_NTZ, a time alone its seconds of the day (INT). An interval is a struct of
whole numbers (months, days, seconds) whose fields stay apart: a month has no fixed number of days.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyband.functions.exact import let
from tallyband.sources.casts import DAY, cast_datetime, cast_interval, cast_time


def stodt(s: Column) -> Column:
    return cast_datetime(s)


def stod(s: Column) -> Column:
    return F.to_date(cast_datetime(s))


def tstod(s: Column) -> Column:
    """Seconds of the day of a string that is a time alone: h:m[:s][p], or six or four digits."""
    return cast_time(s)


def now() -> Column:
    return F.current_timestamp()


def date() -> Column:
    return F.current_date()


year, month, day = F.year, F.month, F.dayofmonth


def dim(d: Column) -> Column:
    """Days of the month."""
    return F.dayofmonth(F.last_day(d))


def wiy(d: Column) -> Column:
    """Week of the year; weeks start on Sunday, days before the first one are in week 0."""
    return F.floor((F.dayofyear(d) - 1 + 7 - (F.dayofweek(d) - 1)) / 7).cast("int")


def wiy1(d: Column) -> Column:
    """The same, weeks starting on Monday."""
    return F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7).cast("int")


def wiyo(d: Column, first: int) -> Column:
    """The same, weeks starting `first` days after Sunday."""
    shifted, plain = wiy(F.date_sub(F.to_date(d), first % 7)), wiy(d)
    return F.when(shifted > plain, 0).otherwise(shifted)


stdwiy = F.weekofyear
dateof = F.to_date


def timeof(d: Column, is_date: bool = False) -> Column:
    """Seconds of the day; a date alone has no time."""
    return F.lit(None).cast("int") if is_date else gettimeinsecs(d)


def gettimeinsecs(d: Column) -> Column:
    return F.hour(d) * 3600 + F.minute(d) * 60 + F.second(d)


def _at(date: Column, seconds: Column) -> Column:
    return F.to_date(date).cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def chgdateof(a: Column, b: Column) -> Column:
    """a with the date of b."""
    return _at(b, gettimeinsecs(a))


def chgtimeof(a: Column, b: Column) -> Column:
    """a with the time of b."""
    return _at(a, gettimeinsecs(b))


def settimeinsecs(d: Column, seconds: Column) -> Column:
    """NULL unless 0 <= seconds < a day."""
    return F.when(seconds.between(0, DAY - 1), _at(d, seconds))


def add_days(d: Column, n: Column) -> Column:
    """A date and a number: days; a fraction is cut off."""
    return F.date_add(F.to_date(d), n.cast("int"))


def add_seconds(d: Column, n: Column) -> Column:
    """A date with a time and a number: seconds."""
    return d.cast("timestamp_ntz") + F.make_dt_interval(secs=n.cast("long").cast("decimal(18,6)"))


def add_seconds_of_day(t: Column, n: Column) -> Column:
    """A time alone and a number: seconds, around midnight."""
    return F.pmod(t + n.cast("int"), F.lit(DAY))


def interval(years=0, months=0, days=0, hours=0, minutes=0, seconds=0) -> Column:
    def c(x) -> Column:
        return (F.lit(x) if isinstance(x, int) else x).cast("long")

    return F.struct((c(years) * 12 + c(months)).alias("months"), c(days).alias("days"), (c(hours) * 3600 + c(minutes) * 60 + c(seconds)).alias("seconds"))


def parse_interval(s: Column) -> Column:
    """From words such as '1 year 2 mons -3 days 04:05:06'; NULL where there is none."""
    return cast_interval(s)


def add_interval(d: Column, i: Column) -> Column:
    """TIMESTAMP_NTZ. Months first, to the month's last day if need be, then days and seconds."""
    stamp = d.cast("timestamp_ntz")
    moved = F.date_add(F.add_months(F.to_date(stamp), i["months"].cast("int")), i["days"].cast("int"))
    return moved.cast("timestamp_ntz") + F.make_dt_interval(secs=(gettimeinsecs(stamp) + i["seconds"]).cast("decimal(18,6)"))


def add_interval_to_date(d: Column, i: Column) -> Column:
    """DATE, for intervals without hours, minutes and seconds."""
    return F.to_date(add_interval(d, i))


def negated(i: Column) -> Column:
    return F.struct((-i["months"]).alias("months"), (-i["days"]).alias("days"), (-i["seconds"]).alias("seconds"))


def sum_intervals(a: Column, b: Column) -> Column:
    return F.struct(*((a[f] + b[f]).alias(f) for f in ("months", "days", "seconds")))


def difference(a: Column, b: Column) -> Column:
    """a - b field by field: months, then days of the months (also negative), then seconds of a day, a day borrowed if need be."""
    a, b = a.cast("timestamp_ntz"), b.cast("timestamp_ntz")
    seconds = gettimeinsecs(a) - gettimeinsecs(b)
    borrow = F.when(seconds < 0, 1).otherwise(0)
    months = (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)
    days = F.dayofmonth(a) - F.dayofmonth(b) - borrow
    return F.struct(months.cast("long").alias("months"), days.cast("long").alias("days"), (seconds + borrow * DAY).cast("long").alias("seconds"))


def compare_dates(a: Column, b: Column) -> tuple[Column, Column]:
    """Both as dates, for comparing a date with a date and time: what both have."""
    return F.to_date(a), F.to_date(b)


# --- values whose kind is known with the row only: see casts.cast_moment -----------------------------------------------------


def _with(m: Column, **fields: Column) -> Column:
    return F.struct(*((fields[n] if n in fields else m[n]).alias(n) for n in ("kind", "stamp", "months", "days", "seconds")))


def plus_number(m: Column, n: Column) -> Column:
    """A moment and a number: days for a date; seconds for a date with a time, a time (around midnight) and an interval. Fractions are cut off."""
    n = n.cast("long")
    on = m["stamp"] + F.make_dt_interval(days=F.when(m["kind"] == "date", n).otherwise(0).cast("int"), secs=F.when(m["kind"] == "date", 0).otherwise(n).cast("decimal(18,6)"))
    seconds = F.when(m["kind"] == "time", F.pmod(m["seconds"] + n, F.lit(DAY))).otherwise(m["seconds"] + n)
    return F.when(m["kind"].isNotNull() & n.isNotNull(), _with(m, stamp=on, seconds=seconds))


def minus_number(m: Column, n: Column) -> Column:
    return plus_number(m, -n.cast("long"))


def inc(m: Column) -> Column:
    return plus_number(m, F.lit(1))


def dec(m: Column) -> Column:
    return plus_number(m, F.lit(-1))


def plus_interval(m: Column, i: Column) -> Column:
    """A moment and an interval (a struct of months, days, seconds). A date becomes a date with a time if the interval has seconds; two intervals add up."""
    kind = F.when((m["kind"] == "date") & (i["seconds"] != 0), "datetime").otherwise(m["kind"])
    of_day = F.pmod(m["seconds"] + i["seconds"], F.lit(DAY))
    seconds = F.when(m["kind"] == "time", of_day).otherwise(m["seconds"] + i["seconds"])
    out = _with(m, kind=kind, stamp=add_interval(m["stamp"], i), months=m["months"] + i["months"], days=m["days"] + i["days"], seconds=seconds)
    return F.when(m["kind"].isNotNull() & i.isNotNull(), out)


def minus_moment(a: Column, b: Column) -> Column:
    """a - b: less an interval, or the interval between two dates or two times; NULL for other kinds."""
    none, zero = F.lit(None).cast("timestamp_ntz"), F.lit(0).cast("long")

    def minus(b: Column) -> Column:
        gap = difference(a["stamp"], b["stamp"])
        between = _with(a, kind=F.lit("interval"), stamp=none, months=gap["months"], days=gap["days"], seconds=gap["seconds"])
        times = _with(a, kind=F.lit("interval"), stamp=none, months=zero, days=zero, seconds=a["seconds"] - b["seconds"])
        less = plus_interval(a, F.struct(*((-b[f]).alias(f) for f in ("months", "days", "seconds"))))
        return F.when(b["kind"] == "interval", less).when((a["kind"] == "time") & (b["kind"] == "time"), times).when(gap["days"].isNotNull(), between)

    return let(b, minus)
