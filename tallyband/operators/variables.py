"""Report variables: aggregates that run with the rows or are known beforehand, over the report or a break.

kinds: count (rows with a value), countall, sum (of nothing 0), average (of nothing NULL), averageall (sum by all rows,
ignored ones too), lowest, highest. Rows whose `ignore` is true don't count. Values that are exact numbers (functions.exact) have exact
sums and averages.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.functions.exact import HALVES, divided, halves, summed, summed_columns
from tallyband.operators.prefix import BUCKET, ROWS_PER_BUCKET, bucketed, dealt_once, running, scan

KINDS = ("count", "countall", "sum", "average", "averageall", "lowest", "highest")


@dataclass(frozen=True)
class Variable:
    kind: str
    value: Column | None = None
    ignore: Column | None = None
    exact: bool = False
    """Whether value is an exact number, so that sums and averages are, too."""

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(self.kind)

    def _kept(self, x: Column) -> Column:
        return x if self.ignore is None else F.when(~F.coalesce(self.ignore, F.lit(False)), x)

    def parts(self) -> dict[str, tuple[str, Column]]:
        """The running aggregates it is made of."""
        value = None if self.value is None else self._kept(self.value)
        if self.exact and self.kind in ("sum", "average", "averageall"):
            added = {n: ("sum", x) for n, x in halves(value).items()}
            return added | ({} if self.kind == "sum" else {"n": ("count", value if self.kind == "average" else F.lit(1))})
        return {
            "count": {"n": ("count", value)},
            "countall": {"n": ("count", self._kept(F.lit(1)))},
            "sum": {"s": ("sum", value)},
            "average": {"s": ("sum", value), "n": ("count", value)},
            "averageall": {"s": ("sum", value), "n": ("count", F.lit(1))},
            "lowest": {"m": ("min", value)},
            "highest": {"m": ("max", value)},
        }[self.kind]

    def of(self, part: Mapping[str, Column]) -> Column:
        if self.kind in ("count", "countall"):
            return F.coalesce(part["n"], F.lit(0))
        if self.exact and self.kind in ("sum", "average", "averageall"):
            added = self._added(part)
            return summed(added) if self.kind == "sum" else divided(added, part["n"])
        if self.kind == "sum":
            return F.coalesce(part["s"], F.lit(0))
        if self.kind in ("average", "averageall"):
            s = part["s"] if self.kind == "average" else F.coalesce(part["s"], F.lit(0))
            return F.try_divide(s.cast("double"), part["n"])
        return part["m"]

    def _added(self, part: Mapping[str, Column]) -> dict[str, Column]:
        return {n: F.coalesce(part[n], F.lit(0)) for n in HALVES}

    def aggregate(self) -> Column:
        """As an aggregate of a groupBy."""
        kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
        return self.of({k: kinds[kind](x) for k, (kind, x) in self.parts().items()})


def _parts(variables: Mapping[str, Variable]) -> dict[str, tuple[str, Column]]:
    return {f"__v_{n}_{k}": part for n, v in variables.items() for k, part in v.parts().items()}


def _made(df: DataFrame, variables: Mapping[str, Variable]) -> DataFrame:
    """The variables of their parts, in steps where they are exact sums."""
    part = {n: {k: F.col(f"__v_{n}_{k}") for k in v.parts()} for n, v in variables.items()}
    exact_sums = {n: v._added(part[n]) for n, v in variables.items() if v.exact and v.kind == "sum"}
    out = df.withColumns({n: v.of(part[n]) for n, v in variables.items() if n not in exact_sums})
    return (summed_columns(out, exact_sums) if exact_sums else out).drop(*_parts(variables))


def running_variables(df: DataFrame, order: Sequence[str], variables: Mapping[str, Variable], by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the variables as they stand after each row; by: the break that resets them."""
    return _made(running(df, order, _parts(variables), by, rows_per_bucket), variables)


def running_of_breaks(df: DataFrame, order: Sequence[str], breaks: Sequence[tuple[Sequence[str], Mapping[str, Variable]]], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """The same for several breaks (columns, variables) in one order, with one shuffle for all: for breaks of few groups, see prefix.scan()."""
    dealt, out = dealt_once(df, order, rows_per_bucket)
    for by, variables in breaks:
        # made before the next scan, which sorts numbers then and not their parts
        out = _made(scan(out, dealt, order, _parts(variables), by), variables)
    return out.drop(BUCKET)


def grand_totals(df: DataFrame, variables: Mapping[str, Variable]) -> DataFrame:
    """Add the variables' values over the whole report to every row."""
    return df.join(F.broadcast(df.agg(*(v.aggregate().alias(n) for n, v in variables.items()))))  # one row


def group_totals(df: DataFrame, keys: Sequence[str], variables: Mapping[str, Variable], source: DataFrame | None = None) -> DataFrame:
    """Add the variables' values over each break to its rows. Aggregated first, so a hot key isn't gathered anywhere. source: what df's rows were made from, where that is less work to read again."""
    totals = (df if source is None else source).groupBy(*keys).agg(*(v.aggregate().alias(n) for n, v in variables.items()))
    same = [F.col(f"l.`{k}`").eqNullSafe(F.col(f"r.`{k}`")) for k in keys]
    return df.alias("l").join(totals.alias("r"), same).select("l.*", *(F.col(f"r.`{n}`") for n in variables))


def in_rounds(df: DataFrame, rounds: Sequence[tuple[Sequence[str], Mapping[str, Variable]]]) -> DataFrame:
    """Variables that build on precalculated ones: each round (keys, variables) sees the columns of those before it."""
    for keys, variables in rounds:
        df = group_totals(df, keys, variables) if keys else grand_totals(df, variables)
    return df


def at_last_row(df: DataFrame, order: Sequence[str], columns: Mapping[str, Column]) -> DataFrame:
    """Add to every row what the expressions are in the last one."""
    last = df.agg(F.max_by(F.struct(*(c.alias(n) for n, c in columns.items())), F.struct(*order)).alias("last")).select("last.*")
    return df.join(F.broadcast(last))  # one row


def nested_totals(df: DataFrame, levels: Sequence[str], variables: Mapping[str, Variable], depth: str = "depth") -> DataFrame:
    """A row for each break of each level and one for the report; depth: how many levels the row fixes."""
    found = df.rollup(*levels).agg(F.grouping_id().alias("__id"), *(v.aggregate().alias(n) for n, v in variables.items()))
    return found.withColumn(depth, F.lit(len(levels)) - F.bit_count("__id")).drop("__id")


@dataclass(frozen=True)
class CustomVariable:
    """A variable that the user spells out.

    base: an expression of the row (a number, string or datetime; min and max take all three). intermed: how it runs (sum, count, min or
    max) and a function of base; intermed2: the same, a function of base and intermed's result. result: a function of base,
    intermed and intermed2. ignore: rows where it is true have a NULL base. initial: added to running sums.
    """

    base: Column
    intermed: tuple[str, Callable[[Column], Column]]
    intermed2: tuple[str, Callable[[Column, Column], Column]] | None = None
    result: Callable[[Column, Column, Column], Column] = lambda base, intermed, intermed2: intermed
    ignore: Column | None = None
    initial: float | None = None

    def kept(self) -> Column:
        return self.base if self.ignore is None else F.when(~F.coalesce(self.ignore, F.lit(False)), self.base)

    def started(self, kind: str, x: Column) -> Column:
        return x if self.initial is None or kind != "sum" else F.lit(self.initial) + F.coalesce(x, F.lit(0))


def custom_variables(df: DataFrame, order: Sequence[str], variables: Mapping[str, CustomVariable], by: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the variables as they stand after each row. Two scans at most: intermed of all, then intermed2 of all."""
    out = bucketed(df.withColumns({f"__base_{n}": v.kept() for n, v in variables.items()}), order, rows_per_bucket)
    out = running(out, order, {f"__one_{n}": (v.intermed[0], v.intermed[1](F.col(f"__base_{n}"))) for n, v in variables.items()}, by)
    out = out.withColumns({f"__one_{n}": v.started(v.intermed[0], F.col(f"__one_{n}")) for n, v in variables.items()})
    second = {f"__two_{n}": (v.intermed2[0], v.intermed2[1](F.col(f"__base_{n}"), F.col(f"__one_{n}"))) for n, v in variables.items() if v.intermed2}
    if second:
        out = running(out, order, second, by)
    for n, v in variables.items():
        two = F.col(f"__two_{n}") if v.intermed2 else F.lit(None)
        out = out.withColumn(n, v.result(F.col(f"__base_{n}"), F.col(f"__one_{n}"), two))
    return out.drop(BUCKET, *(f"__{part}_{n}" for part in ("base", "one", "two") for n in variables))


def custom_totals(df: DataFrame, keys: Sequence[str], variables: Mapping[str, CustomVariable]) -> DataFrame:
    """keys and the variables over each whole group, as aggregates; intermed2 may use base alone there (its second argument is NULL), result not base."""
    kinds = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    parts = {f"__one_{n}": kinds[v.intermed[0]](v.intermed[1](v.kept())) for n, v in variables.items()}
    parts |= {f"__two_{n}": kinds[v.intermed2[0]](v.intermed2[1](v.kept(), F.lit(None))) for n, v in variables.items() if v.intermed2}
    out = df.groupBy(*keys).agg(*(x.alias(n) for n, x in parts.items()))
    made = {n: v.result(F.lit(None), v.started(v.intermed[0], F.col(f"__one_{n}")), F.col(f"__two_{n}") if v.intermed2 else F.lit(None)) for n, v in variables.items()}
    return out.select(*keys, *(x.alias(n) for n, x in made.items()))
