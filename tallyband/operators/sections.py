"""Reports as tagged rows: report header, break headers, details, break footers, report footer, in output order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyband.operators.breaks import break_islands
from tallyband.operators.prefix import ROWS_PER_BUCKET, row_numbers
from tallyband.operators.variables import Variable
from tallyband.storage import stored

POSITION = "__at_"
ORDER = "__order_"


def _not_blank(keys: Sequence[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test &= F.col(k).isNotNull() & (F.col(k).cast("string") != "")
    return test


def sectioned(
    df: DataFrame,
    order: Sequence[str],
    breaks: Sequence[str],
    details: Mapping[str, Column],
    variables: Mapping[str, Variable],
    suppress_blank: bool = False,
    no_data: str | None = None,
    islands: bool = False,
) -> DataFrame:
    """section, break_name, the breaks, details, variables and the columns that sort rows into output order (names from POSITION and ORDER).

    df is meant to be ordered by (breaks, order). Headers stand before a group's details, outer ones first, footers after
    them, inner ones first; both have the group's variables, headers the details of its first row, footers those of
    its last. Groups come in the order of their typed keys, NULL first. suppress_blank: no header and footer for a group whose break
    field is NULL or empty. no_data: a section for an empty table. All headers and footers come from one pass over df, details from another. islands: df is ordered by `order` alone, and a group is a run of
    rows with equal fields; NULL fields start a group each.
    """
    depth = len(breaks)
    keys = list(breaks)
    if islands:
        df = stored(break_islands(df, order, {b: [b] for b in breaks}), "islands")
        keys = [f"{b}_no" for b in breaks]
    row = F.struct(*order)
    values = F.struct(*(c.alias(n) for n, c in details.items()), *(F.col(b).alias(f"__b_{b}") for b in breaks))
    nothing = lambda name: F.lit(None).cast(df.schema[name].dataType)

    # one pass makes the innermost groups, all outer ones come from these
    parts = {f"__p_{n}_{k}": part for n, v in variables.items() for k, part in v.parts().items()}
    add = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}
    merge = add | {"count": F.sum}
    own = [add[kind](x).alias(n) for n, (kind, x) in parts.items()]
    inner = df.groupBy(*keys).agg(F.min(row).alias("__from"), F.max(row).alias("__to"), F.min_by(values, row).alias("__first"), F.max_by(values, row).alias("__last"), *own)
    merged = [merge[kind](n).alias(n) for n, (kind, _) in parts.items()]
    groups = (inner.rollup(*keys) if keys else inner.filter("__from IS NOT NULL").groupBy()).agg(
        (F.grouping_id() if keys else F.lit(0)).alias("__id"), F.count(F.lit(1)).alias("__n"), F.min_by("__first", "__from").alias("__first"), F.max_by("__last", "__to").alias("__last"), *merged
    )
    groups = groups.filter("__n > 0").withColumn("__level", F.lit(depth) - F.bit_count("__id"))
    if suppress_blank:
        for level, b in enumerate(breaks, 1):
            groups = groups.withColumn("__blank", F.col(f"__first.`__b_{b}`")).filter((F.col("__level") != level) | _not_blank(["__blank"])).drop("__blank")
    sides = F.explode(F.array(*(F.struct(F.lit(n).alias("rank"), F.col(c).alias("row")) for n, c in ((0, "__first"), (2, "__last")))))
    groups = groups.withColumn("__side", sides).select("*", F.col("__side.rank").alias("__rank"), F.col("__side.row").alias("__row"))

    # for each break the rank (1: below it) and the key; where `level` breaks are fixed, rank 0 stands before and 2 after all below them
    level, rank = F.col("__level"), F.col("__rank")
    head = F.when(rank == 0, "header").otherwise("footer")
    name = F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, breaks)), level + 1)
    place = [c for k in range(depth) for c in (F.when(level > k, 1).when(level == k, rank).otherwise(0).alias(f"{POSITION}{2 * k}"), F.col(keys[k]).alias(f"{POSITION}{2 * k + 1}"))]
    place.append(F.when(level == depth, rank).otherwise(0).alias(f"{POSITION}{2 * depth}"))
    made = {n: v.of({k: F.col(f"__p_{n}_{k}") for k in v.parts()}).alias(n) for n, v in variables.items()}
    shown = [F.when(level > k, F.col(f"__row.`__b_{b}`")).alias(b) for k, b in enumerate(breaks)]
    tag = F.concat(F.when(level > 0, "break_").otherwise("report"), head)
    out = groups.select(tag.alias("section"), name.alias("break_name"), *shown, *place, *(F.col(f"__row.`{n}`").alias(n) for n in details), *made.values())
    if no_data is not None:
        empty = df.limit(1).agg(F.count(F.lit(1)).alias("__n")).filter("__n = 0")
        at = [c for k in range(depth) for c in (F.lit(0).alias(f"{POSITION}{2 * k}"), nothing(keys[k]).alias(f"{POSITION}{2 * k + 1}"))]
        none = empty.select(F.lit(no_data).alias("section"), F.lit(None).cast("string").alias("break_name"), *(nothing(b).alias(b) for b in breaks), *at, F.lit(0).alias(f"{POSITION}{2 * depth}"))
        out = out.unionByName(none, allowMissingColumns=True)
    at = [c for k in range(depth) for c in (F.lit(1).alias(f"{POSITION}{2 * k}"), F.col(keys[k]).alias(f"{POSITION}{2 * k + 1}"))]
    lines = df.select(
        F.lit("fielddetails").alias("section"), F.lit(None).cast("string").alias("break_name"), *breaks, *at, F.lit(1).alias(f"{POSITION}{2 * depth}"),
        *(c.alias(n) for n, c in details.items()), *(F.col(c).alias(f"{ORDER}{k}") for k, c in enumerate(order)),
    )
    return out.unionByName(lines, allowMissingColumns=True)


def _sort_keys(report: DataFrame) -> list[str]:
    return [c for prefix in (POSITION, ORDER) for c in report.columns if c.startswith(prefix)]


def in_output_order(report: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows as they are to be written: ranges of the output, each sorted; no single task takes all. Drops the sort keys."""
    keys = _sort_keys(report)
    dealt = report.repartitionByRange(partitions, *keys) if partitions else report.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).drop(*keys)


def numbered(report: DataFrame, name: str = "line", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add each row's place in the output, from 1, instead of the sort keys."""
    keys = _sort_keys(report)
    return row_numbers(stored(report, "report"), keys, name, rows_per_bucket).drop(*keys)
