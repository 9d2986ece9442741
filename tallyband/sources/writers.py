"""Writers of results and of tagged sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, sep: str = ",", quotes: str = "all", mode: str = "error") -> None:
    """quotes: all cells, strings only, or none. Each file that has rows has the header, and where there are no rows a file has it alone. Quotes in quoted cells are doubled; NULL is an empty cell.

    Without quotes cells are written as they are, so cells with separators, line ends or outer quotes can't be read back.
    """
    if quotes not in ("all", "strings", "none"):
        raise ValueError(quotes)
    quoted = {f.name for f in df.schema if quotes == "all" or (quotes == "strings" and isinstance(f.dataType, T.StringType))}

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')) if name in quoted else text

    names = ['"' + c.replace('"', '""') + '"' if quotes != "none" else c for c in df.columns]
    line = F.concat_ws(sep, *map(cell, df.columns))
    first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0  # of the task, which writes a file
    header = F.lit(sep.join(names))
    lines = df.select(F.explode(F.when(first, F.array(header, line)).otherwise(F.array(line))).alias("value"))
    alone = df.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(header.alias("value"))
    lines.unionByName(alone).write.mode(mode).text(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_xml(df: DataFrame, path: str, row_tag: str = "row", root_tag: str = "data", mode: str = "error") -> None:
    df.write.mode(mode).format("xml").options(rowTag=row_tag, rootTag=root_tag).save(path)


def fixed_width(fields: Sequence[tuple[Column, int, str]]) -> Column:
    """One line of fields (value, width, left, right or center); longer values are cut."""

    def field(value: Column, width: int, align: str) -> Column:
        text = F.substr(F.coalesce(value.cast("string"), F.lit("")), F.lit(1), F.lit(width))
        if align == "right":
            return F.lpad(text, width, " ")
        if align == "center":
            before = F.floor((F.lit(width) - F.length(text)) / 2).cast("int")
            return F.rpad(F.concat(F.repeat(F.lit(" "), before), text), width, " ")
        return F.rpad(text, width, " ")

    return F.concat(*(field(*f) for f in fields))


def write_lines(df: DataFrame, fields: Sequence[tuple[Column, int, str]], path: str, mode: str = "error") -> None:
    df.select(fixed_width(fields).alias("value")).write.mode(mode).text(path)
