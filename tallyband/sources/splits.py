"""Records of text files that are cut anywhere: what a piece of a file is depends on all before it, so pieces pass on a state that composes.

A file is read in pieces that end at one character, by as many tasks as Spark plans for its size. Whether a piece starts inside quotes is the
parity of the quotes before it: each block of a file (what a task reads) sums its quotes, a scan over the blocks gives the parity
that each starts with, and a window inside the block does the rest. Pieces that stand for themselves go straight on; only those of a record
that has several are put together. No task takes more than a block and no file is read whole.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BLOCK = ["__file", "__block"]


def _before(upto: int = -1) -> Window:
    """A block's pieces before this one, or up to it."""
    return Window.partitionBy(*_BLOCK).orderBy("__id").rowsBetween(Window.unboundedPreceding, upto)


def _earlier() -> Window:
    """A file's blocks before this one."""
    return Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)


def pieces(spark: SparkSession, path: str, end: str, encoding: str = "UTF-8") -> DataFrame:
    """value (a piece without its end), __file, __block and __id, which rises inside a block. encoding: one whose characters below 128 are single bytes."""
    text = spark.read.text(path, lineSep=end)
    if encoding.upper() not in ("UTF-8", "UTF8"):
        text = text.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block")]
    return text.select("value", *at).withColumn("__id", F.monotonically_increasing_id())


def _counted(value: Column, character: str) -> Column:
    return F.length(value) - F.length(F.translate(value, character, ""))


def _odd(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)) % 2 == 1


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """record and header (whether it is its file's first one) of every record; quoted cells may hold line ends."""
    rows = pieces(spark, path, "\n", encoding).withColumn("__q", _counted(F.col("value"), '"'))
    rows = rows.withColumn("__inside", F.sum("__q").over(_before()))
    # a record starts where as many quotes close as open; how many do so in a block, whichever way it starts
    even = ~_odd(F.col("__inside"))
    blocks = rows.groupBy(*_BLOCK).agg(F.sum("__q").alias("__sum"), F.sum(even.cast("long")).alias("__if_even"), F.sum((~even).cast("long")).alias("__if_odd"))
    blocks = blocks.withColumn("__start", F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)))
    blocks = blocks.withColumn("__n", F.when(_odd(F.col("__start")), F.col("__if_odd")).otherwise(F.col("__if_even")))
    owner = F.last(F.when(F.col("__n") > 0, F.struct(F.col("__block").alias("block"), F.col("__n").alias("n"))), ignorenulls=True).over(_earlier())
    first = F.min("__block").over(Window.partitionBy("__file"))
    blocks = blocks.select(*_BLOCK, "__start", owner.alias("__owner"), first.alias("__first"))

    rows = rows.join(blocks, _BLOCK)
    opens = ~_odd(F.coalesce("__inside", F.lit(0)) + F.col("__start"))
    rows = rows.withColumn("__opens", opens)
    rows = rows.withColumn("__no", F.sum(F.col("__opens").cast("long")).over(_before(0)))
    alone = F.col("__opens") & ~_odd(F.col("__q"))
    header = (F.col("__block") == F.col("__first")) & (F.col("__no") == 1)
    singles = rows.filter(alone).select(F.col("value").alias("record"), header.alias("header"))
    # lines before a block's first start belong to the last record of a block before it
    own = F.when(F.col("__no") > 0, F.struct(F.col("__block").alias("block"), F.col("__no").alias("n"))).otherwise(F.col("__owner"))
    several = rows.filter(~alone).withColumn("__own", own).groupBy("__file", "__own", "__first")
    several = several.agg(F.array_sort(F.collect_list(F.struct("__block", "__id", "value"))).alias("__all"))
    joined = F.array_join(F.transform("__all", lambda x: x["value"]), "\n")
    first_one = (F.col("__own.block") == F.col("__first")) & (F.col("__own.n") == 1)
    out = singles.unionByName(several.select(joined.alias("record"), first_one.alias("header")))
    return out.withColumn("record", F.regexp_replace("record", "\r$", "")).filter("record != ''")


def json_objects(spark: SparkSession, path: str, depth: int = 2, encoding: str = "UTF-8") -> DataFrame:
    """record, the text of each object that stands in `depth` brackets of its document, one document a file, in an array named rows.

    Pieces end at closing braces, so a document may be one line. Two scans: quotes that aren't escaped, then brackets outside strings.
    """
    rows = pieces(spark, path, "}", encoding).withColumn("__plain", F.regexp_replace("value", r"\\.", ""))
    rows = rows.withColumn("__q", _counted(F.col("__plain"), '"')).withColumn("__inside", F.sum("__q").over(_before()))
    blocks = rows.groupBy(*_BLOCK).agg(F.sum("__q").alias("__sum"))
    blocks = blocks.select(*_BLOCK, F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)).alias("__start"))
    rows = rows.join(blocks, _BLOCK)
    quoted = _odd(F.coalesce("__inside", F.lit(0)) + F.col("__start"))
    # without its strings: a piece that starts in one starts with its end
    bare = F.regexp_replace(F.concat(F.when(quoted, '"').otherwise(""), "__plain"), r'"[^"]*("|$)', "")
    ends = ~_odd(F.coalesce("__inside", F.lit(0)) + F.col("__start") + F.col("__q"))
    rows = rows.select("value", *_BLOCK, "__id", bare.alias("__bare"), ends.alias("__ends"))
    opened = F.length(F.regexp_replace("__bare", r"[^\[{]", "")) - F.length(F.regexp_replace("__bare", r"[^\]}]", ""))
    rows = rows.withColumn("__step", opened - F.col("__ends").cast("int")).drop("__bare")
    rows = rows.withColumn("__deep", F.sum("__step").over(_before(0)))
    blocks = rows.groupBy(*_BLOCK).agg(F.sum("__step").alias("__sum"))
    blocks = blocks.select(*_BLOCK, F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)).alias("__level"))
    rows = rows.join(blocks, _BLOCK).withColumn("__deep", F.col("__deep") + F.col("__level")).drop("__level")
    # a record ends with a piece that leaves `depth` brackets open; count the ends before each piece
    rows = rows.withColumn("__last", F.col("__ends") & (F.col("__deep") == depth))
    rows = rows.withColumn("__no", F.coalesce(F.sum(F.col("__last").cast("long")).over(_before()), F.lit(0)))
    blocks = rows.groupBy(*_BLOCK).agg(F.sum(F.col("__last").cast("long")).alias("__sum"))
    blocks = blocks.select(*_BLOCK, F.coalesce(F.sum("__sum").over(_earlier()), F.lit(0)).alias("__ended"))
    rows = rows.join(blocks, _BLOCK).withColumn("__no", F.col("__no") + F.col("__ended"))
    alone = F.col("__last") & F.col("value").rlike(r"^\s*,\s*\{[^{]*$")
    singles = rows.filter(alone).select(F.col("value").alias("record"))
    several = rows.filter(~alone).groupBy("__file", "__no").agg(F.array_sort(F.collect_list(F.struct("__block", "__id", "value"))).alias("__all"), F.max("__last").alias("__whole"))
    several = several.filter("__whole").select(F.array_join(F.transform("__all", lambda x: x["value"]), "}").alias("record"))
    # what stands before a record is a comma, or all of the document down to its rows
    before = r'^\s*(?:,|\{[\s\S]*?"rows"\s*:\s*\[)\s*'
    return singles.unionByName(several).withColumn("record", F.concat(F.regexp_replace("record", before, ""), F.lit("}")))


def json_head(spark: SparkSession, path: str, encoding: str = "UTF-8") -> dict:
    """columns and coltypes of a document: from its first piece, or, where they stand after the rows, from a parse of the whole document."""
    first = pieces(spark, path, "}", encoding).orderBy("__file", "__block", "__id").select("value").first()
    found = re.match(r'\s*\{([\s\S]*?)"rows"\s*:\s*\[', first["value"]) if first else None
    head = json.loads("{" + found[1].rstrip().rstrip(",") + "}") if found else {}
    if "columns" not in head:
        head = spark.read.schema("columns array<string>, coltypes array<string>").json(path, multiLine=True, encoding=encoding).first().asDict()
    return {"columns": head["columns"], "coltypes": head.get("coltypes")}
