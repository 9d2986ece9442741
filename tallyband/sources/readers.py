"""Readers. Text formats give strings in all columns; types are applied after."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyband.sources.casts import cast_columns
from tallyband.sources.splits import csv_records, json_head, json_objects


def read_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, encoding: str = "UTF-8", sep: str = ",", columns: Sequence[str] | None = None, quotes: bool = True, line_ends: bool = False) -> DataFrame:
    """Header in the first line. Empty and missing cells are NULL, cells beyond the header are dropped.

    quotes: cells may be quoted, with quotes in them doubled; without it all characters stand for themselves. line_ends: quoted cells
    may hold line ends (see splits.csv_records); files are split over tasks in either case. An encoding with characters of two bytes
    and more, other than UTF-8, can't have line_ends.

    columns: the header's names, if known; else the first line of the files is read for them. encoding: one that Spark reads;
    with spark.sql.legacy.javaCharsets any of Java's.
    """
    options = {"header": True, "encoding": encoding, "sep": sep, "quote": '"' if quotes else "", "escape": '"' if quotes else "", "multiLine": line_ends}
    if columns is None:
        columns = spark.read.csv(path, **options).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    cells = {"mode": "PERMISSIVE", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    if line_ends and quotes:
        as_text = {k: str(v).lower() if isinstance(v, bool) else v for k, v in (cells | {"sep": sep, "quote": '"', "escape": '"'}).items()}
        records = csv_records(spark, path, encoding).filter(~F.col("header"))
        table = records.select(F.from_csv("record", ", ".join(f"`{c}` string" for c in columns), as_text).alias("row")).select("row.*")
    else:
        table = spark.read.csv(path, schema=schema, enforceSchema=True, **cells, **options)
    return cast_columns(table, types or {})


def read_json_rows(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """One document {columns, coltypes, rows: [{..}]}, split over tasks whether or not it has lines (see splits.json_objects)."""
    head = json_head(spark, path, encoding)
    columns = head["columns"]
    if types is None:
        types = dict(zip(columns, head["coltypes"] or [], strict=False))
    row = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    records = json_objects(spark, path, encoding=encoding)
    return cast_columns(records.select(F.from_json("record", row).alias("row")).select("row.*"), types)


def read_json_lines(spark: SparkSession, path: str, columns: Sequence[str], types: Mapping[str, str] | None = None) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return cast_columns(spark.read.schema(schema).json(path), types or {})


def read_xml_rows(spark: SparkSession, path: str, columns: Sequence[str] | None = None, types: Mapping[str, str] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """<data><rows><row><col/>..</row></rows><fields><field/>..</fields></data>; cells go by position."""
    if columns is None:
        fields = spark.read.format("xml").options(rowTag="fields", charset=encoding).schema("field array<string>").load(path)
        columns = fields.first()["field"]
    rows = spark.read.format("xml").options(rowTag="row", charset=encoding).schema("col array<string>").load(path)
    return cast_columns(rows.select(*(F.get("col", F.lit(k)).alias(c) for k, c in enumerate(columns))), types or {})


def read_jdbc(spark: SparkSession, url: str, query: str, fetch_rows: int = 1024, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """partition: column, lowest, highest and number of parts of equal width, each read by a task of its own. See also read_jdbc_parts()."""
    reader = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_rows).options(**options)
    if partition is None:
        return reader.option("query", query).load()
    column, low, high, parts = partition
    return reader.option("dbtable", f"({query}) q").options(partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts).load()


#: Bins of a part in the histograms that read_jdbc_parts() asks for, and how often it looks into a bin that holds too much.
BINS, LOOKS = 16, 4


def _cuts(spark: SparkSession, url: str, query: str, column: str, low: float, high: float, parts: int, share: float, looks: int, options: dict) -> list[float]:
    """Bounds between low and high, so that the rows between two are about `share`. The database counts the bins."""
    bins = BINS * parts
    width = (high - low) / bins
    if width <= 0 or looks == 0:
        return []
    number = f"FLOOR(({column} - ({low!r})) / ({width!r}))"
    inner = f"SELECT {number} AS BIN FROM ({query}) Q WHERE {column} >= {low!r} AND {column} < {high!r}"
    counts = f"SELECT BIN, COUNT(*) AS N FROM ({inner}) B GROUP BY BIN"
    rows = spark.read.format("jdbc").option("url", url).option("query", counts).options(**options).load().collect()  # a row a bin
    out, held = [], 0
    for k, n in sorted((int(r[0]), int(r[1])) for r in rows):
        start, stop = low + k * width, low + (k + 1) * width
        if held and held + n > share:
            out.append(start)
            held = 0
        if n > share:
            out += [*_cuts(spark, url, query, column, start, stop, max(2, round(n / share)), share, looks - 1, options), stop]
            held = 0
        else:
            held += n
    return out


def read_jdbc_parts(spark: SparkSession, url: str, query: str, column: str, parts: int, fetch_rows: int = 1024, **options: str) -> DataFrame:
    """A query in parts of about equal numbers of rows, by ranges of a number column; NULLs are a part of their own.

    The bounds come from histograms that the database makes; a bin with more than a part's rows is looked into. One value isn't split.
    """
    ask = spark.read.format("jdbc").option("url", url).options(**options)
    low, high, n = ask.option("query", f"SELECT MIN({column}) AS LOW_K, MAX({column}) AS HIGH_K, COUNT({column}) AS N_K FROM ({query}) Q").load().first()
    cuts = [] if low is None else sorted(set(_cuts(spark, url, query, column, float(low), float(high), parts, n / parts, LOOKS, options)))
    cuts = [c for c in cuts if float(low) < c <= float(high)] if cuts else []
    bounds = [None, *cuts, None]
    predicates = [" AND ".join(x for x in (f"{column} >= {a!r}" if a is not None else "", f"{column} < {b!r}" if b is not None else "") if x) or f"{column} IS NOT NULL" for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return spark.read.jdbc(url, f"({query}) Q", predicates=[*predicates, f"{column} IS NULL"], properties=options | {"fetchsize": str(fetch_rows)})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def from_rows(spark: SparkSession, rows: Sequence[Sequence], types: Mapping[str, str] | None = None) -> DataFrame:
    """A small table from memory: names in the first row, then cells, all taken as strings."""
    names, *cells = rows
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return cast_columns(spark.createDataFrame([tuple(None if x is None else str(x) for x in row) for row in cells], schema), types or {})


def register_source(spark: SparkSession, name: str, schema: str, parts: Callable[[dict], Sequence], rows: Callable[[object], object]) -> None:
    """A format for spark.read.format(name). parts(options) lists what tasks read; rows(part) yields a part's tuples."""

    class Part(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: dict):
            self.options = options

        def partitions(self):
            return [Part(p) for p in parts(self.options)]

        def read(self, partition):
            yield from rows(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema):
            return Reader(dict(self.options))

    spark.dataSource.register(Source)
