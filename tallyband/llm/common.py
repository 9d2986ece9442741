"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyband.shipping import ship
from tallyband.storage import work_path


#: Rows of a narrow table that make a file worth its task.
ROWS_PER_FILE = 200_000


def work_table(df: DataFrame, name: str, most_rows: int | None = None, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors.

    most_rows: a bound of its rows, where one is known; a small table then becomes few files.
    """
    spark = df.sparkSession
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // ROWS_PER_FILE)))
    path = work_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of rows that go to a Python worker in one batch, about; Spark's own bound is 64 MB, which the JVM and the worker both hold for each task.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_OWN = f"{64 << 20}b"


def _bound_batches(spark: SparkSession) -> None:
    """BATCH_BYTES for this session, unless it was given a bound of its own. Batches have no meaning in this subpackage, so results are the same."""
    if spark.conf.get(_BATCH_SETTING, _SPARKS_OWN) == _SPARKS_OWN:
        spark.conf.set(_BATCH_SETTING, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Hand memory that is free in this Python process back to the machine: Spark keeps workers for later tasks, and the driver lives as long as the job."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    _bound_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def larger(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of `rows` at least, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(n: int, name: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one long column that may be broadcast; more are joined by a shuffle.
BROADCAST_TAGS = 1_000_000


#: The column of tagged(); a reserved name.
TAG = "__tallyband_row_tag"


def row_tag() -> Column:
    """A number for each row, for one scan only: another scan may split the files in another way. See tagged()."""
    return F.monotonically_increasing_id().alias("tag")


def tagged(docs: DataFrame) -> DataFrame:
    """docs with a number for each row in column TAG, stored with the rows, so that every scan has the same."""
    if TAG in docs.columns:
        return docs
    return work_table(docs.withColumn(TAG, row_tag()), "tagged")


def stored_tag(docs: DataFrame) -> Column:
    """The stored number of rows of tagged(), as column tag; for other tables row_tag(), for one scan only."""
    return F.col(TAG).alias("tag") if TAG in docs.columns else row_tag()


def drop_rows(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """docs, made by tagged(), without the rows whose numbers are in tags, and without TAG.

    Few tags are broadcast, so that texts are not shuffled; beyond BROADCAST_TAGS an ordinary join does it.
    """
    tags = work_table(tags, "dropped-tags")
    gone = F.broadcast(tags) if tags.count() <= BROADCAST_TAGS else tags
    gone = gone.withColumnRenamed("tag", TAG)
    return docs.join(gone, TAG, "left_anti").drop(TAG)


def vocabulary(name: str) -> str:
    """Place of a file of the public tokenizers installed here; other files are given by their path."""
    import public_tokenizers

    return public_tokenizers.path(name)
