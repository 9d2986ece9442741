"""Exact duplicates through a log-structured merge index of text digests.

Memtables: each task gathers digests in a bounded table, which shrinks a group of copies to one entry, and flushes it as a run
sorted by digest. A run is cut into segments by ranges of the digest; a segment is a row with its digests in order, their
entries and a Bloom filter. A range's segments meet in one task, which takes them into an index: a segment's filter is asked
first, only digests that it may hold are looked up in its order, and those that it holds are joined with its entries; the
others become a segment of their own. Over FAN segments are compacted into one. Of a digest the extreme id and the row count
are kept. Digests met more than once are hits; their texts are compared byte by byte (grouping by the text itself) before
they count as equal.

Defined results: a null text is the empty text; of rows with the kept id repeated, exactly one is kept; a group whose
ids are all null keeps one row and has keep_id null; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyband.llm.common import drop_rows, mapped, stored_tag, tagged, text_or_empty, work_table
from tallyband.llm.graph import spread_join

MEMTABLE_ROWS = 100_000
#: Rows for each range of digests; a range's distinct digests are held by a task.
RANGE_ROWS = 1_000_000
#: Segments beyond which a range's index is compacted.
FAN = 8
#: Bits of a filter for each digest, and how many of them a digest sets.
FILTER_BITS, FILTER_HASHES = 12, 4
BROADCAST_DIGESTS = 500_000
#: Null ids lose to all others.
NO_ID = -(2**63)


class Filter:
    """A Bloom filter of digests, as bytes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def _places(digests: np.ndarray, size: int) -> np.ndarray:
        width = digests.dtype.itemsize
        raw = np.zeros((len(digests), 16), np.uint8)
        raw[:, : min(16, width)] = np.frombuffer(digests.tobytes(), np.uint8).reshape(-1, width)[:, :16]
        one, two = raw.view(np.uint64).T
        return (one[:, None] + np.arange(FILTER_HASHES, dtype=np.uint64)[None, :] * (two[:, None] | np.uint64(1))) % np.uint64(8 * size)

    @classmethod
    def of(cls, digests: np.ndarray) -> Filter:
        bits = np.zeros(max(8, len(digests) * FILTER_BITS // 8), np.uint8)
        at = cls._places(digests, len(bits)).reshape(-1)
        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        return cls(bits)

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        at = self._places(digests, len(self.bits))
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)


@dataclass
class Segment:
    """Digests in order, without repeats, and for each the best id, its row and the number of rows."""

    digests: np.ndarray
    ids: np.ndarray
    tags: np.ndarray
    counts: np.ndarray
    filter: Filter

    def part(self, own: np.ndarray) -> Segment:
        return Segment(self.digests[own], self.ids[own], self.tags[own], self.counts[own], Filter.of(self.digests[own]))


class Index:
    """Segments without common digests. looked_up: how many digests were searched in a segment's order."""

    def __init__(self):
        self.segments: list[Segment] = []
        self.looked_up = 0

    def add(self, new: Segment) -> None:
        rest = np.arange(len(new.digests))
        for old in self.segments:
            asked = rest[old.filter.may_hold(new.digests[rest])]
            self.looked_up += len(asked)
            at = np.minimum(np.searchsorted(old.digests, new.digests[asked]), len(old.digests) - 1)
            held = old.digests[at] == new.digests[asked]
            at, mine = at[held], asked[held]
            old.counts[at] += new.counts[mine]
            better = (new.ids[mine] > old.ids[at]) | ((new.ids[mine] == old.ids[at]) & (new.tags[mine] < old.tags[at]))
            old.ids[at[better]], old.tags[at[better]] = new.ids[mine[better]], new.tags[mine[better]]
            rest = np.setdiff1d(rest, mine, assume_unique=True)
        if len(rest):
            self.segments.append(new if len(rest) == len(new.digests) else new.part(rest))
        if len(self.segments) > FAN:
            self.compact()

    def compact(self) -> None:
        """One segment of all: sorted runs, so that a stable sort merges them."""
        if len(self.segments) < 2:
            return
        digests, ids, tags, counts = (np.concatenate([getattr(s, c) for s in self.segments]) for c in ("digests", "ids", "tags", "counts"))
        order = np.argsort(digests, kind="stable")
        self.segments = [Segment(digests[order], ids[order], tags[order], counts[order], Filter.of(digests))]


def _digest(width: int) -> Column:
    """The first bytes of text_sha256; for a width of 0 the same byte for all."""
    return F.unhex(F.substring("text_sha256", 1, 2 * width)) if width else F.lit(b"\0")


def digest_rows(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """tag (unique), doc_id, digest, text_sha256 of each row."""
    sha = F.sha2(text_or_empty().cast("binary"), 256)
    return docs.select(stored_tag(docs), F.col("doc_id").cast("long").alias("doc_id"), sha.alias("text_sha256")).withColumn(
        "digest", _digest(digest_bytes)
    )


_SEGMENT = "range int, digests binary, ids binary, tags binary, counts binary, filter binary"


def _memtables(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list[int]] = {}

        def flushed() -> pa.RecordBatch:
            keys = sorted(table)
            digests = np.array(keys, f"S{len(keys[0])}")
            ids, tags, counts = (np.array(c, np.int64) for c in zip(*(table[k] for k in keys), strict=True))
            whole = Segment(digests, ids, tags, counts, Filter(np.empty(0, np.uint8)))
            own = np.array([int.from_bytes(k[:4].ljust(4, b"\0"), "big") * ranges >> 32 for k in keys], np.int32)  # rises with the digest
            used, first = np.unique(own, return_index=True)
            parts = [whole.part(rows) for rows in np.split(np.arange(len(keys)), first[1:])]
            columns = [[getattr(p, c).tobytes() for p in parts] for c in ("digests", "ids", "tags", "counts")]
            filters = [p.filter.bits.tobytes() for p in parts]
            return pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c, pa.binary()) for c in (*columns, filters))], names=[c.split()[0] for c in _SEGMENT.split(", ")])

        for batch in batches:
            for digest, rank, tag in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                entry = table.get(digest)
                if entry is None:
                    table[digest] = [rank, tag, 1]
                    continue
                if (rank, -tag) > (entry[0], -entry[1]):
                    entry[0], entry[1] = rank, tag
                entry[2] += 1
            if len(table) >= MEMTABLE_ROWS:
                yield flushed()
                table.clear()
        if table:
            yield flushed()

    return run


def flush(rows: DataFrame, keep: str = "max", ranges: int = 1) -> DataFrame:
    """The segments of all sorted runs, stored. keep: the id that stays, max or min."""
    rank = F.coalesce(F.col("doc_id") if keep == "max" else -F.col("doc_id"), F.lit(NO_ID))
    return work_table(mapped(rows.select("digest", rank.alias("rank"), "tag"), _memtables(ranges), _SEGMENT), "lsm-segments")


def _indexed(digest_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at = Index(), -1

        def whole() -> Iterator[pa.RecordBatch]:
            index.compact()
            for s in index.segments:
                digests = pa.FixedSizeBinaryArray.from_buffers(pa.binary(digest_bytes), len(s.digests), [None, pa.py_buffer(s.digests.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([digests, pa.array(s.tags), pa.array(s.ids), pa.array(s.counts)], names=["digest", "best_tag", "best_id", "group_size"])

        for batch in batches:
            for k, part in enumerate(batch.column("range").to_pylist()):
                if part != at:
                    yield from whole()
                    index, at = Index(), part
                raw = {c: batch.column(c)[k].as_buffer() for c in ("digests", "ids", "tags", "counts", "filter")}
                entries = [np.frombuffer(raw[c], np.int64).copy() for c in ("ids", "tags", "counts")]
                index.add(Segment(np.frombuffer(raw["digests"], f"S{digest_bytes}"), *entries, Filter(np.frombuffer(raw["filter"], np.uint8))))
        yield from whole()

    return run


def compact(segments: DataFrame, digest_bytes: int, ranges: int) -> DataFrame:
    """digest, best_tag, best_id, group_size: the winning row and the row count of each digest."""
    met = segments.repartition(ranges, "range").sortWithinPartitions("range")
    return mapped(met, _indexed(digest_bytes), "digest binary, best_tag long, best_id long, group_size long")


def _only(docs: DataFrame, digests: DataFrame, broadcast: bool, digest_bytes: int, rows: int) -> DataFrame:
    """doc_id, text, text_sha256 and digest of the rows with one of the digests (each with n, its rows). No task gets all texts of a digest that many rows have."""
    sha = F.sha2(F.col("text").cast("binary"), 256)
    texts = docs.select(stored_tag(docs), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_sha256", sha)
    texts = texts.withColumn("digest", _digest(digest_bytes))
    return texts.join(F.broadcast(digests), "digest", "left_semi") if broadcast else spread_join(texts, digests, "digest", rows)


def marked_rows(docs: DataFrame, keep: str = "max", digest_bytes: int = 32) -> DataFrame:
    """tag, doc_id, keep_id, group_size, kept, text_sha256 of every row of docs. digest_bytes: shorter in tests, to make collisions."""
    rows = work_table(digest_rows(docs, digest_bytes), "lsm-rows")
    many = rows.count()
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-many // RANGE_ROWS))
    index = work_table(compact(flush(rows, keep, ranges), max(1, digest_bytes), ranges), "lsm-compacted", many)

    hits = index.filter(F.col("group_size") > 1).select("digest", F.col("group_size").alias("n"))
    rows_of_hits = hits.count()
    texts = _only(docs, hits, rows_of_hits <= BROADCAST_DIGESTS, digest_bytes, many).groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    clashes = work_table(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest").join(hits, "digest"), "lsm-clashes", rows_of_hits)

    sign = 1 if keep == "max" else -1
    keep_id = F.when(F.col("best_id") != NO_ID, F.col("best_id") * sign)
    result = spread_join(rows, index.withColumn("n", F.col("group_size")), "digest", many).select(
        "tag", "doc_id", keep_id.alias("keep_id"), "group_size", (F.col("tag") == F.col("best_tag")).alias("kept"), "text_sha256", "digest"
    )
    if not clashes.isEmpty():
        # Texts that differ under one digest: their rows are grouped by the text itself.
        apart = _only(docs, clashes, False, digest_bytes, many)
        group = Window.partitionBy("digest", "text")
        first = F.row_number().over(group.orderBy(F.desc_nulls_last("doc_id") if keep == "max" else F.asc_nulls_last("doc_id")))
        apart = apart.select(
            "tag", "doc_id", (F.max if keep == "max" else F.min)("doc_id").over(group).alias("keep_id"), F.count(F.lit(1)).over(group).alias("group_size"), (first == 1).alias("kept"), "text_sha256", "digest"
        )
        result = result.join(clashes.select("digest"), "digest", "left_anti").unionByName(apart)
    return result.drop("digest")


def exact_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of docs."""
    return marked_rows(docs, keep).drop("tag")


def without_duplicates(docs: DataFrame, keep: str = "max") -> DataFrame:
    """The rows of docs that stay when one of each group of equal texts does; all columns as they were."""
    docs = tagged(docs)
    return drop_rows(docs, marked_rows(docs, keep).filter(~F.col("kept")).select("tag"))
