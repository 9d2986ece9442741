"""Sharding by fixed virtual slots.

Every record hashes into one of `n_slots` slots, which never change. A small versioned map says which shard holds which
slot; its first version deals slots out evenly, before any record is seen. Bytes are summed per slot (at most n_slots rows,
so that table may go to the driver). Adding shards or evening out sizes edits the map into its next version: whole
slots move, most stay, records are never hashed anew.

Defined results: a null text counts as 0 bytes; a null id hashes by the text alone; repeated rows share a slot;
an empty table gives an empty result; only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyband.llm.common import text_or_empty, work_path

N_SLOTS = 4096
ROW_OVERHEAD = 16
#: What a shard may hold over the mean before slots leave it.
SLACK = 0.0005


@dataclass
class SlotMap:
    """shard_of[slot] for one version."""

    version: int
    shards: int
    shard_of: list[int] = field(default_factory=list)

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map table at path (n_slots rows a version)."""
        rows = [(self.version, self.shards, slot, shard) for slot, shard in enumerate(self.shard_of)]
        frame = spark.createDataFrame(rows, "version int, shards int, virtual_slot int, shard int")
        frame.coalesce(1).write.mode("append").parquet(path)

    @staticmethod
    def frame(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
        """The rows (virtual_slot, shard) of a version, by default the newest."""
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        return stored.filter(F.col("version") == version).select("virtual_slot", "shard")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        stored = spark.read.parquet(path)
        if version is None:
            version = stored.agg(F.max("version")).first()[0]
        rows = stored.filter(F.col("version") == version).orderBy("virtual_slot").collect()
        return cls(version, rows[0]["shards"], [r["shard"] for r in rows])


def hash_into_slots(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot of each record."""
    text = text_or_empty()
    return docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(ROW_OVERHEAD)).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).withColumn(
        "virtual_slot",
        F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_crc32", "size"), F.lit(n_slots)))
        .otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(n_slots)))
        .cast("int"),
    )


def slot_totals(slotted: DataFrame) -> DataFrame:
    """Rows and bytes of each slot in use."""
    return slotted.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Slots in turn: what is known before any record is."""
    return SlotMap(1, shards, [slot % shards for slot in range(n_slots)])


def rebalanced(old: SlotMap, n_bytes: dict[int, int], shards: int, slack: float = SLACK) -> SlotMap:
    """The next version: slots leave shards that are gone or would hold over (1 + slack) of the mean, small ones first; others stay."""
    mean = sum(n_bytes.values()) / shards
    held = [0] * shards
    stay: list[int | None] = [None] * len(old.shard_of)
    order = sorted(range(len(stay)), key=lambda s: (-n_bytes.get(s, 0), s))
    for slot in order:
        shard, size = old.shard_of[slot], n_bytes.get(slot, 0)
        if shard < shards and (held[shard] + size <= mean * (1 + slack) or not size):
            stay[slot] = shard
            held[shard] += size
    heap = [(size, shard) for shard, size in enumerate(held)]
    heapq.heapify(heap)
    for slot in (s for s in order if stay[s] is None):
        size, shard = heapq.heappop(heap)
        stay[slot] = shard
        heapq.heappush(heap, (size + n_bytes.get(slot, 0), shard))
    return SlotMap(old.version + 1, shards, stay)


def place(slotted: DataFrame, slot_map: DataFrame, totals: DataFrame) -> DataFrame:
    """Shard of each record and its gapless position there.

    slot_map and totals have at most n_slots rows. A record's position is that in its own slot plus the rows of the
    shard's earlier slots, so the sort runs in thousands of groups, not one a shard.
    """
    per_slot = (
        slot_map.join(totals, "virtual_slot", "left")
        .withColumn(
            "before",
            F.coalesce(
                F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("virtual_slot", "shard", "before")
    )
    inside = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return (
        slotted.withColumn("inside", inside)
        .join(F.broadcast(per_slot), "virtual_slot")
        .withColumn("slot", F.col("before") + F.col("inside") - 1)
        .drop("before", "inside")
    )


def shard_documents(docs: DataFrame, shards: int = 40, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version of each document.

    Sizes of the shards are near equal (law `bytes`). The map is stored as a table at map_path: the newest version there, or the
    first one if there is none, is edited into the next.
    """
    spark = docs.sparkSession
    slotted = hash_into_slots(docs, n_slots)
    totals = slot_totals(slotted).collect()  # at most n_slots rows
    if map_path is None:
        map_path = work_path(spark, "slot-map")
        first_map(shards, n_slots).save(spark, map_path)
    made = rebalanced(SlotMap.load(spark, map_path), {r["virtual_slot"]: r["n_bytes"] for r in totals}, shards)
    made.save(spark, map_path)
    counted = spark.createDataFrame([(r["virtual_slot"], r["n_rows"]) for r in totals], "virtual_slot int, n_rows long")
    placed = place(slotted, SlotMap.frame(spark, map_path, made.version), counted)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        F.lit(made.version).alias("map_version"),
    )
