"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots (thousands), which never changes. Bytes are aggregated per slot, so what
decides about shards is a table of bounded size. The map from slots to shards is versioned: version 1 deals slots out
evenly, rebalancing edits it (slots move from the fullest to the emptiest shard while that evens them out), growing
moves slots into the new shard only. Every version is stored with its number; a record's shard under any version is a
lookup of its slot.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.plans.materialize import materialize, new_path

SLOTS = 8_192


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


class SlotMap:
    """Versions of a slot-to-shard map as Parquet files in a folder, one for each version."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def store(self, version: int, shard: list[int]) -> None:
        """Write a version; a version that exists is never written over."""
        rows = [(version, k, int(s)) for k, s in enumerate(shard)]
        self.spark.createDataFrame(rows, "version int, slot int, shard int").coalesce(1).write.parquet(f"{self.folder}/version={version}")

    def load(self, version: int) -> DataFrame:
        return self.spark.read.schema("version int, slot int, shard int").parquet(f"{self.folder}/version={version}")


def even(slots: int, shards: int) -> list[int]:
    return [k % shards for k in range(slots)]


def rebalance(shard: list[int], size: list[int], shards: int) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard, each time the slot that brings the two closest,
    until no move helps. The map is of bounded size, so this runs on the driver."""
    at, size = np.array(shard), np.array(size, np.int64)
    load = np.array([size[at == s].sum() for s in range(shards)])
    for _ in range(8 * len(at)):
        full, thin = int(load.argmax()), int(load.argmin())
        gap = load[full] - load[thin]
        own = np.flatnonzero((at == full) & (size > 0) & (size < gap))
        if not len(own):
            break
        k = own[np.abs(2 * size[own] - gap).argmin()]
        at[k] = thin
        load[full] -= size[k]
        load[thin] += size[k]
    return at.tolist()


def grow(shard: list[int], size: list[int], shards: int) -> list[int]:
    """The map with one shard more: slots move into the new shard alone, from the fullest shard each time, while the new
    one stays below an even share."""
    at, size = np.array(shard), np.array(size, np.int64)
    load = np.array([size[at == s].sum() for s in range(shards)] + [0])
    share = load.sum() / (shards + 1)
    for _ in range(len(at)):
        full = int(load[:shards].argmax())
        own = np.flatnonzero((at == full) & (size > 0) & (load[shards] + size <= share))
        if not len(own):
            break
        k = own[size[own].argmax()]
        at[k] = shards
        load[full] -= size[k]
        load[shards] += size[k]
    return at.tolist()


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """(key, size, text_crc32, shard, position, virtual_slot, map_version) for each record.

    Size is the UTF-8 bytes of the text (none for null) plus 1. The slot is a hash of key and text checksum, so null keys
    spread too. Version 1 of the map is even, version 2 is rebalanced by the slots' bytes; both are stored in ``folder``
    (a new one in the shared folder unless given). Position numbers a shard's records from 0 without gaps: a slot's
    records follow those of the shard's lower slots, ordered within the slot by key, checksum and size. Rows that agree
    in all three are interchangeable. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    rows = docs.select(F.col(key).alias("k"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    rows = materialize(rows.withColumn("virtual_slot", slot_of(F.col("k"), F.col("crc"), slots=slots)), "slotted")
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():  # at most a row a slot
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["b"], r["n"]
    maps = SlotMap(spark, folder or new_path(spark, "slot-map"))
    first = even(slots, shards)
    second = rebalance(first, size, shards)
    maps.store(1, first)
    maps.store(2, second)
    before, start = [0] * shards, []
    for k in range(slots):
        start.append((k, second[k], before[second[k]]))
        before[second[k]] += count[k]
    starts = spark.createDataFrame(start, "virtual_slot int, shard int, start long")
    current = maps.load(2).select(F.col("slot").alias("virtual_slot"), F.col("version").alias("map_version"))
    within = F.row_number().over(W.partitionBy("virtual_slot").orderBy("k", "crc", "size")) - 1
    placed = rows.withColumn("within", within).join(F.broadcast(starts.join(current, "virtual_slot")), "virtual_slot")
    return placed.select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("within")).alias("position"), "virtual_slot", "map_version")
