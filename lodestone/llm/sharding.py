"""Sharding by fixed virtual slots.

A record's key is hashed to one of SLOTS virtual slots; that never changes. A slot map,
kept in versions, says which shard holds which slot. Bytes are summed a slot, and growing or
rebalancing edits the map, so that only the rows of the moved slots move:

* `grown` adds a shard and gives it its share of slots, a fixed choice by slot numbers, so
  that key and number of shards alone decide where a row is;
* `rebalanced` moves slots from heavy shards to light ones by their bytes.

Only slots (thousands, whatever the corpus) reach the driver.

Sums of slots are stored beside the maps, and places are numbered from them.

Defined results: null keys count as empty text and so share one slot, null texts as no bytes; repeated rows are
kept each and get places of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 8192
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """version; shards; the shard of each slot."""

    version: int
    shards: int
    owner: tuple[int, ...]

    @classmethod
    def initial(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(1, shards, tuple(s % shards for s in range(slots)))

    def grown(self) -> SlotMap:
        """With one more shard, which takes every (shards + 1)-th of each shard's slots, and only those move."""
        seen = [0] * self.shards
        owner = list(self.owner)
        for slot, shard in enumerate(self.owner):
            seen[shard] += 1
            if (seen[shard] + shard) % (self.shards + 1) == 0:
                owner[slot] = self.shards
        return SlotMap(self.version + 1, self.shards + 1, tuple(owner))

    def rebalanced(self, weight: dict[int, int], tolerance: float = 0.01) -> SlotMap:
        """Moves slots from the heaviest shard to the lightest while that evens out weights beyond tolerance of the mean."""
        owner, load = list(self.owner), [0] * self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, shard in enumerate(owner):
            load[shard] += weight.get(slot, 0)
            held[shard].append((weight.get(slot, 0), slot))
        mean = sum(load) / self.shards
        for _ in range(len(owner)):
            heavy, light = max(range(self.shards), key=load.__getitem__), min(range(self.shards), key=load.__getitem__)
            gap = load[heavy] - load[light]
            fits = [x for x in held[heavy] if 0 < x[0] < gap]
            if gap <= tolerance * mean or not fits:
                break
            x = min(fits, key=lambda x: (abs(2 * x[0] - gap), x[1]))
            held[heavy].remove(x)
            held[light].append(x)
            owner[x[1]] = light
            load[heavy] -= x[0]
            load[light] += x[0]
        return SlotMap(self.version + 1, self.shards, tuple(owner))

    def moved(self, other: SlotMap) -> list[int]:
        return [s for s, (a, b) in enumerate(zip(self.owner, other.owner)) if a != b]

    def save(self, spark: SparkSession, folder: str) -> None:
        """A version is a folder of its own that is never written again."""
        self.table(spark).write.parquet(f"{folder}/version={self.version:06d}")

    @classmethod
    def load(cls, spark: SparkSession, folder: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{folder}/version={version:06d}").orderBy("virtual_slot").collect()
        return cls(version, rows[0].shards, tuple(r.shard for r in rows))

    def table(self, spark: SparkSession) -> DataFrame:
        """(virtual_slot, shard, shards); one row a slot."""
        text = json.dumps([{"virtual_slot": s, "shard": x} for s, x in enumerate(self.owner)])
        rows = F.explode(F.from_json(F.lit(text), "array<struct<virtual_slot:int,shard:int>>"))
        return spark.range(1).select(rows.alias("r")).select("r.virtual_slot", "r.shard", F.lit(self.shards).alias("shards"))


def stored(spark: SparkSession, folder: str, *maps: SlotMap) -> list[SlotMap]:
    """The maps as they are read back after each was saved as a version of its own."""
    for m in maps:
        m.save(spark, folder)
    return [SlotMap.load(spark, folder, m.version) for m in maps]


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """From the first 32 bits of the md5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def stored_bytes(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """slot_bytes, written beside the maps and read back."""
    slot_bytes(docs, key, text, slots).coalesce(1).write.parquet(f"{folder}/bytes")
    return docs.sparkSession.read.parquet(f"{folder}/bytes")


def weights(summed: DataFrame) -> dict[int, int]:
    """Bytes of each slot, for SlotMap.rebalanced: a number a slot reaches the driver."""
    return {r.virtual_slot: r.bytes for r in summed.collect()}


def slot_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """virtual_slot, rows, bytes: at most `slots` rows, summed before they are shuffled."""
    return docs.groupBy(virtual_slot(docs[f"`{key}`"], slots).alias("virtual_slot")).agg(F.count("*").alias("rows"), F.sum(size_of(docs[f"`{text}`"])).alias("bytes"))


def place(docs: DataFrame, current: SlotMap, larger: SlotMap, key: str = "doc_id", text: str = "text", summed: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (place in the shard, from 0 without gaps), grown_shard, virtual_slot, virtual_slot_bytes. summed: slot_bytes of docs, if they are there already.

    Places follow (virtual slot, key, crc32, size). Rows equal in all of these are counted
    before the shuffle and spread out again after it; running sums are taken within a virtual
    slot, and a slot's base from the sums of at most SLOTS rows.
    """
    spark, slots = docs.sparkSession, len(current.owner)
    rows = docs.select(
        docs[f"`{key}`"].alias("doc_id"),
        size_of(docs[f"`{text}`"]).alias("size"),
        F.crc32(F.coalesce(docs[f"`{text}`"], F.lit("")).cast("binary")).alias("text_crc32"),
        virtual_slot(docs[f"`{key}`"], slots).alias("virtual_slot"),
    )
    distinct = rows.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    a, b = current.table(spark), larger.table(spark)
    owners = a.join(F.broadcast(b.select("virtual_slot", F.col("shard").alias("grown_shard"))), "virtual_slot").drop("shards")
    counts = slot_bytes(docs, key, text, slots) if summed is None else summed  # a row a slot
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    bases = owners.join(F.broadcast(counts), "virtual_slot").withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    inner = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = distinct.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(F.broadcast(bases.select("virtual_slot", "shard", "grown_shard", "base", F.col("bytes").alias("virtual_slot_bytes"))), "virtual_slot")
    first = F.col("base") + F.col("inner")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("slot"), "grown_shard", "virtual_slot", "virtual_slot_bytes")
