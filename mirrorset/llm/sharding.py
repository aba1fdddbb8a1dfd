"""Shards by fixed virtual slots.

Every record hashes into one of a fixed number of virtual slots, for good. Bytes are
summed per slot, and a slot map says which shard holds a slot. Maps are versioned rows
(version, slot, shard); rebalancing writes a next version in which as few slots as
needed change hands. Sizes and maps are one row a slot, so their size is fixed by
``SLOTS`` and not by the data.

A record's slot hashes doc_id and text. Null ids and texts are values like any other,
a null text has no bytes, an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
SLOT_MAP = "version int, slot int, shard int"


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 8), text_crc32, vslot of each row."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id", text), F.lit(SLOTS)).cast("int").alias("vslot"),
    )


def slot_sizes(rows: DataFrame) -> dict[int, int]:
    """Bytes by slot: at most ``SLOTS`` numbers."""
    return {r["vslot"]: r["bytes"] for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes")).collect()}


def first_map(sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Each slot, largest first, to the shard with the fewest bytes, then slots: without sizes they are dealt out in turn."""
    heap = [(0, 0, s) for s in range(shards)]
    out = {}
    for slot in sorted(range(SLOTS), key=lambda s: (-sizes.get(s, 0), s)):
        held, slots, shard = heapq.heappop(heap)
        out[slot] = shard
        heapq.heappush(heap, (held + sizes.get(slot, 0), slots + 1, shard))
    return out


def rebalanced(slot_map: dict[int, int], sizes: dict[int, int], shards: int) -> dict[int, int]:
    """Edit a map for new sizes or another number of shards.

    Slots of shards that go away move to the emptiest shard. Then the fullest shard gives the emptiest the
    slot that brings both closest to each other, as long as that lessens their difference.
    """
    out = dict(slot_map)
    held = dict.fromkeys(range(shards), 0)
    own: dict[int, set[int]] = {s: set() for s in range(shards)}
    for slot, shard in out.items():
        if shard < shards:
            held[shard] += sizes.get(slot, 0)
            own[shard].add(slot)

    def put(slot: int, shard: int) -> None:
        out[slot] = shard
        own[shard].add(slot)
        held[shard] += sizes.get(slot, 0)

    for slot in sorted((s for s, shard in slot_map.items() if shard >= shards), key=lambda s: (-sizes.get(s, 0), s)):
        put(slot, min(held, key=lambda s: (held[s], s)))
    while True:
        full, empty = max(held, key=lambda s: (held[s], -s)), min(held, key=lambda s: (held[s], s))
        gap = held[full] - held[empty]
        fits = [s for s in own[full] if 0 < sizes.get(s, 0) < gap]
        if not fits:
            return out
        slot = min(fits, key=lambda s: (abs(2 * sizes[s] - gap), s))
        own[full].discard(slot)
        held[full] -= sizes[slot]
        put(slot, empty)


def write_map(spark: SparkSession, path: str, version: int, slot_map: dict[int, int]) -> None:
    """Append a version of the map."""
    spark.createDataFrame([(version, *x) for x in sorted(slot_map.items())], SLOT_MAP).coalesce(1).write.mode("append").parquet(path)


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, the newest by default: one row a slot."""
    maps = spark.read.schema(SLOT_MAP).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == F.lit(version)).select("slot", "shard")


def placed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """shard of each row and its place there: gapless from 0, by virtual slot, then doc_id.

    Rows are numbered inside their virtual slot; only slot counts meet in one task.
    """
    counts = rows.groupBy("vslot").agg(F.count(F.lit(1)).alias("n"))
    held = counts.join(F.broadcast(slot_map), counts["vslot"] == slot_map["slot"]).select("vslot", "n", "shard")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(starts), "vslot").withColumn("place", (F.col("first") + F.col("inside")).cast("long"))
