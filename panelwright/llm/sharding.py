"""Sharding by fixed virtual slots.

Records are hashed into thousands of slots, bytes are summed per slot, and a versioned table maps
slots to shards. Rebalancing edits that table: a new version moves few slots and never rehashes a
record. The driver holds one row per slot (``SLOTS`` rows whatever the data size).

Defined cases: a null text has no bytes; a null doc_id is hashed by its text; equal rows are
separate records of one slot; an empty table gives no rows and an unused map; other columns are kept
unless they bear one of the result's names, in which case the result's column stands.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLOTS = 4096
RECORD_OVERHEAD = 16


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32 and virtual_slot of every record."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (text_bytes(F.col("text")) + RECORD_OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), text))), F.lit(slots)).cast("int").alias("virtual_slot"),
    )


def slot_weights(recs: DataFrame) -> dict[int, tuple[int, int]]:
    """Rows and bytes per slot: at most one row per slot reaches the driver."""
    rows = recs.groupBy("virtual_slot").agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()
    return {r["virtual_slot"]: (r["n"], r["b"]) for r in rows}


@dataclass(frozen=True)
class SlotMap:
    """One version of the slot-to-shard table."""

    version: int
    shard: tuple[int, ...]

    def shards(self) -> int:
        return max(self.shard) + 1

    def moved(self, other: SlotMap) -> int:
        return sum(a != b for a, b in zip(self.shard, other.shard, strict=True))


def assign(weights: dict[int, tuple[int, int]], shards: int, slots: int = SLOTS) -> SlotMap:
    """First version: heaviest slot first onto the lightest shard; ties go to the smallest number."""
    loads = [(0, s) for s in range(shards)]
    shard = [0] * slots
    for slot in sorted(range(slots), key=lambda s: (-weights.get(s, (0, 0))[1], s)):
        if weights.get(slot, (0, 0))[1] == 0:
            shard[slot] = slot % shards
            continue
        load, target = heapq.heappop(loads)
        shard[slot] = target
        heapq.heappush(loads, (load + weights[slot][1], target))
    return SlotMap(1, tuple(shard))


def rebalance(old: SlotMap, weights: dict[int, tuple[int, int]], shards: int, tolerance: float = 0.02) -> SlotMap:
    """Next version for new weights or more shards: only slots of overfull shards move.

    A shard above the mean by more than ``tolerance`` gives away the heaviest slots that don't take
    it below, so few slots move; with one more shard they all move into the new one.
    """
    shard, load = list(old.shard), [0] * shards
    own: dict[int, list[int]] = {s: [] for s in range(shards)}
    if max(shard) >= shards:
        raise ValueError("a map can't lose shards; assign a new one")
    for slot, s in enumerate(shard):
        load[s] += weights.get(slot, (0, 0))[1]
        own[s].append(slot)
    mean = sum(load) / shards
    targets = [(load[s], s) for s in range(shards)]
    heapq.heapify(targets)
    for s in sorted(range(shards), key=lambda x: -load[x]):
        for slot in sorted(own[s], key=lambda x: (-weights.get(x, (0, 0))[1], x)):
            w = weights.get(slot, (0, 0))[1]
            if not w or load[s] <= mean * (1 + tolerance):
                break
            if load[s] - w < mean * (1 - tolerance):
                continue
            while targets[0][0] != load[targets[0][1]]:
                heapq.heapreplace(targets, (load[targets[0][1]], targets[0][1]))
            t = targets[0][1]
            if t == s or load[t] + w >= load[s]:
                continue
            shard[slot], load[s], load[t] = t, load[s] - w, load[t] + w
            heapq.heapreplace(targets, (load[t], t))
    return SlotMap(old.version + 1, tuple(shard))


def map_table(spark: SparkSession, versions: Iterable[SlotMap]) -> DataFrame:
    """The table (version, virtual_slot, shard) to be stored beside the data."""
    return spark.createDataFrame(
        [(m.version, slot, s) for m in versions for slot, s in enumerate(m.shard)], "version int, virtual_slot int, shard int"
    )


def load_map(table: DataFrame, version: int | None = None) -> SlotMap:
    """A stored version, the newest by default."""
    version = table.agg(F.max("version")).first()[0] if version is None else version
    rows = table.where(F.col("version") == version).collect()
    return SlotMap(version, tuple(r["shard"] for r in sorted(rows, key=lambda r: r["virtual_slot"])))


def place(recs: DataFrame, slot_map: SlotMap, weights: dict[int, tuple[int, int]]) -> DataFrame:
    """Shard of each record and its gapless place (``slot``) in the shard.

    Places count inside virtual slots, which start where the slots before them in the shard end; so
    no task sorts a whole shard.
    """
    start = [0] * len(slot_map.shard)
    filled: dict[int, int] = {}
    for slot, s in enumerate(slot_map.shard):
        start[slot] = filled.get(s, 0)
        filled[s] = start[slot] + weights.get(slot, (0, 0))[0]
    table = recs.sparkSession.createDataFrame(
        [(slot, s, start[slot], slot_map.version) for slot, s in enumerate(slot_map.shard)],
        "virtual_slot int, shard int, _start long, map_version int",
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    # One row per virtual slot: the hinted side never grows with the data.
    return (
        recs.withColumn("_place", F.row_number().over(inside).cast("long") - 1)
        .join(F.broadcast(table), "virtual_slot")
        .withColumn("slot", F.col("_start") + F.col("_place"))
        .drop("_start", "_place")
    )


def shard_by_bytes(docs: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """All records with their shard; shards hold nearly the same number of bytes."""
    recs = records(docs, slots)
    weights = slot_weights(recs)
    return place(recs, assign(weights, shards, slots), weights)
