"""Sharding by fixed virtual slots.

Each record is hashed into one of a fixed number of virtual slots; bytes and rows are aggregated per
slot (a bounded table, whatever the data's size), and a versioned slot-to-shard map, a small table
of its own, says where each slot lives. Version 0 spreads the slots evenly without looking at the
data; `rebalance` edits a map so that the bytes per shard become near equal, moving as few slots as
it can, and each edit is stored as the next version.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfspark import workspace

N_SLOTS = 8192


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shards[slot] is the slot's shard."""

    version: int
    n_shards: int
    shards: tuple[int, ...]


def slot_of(key: Column, n_slots: int = N_SLOTS) -> Column:
    """The virtual slot of a record; a null key has a slot of its own choosing by the hash of null."""
    return F.pmod(F.xxhash64(key), F.lit(n_slots)).cast("int")


def initial_map(n_shards: int, n_slots: int = N_SLOTS) -> SlotMap:
    """Version 0: slots dealt in turn."""
    return SlotMap(0, n_shards, tuple(s % n_shards for s in range(n_slots)))


def rebalance(slots: SlotMap, bytes_per_slot: dict[int, int], n_shards: int | None = None, tolerance: float = 0.001) -> SlotMap:
    """The next version, with near equal bytes per shard.

    Slots leave shards that hold more than their share, largest first among those that fit the
    excess, and go to the lightest shard. New shards (a larger n_shards) begin empty and are filled
    by the same moves; slots of shards that no longer exist are all moved.
    """
    n = n_shards or slots.n_shards
    shards = list(slots.shards)
    size = [bytes_per_slot.get(s, 0) for s in range(len(shards))]
    load, members = [0] * n, [[] for _ in range(n)]
    homeless = []
    for s, shard in enumerate(shards):
        if shard < n:
            load[shard] += size[s]
            members[shard].append(s)
        else:
            homeless.append(s)
    target = sum(size) / n
    for shard in range(n):
        excess = load[shard] - target
        for s in sorted(members[shard], key=lambda s: (-size[s], s)):
            if 0 < size[s] <= excess:
                homeless.append(s)
                load[shard] -= size[s]
                excess -= size[s]
    heap = [(load[i], i) for i in range(n)]
    heapq.heapify(heap)
    for s in sorted(homeless, key=lambda s: (-size[s], s)):
        light, i = heapq.heappop(heap)
        shards[s] = i
        heapq.heappush(heap, (light + size[s], i))
    # What is left is a difference of about one small slot: shift or swap single slots while that helps.
    load, members = [0] * n, [set() for _ in range(n)]
    for s, shard in enumerate(shards):
        load[shard] += size[s]
        members[shard].add(s)
    for _ in range(64 * n):
        high, low = max(range(n), key=lambda i: (load[i], -i)), min(range(n), key=lambda i: (load[i], i))
        gap = load[high] - load[low]
        if gap <= tolerance * target:
            break
        best = _best_move(members[high], members[low], size, gap)
        if best is None:
            break
        out, back = best
        for s, a, b in ((out, high, low), (back, low, high)):
            if s is not None:
                members[a].remove(s)
                members[b].add(s)
                shards[s] = b
                load[a] -= size[s]
                load[b] += size[s]
    return SlotMap(slots.version + 1, n, tuple(shards))


def _best_move(high: set[int], low: set[int], size: list[int], gap: int) -> tuple[int, int | None] | None:
    """The slot to move from the heavier shard, and one to take back or None, that best halves the gap."""
    ours = sorted((size[s], s) for s in high if size[s])
    theirs = [(0, None), *sorted((size[s], s) for s in low if size[s])]
    best, found, j = gap, None, 0
    for a, s in ours:
        while j + 1 < len(theirs) and a - theirs[j + 1][0] >= gap / 2:
            j += 1
        for k in (j, j + 1):
            if k < len(theirs) and a > theirs[k][0] and (left := abs(gap - 2 * (a - theirs[k][0]))) < best:
                best, found = left, (s, theirs[k][1])
    return found


def store_map(spark: SparkSession, folder: str, slots: SlotMap) -> DataFrame:
    """Append a version to the map table of a folder; earlier versions stay readable."""
    rows = [(slots.version, slots.n_shards, s, shard) for s, shard in enumerate(slots.shards)]
    df = spark.createDataFrame(rows, "version int, n_shards int, virtual_slot int, shard int").coalesce(1)
    df.write.mode("overwrite").parquet(f"{folder}/version={slots.version}/")
    return df


def load_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    """A stored version: n_shards, virtual_slot, shard."""
    return spark.read.schema("version int, n_shards int, virtual_slot int, shard int").parquet(f"{folder}/version={version}/")


def shard_records(records: DataFrame, key: str, size: str, n_shards: int, n_slots: int = N_SLOTS, folder: str | None = None) -> DataFrame:
    """Put every row into a shard. Adds virtual_slot, shard and slot (the row's place in its shard).

    key: the column that is hashed; it should tell rows apart, as rows of one key stay together.
    size: the column with a row's bytes. Law `bytes`: sizes per shard are near equal.
    slot is gapless from 0 in each shard: the rows of the virtual slots before it in the shard plus
    the row's rank in its own virtual slot, so that no task sorts a whole shard.
    Null keys share one virtual slot. Repeated rows are kept and get places of their own. An empty
    table gives no rows. Columns of the input keep their names and must not be called like the new ones.
    """
    spark = records.sparkSession
    folder = folder or workspace.new_path(spark, "slot_map")
    slotted = records.withColumn("virtual_slot", slot_of(F.col(key), n_slots))
    stats = slotted.groupBy("virtual_slot").agg(F.sum(size).alias("b"), F.count(F.lit(1)).alias("n")).collect()  # n_slots rows at most
    first = initial_map(n_shards, n_slots)
    store_map(spark, folder, first)
    slots = rebalance(first, {r["virtual_slot"]: r["b"] or 0 for r in stats})
    store_map(spark, folder, slots)
    rows, before = {r["virtual_slot"]: r["n"] for r in stats}, [0] * n_shards
    places = []
    for s, shard in enumerate(slots.shards):
        places.append((s, shard, before[shard]))
        before[shard] += rows.get(s, 0)
    where = spark.createDataFrame(places, "virtual_slot int, shard int, __before long")
    rank = F.row_number().over(W.partitionBy("virtual_slot").orderBy(F.col(key), F.xxhash64(*records.columns)))  # rows alike in all may change places
    return (
        slotted.withColumn("__rank", rank.cast("long"))
        .join(F.broadcast(where), "virtual_slot")  # n_slots rows, a fixed number
        .withColumn("slot", F.col("__before") + F.col("__rank") - 1)
        .drop("__before", "__rank")
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 under the law `bytes`; see shard_records."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    digest = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    # Written once: both the bytes per slot and the rows themselves come from it, and the texts are read once.
    digest = workspace.materialize(digest, "op2")
    placed = shard_records(digest, "doc_id", "size", 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("virtual_slot").cast("long").alias("virtual_slot"))
