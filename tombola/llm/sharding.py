"""Sharding through fixed virtual slots.

Every record hashes into one of SLOTS virtual slots, a number that never
changes. A versioned map says which shard holds each slot. It is stored with
every version; rebalancing edits it (a new version), and records never hash
anew, so only the rows of edited slots move.

A record hashes by key, size and checksum of its text, and equal ones by their
number among their like too, so neither a repeated or null key nor a group of
copies fills one slot. A slot can only be as small as its largest record.

Nulls: a null key hashes like any other value, a null text has no bytes. Repeated
rows are records of their own and tie in every order, so it doesn't matter
which of them has which place. A very long text is one record. Only key and text
are read, so other columns may have any name. An empty table gives an empty
result under the even map.
"""

from __future__ import annotations

import heapq
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import copies, cut, shared_folder

#: Virtual slots. The map has as many entries, whatever the data, so it may be
#: collected and broadcast.
SLOTS = 4096


@dataclass(frozen=True)
class SlotMap:
    """shard_of[slot] is the slot's shard; a new version for every edit."""

    version: int
    shards: int
    shard_of: tuple[int, ...]

    def moved(self, old: SlotMap) -> list[int]:
        return [s for s, (a, b) in enumerate(zip(old.shard_of, self.shard_of, strict=True)) if a != b]


def even_map(shards: int, slots: int = SLOTS) -> SlotMap:
    """Version 0: runs of slots of equal length, knowing no data."""
    return SlotMap(0, shards, tuple(s * shards // slots for s in range(slots)))


def rebalance(old: SlotMap, load: dict[int, int], shards: int | None = None) -> SlotMap:
    """The next version of `old` over `shards` shards, in which the loads are
    near equal. Slots leave overfull shards only, largest first, so that most
    stay; then single slots move or swap between the fullest and the emptiest
    shard as long as that narrows the gap."""
    shards = shards or old.shards
    held: list[set[int]] = [set() for _ in range(shards)]
    total = [0] * shards
    loose = []
    for slot, shard in enumerate(old.shard_of):
        if shard < shards:
            held[shard].add(slot)
            total[shard] += load.get(slot, 0)
        else:
            loose.append(slot)
    goal = (sum(total) + sum(load.get(s, 0) for s in loose)) / shards
    for shard in range(shards):
        for slot in sorted(held[shard], key=lambda s: (-load.get(s, 0), s)):
            if total[shard] - goal > 0 and load.get(slot, 0) and total[shard] - load[slot] >= goal - load[slot] / 2:
                held[shard].remove(slot)
                total[shard] -= load[slot]
                loose.append(slot)
    queue = [(total[k], k) for k in range(shards)]
    heapq.heapify(queue)
    for slot in sorted(loose, key=lambda s: (-load.get(s, 0), s)):
        _, k = heapq.heappop(queue)
        held[k].add(slot)
        total[k] += load.get(slot, 0)
        heapq.heappush(queue, (total[k], k))
    for _ in range(8 * len(old.shard_of)):
        high, low = max(range(shards), key=lambda k: (total[k], -k)), min(range(shards), key=lambda k: (total[k], k))
        gap = total[high] - total[low]
        change = _narrowing(held[high], held[low], load, gap)
        if change is None:
            break
        give, take = change
        held[high].remove(give)
        held[low].add(give)
        delta = load.get(give, 0)
        if take is not None:
            held[low].remove(take)
            held[high].add(take)
            delta -= load.get(take, 0)
        total[high] -= delta
        total[low] += delta
    shard_of = [0] * len(old.shard_of)
    for k, slots in enumerate(held):
        for slot in slots:
            shard_of[slot] = k
    return SlotMap(old.version + 1, shards, tuple(shard_of))


def _narrowing(high: set[int], low: set[int], load: dict[int, int], gap: int) -> tuple[int, int | None] | None:
    """The slot to give, and the slot to take back if any, whose difference is
    nearest to half of the gap; none if nothing narrows the gap."""
    best, found = gap, None
    back = sorted([(0, -1), *((load.get(s, 0), s) for s in low)])
    give = sorted((load.get(s, 0), s) for s in high)
    k = 0
    for size, slot in give:
        while k + 1 < len(back) and size - back[k + 1][0] >= gap / 2:
            k += 1
        for other, taken in back[k : k + 2]:
            delta = size - other
            if 0 < delta < gap and abs(gap - 2 * delta) < best:
                best, found = abs(gap - 2 * delta), (slot, None if taken < 0 else taken)
    return found


def with_slot(df: DataFrame, keys: list[str], slots: int = SLOTS, into: str = "virtual_slot") -> DataFrame:
    return df.withColumn(into, F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int"))


def slot_load(df: DataFrame, size: str, slot: str = "virtual_slot") -> dict[int, tuple[int, int]]:
    """Bytes and rows of each slot: at most one row a slot reaches the driver."""
    rows = df.groupBy(slot).agg(F.sum(size).alias("load"), F.count("*").alias("rows")).collect()
    return {r[slot]: (r["load"] or 0, r["rows"]) for r in rows}


MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("shards", T.IntegerType()), T.StructField("slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


def map_frame(spark: SparkSession, plan: SlotMap) -> DataFrame:
    return spark.createDataFrame([(plan.version, plan.shards, s, k) for s, k in enumerate(plan.shard_of)], MAP_SCHEMA)


def store_map(spark: SparkSession, plan: SlotMap, path: str) -> None:
    """Adds this version to the stored maps at `path`; older ones stay."""
    map_frame(spark, plan).coalesce(1).write.mode("append").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap | None:
    """The stored map of that version, by default the newest; None where nothing
    is stored yet."""
    try:
        maps = spark.read.schema(MAP_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if version is None:
        version = maps.agg(F.max("version")).head()[0]
    rows = maps.where(F.col("version") == version).orderBy("slot").collect()
    return SlotMap(version, rows[0]["shards"], tuple(r["shard"] for r in rows))


def assign(df: DataFrame, plan: SlotMap, loads: dict[int, tuple[int, int]], order: list[str]) -> DataFrame:
    """Adds `shard` and `slot`, the record's place in its shard, gapless from 0:
    the rows of the shard's lower virtual slots come first. The window runs over
    single virtual slots, so a shard's rows are never together in one task."""
    start, at = {}, [0] * plan.shards
    for slot, shard in enumerate(plan.shard_of):
        start[slot] = at[shard]
        at[shard] += loads.get(slot, (0, 0))[1]
    where = df.sparkSession.createDataFrame([(s, k, start[s]) for s, k in enumerate(plan.shard_of)], "virtual_slot int, shard int, slot_start long")
    place = Window.partitionBy("virtual_slot").orderBy(*order)
    # One row for each of the fixed slots: its size is known without a check.
    return df.withColumn("slot_place", F.row_number().over(place).cast("long")).join(F.broadcast(where), "virtual_slot", "left").withColumn("slot", F.col("slot_start") + F.col("slot_place") - 1).drop("slot_start", "slot_place")


def shard_by_bytes(docs: DataFrame, shards: int, *, maps: str, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each record's key, size (UTF-8 bytes and 1), CRC-32, virtual slot, shard,
    place, and the version of the map. The map is the newest of those stored at
    `maps` (or the even one), edited until the shards' bytes are near equal; the
    edited version is stored beside the others."""
    spark = docs.sparkSession
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    fields = ["key", "size", "text_crc32", "copy"]
    rows = cut(with_slot(copies(rows), fields, slots))
    loads = slot_load(rows, "size")
    old = load_map(spark, maps)
    if old is None:
        old = even_map(shards, slots)
        store_map(spark, old, maps)
    store_map(spark, rebalance(old, {s: b for s, (b, _) in loads.items()}, shards), maps)
    plan = load_map(spark, maps)
    return assign(rows, plan, loads, fields).withColumn("map_version", F.lit(plan.version)).drop("copy").withColumnRenamed("key", key)


def op2(docs: DataFrame, maps: str | None = None) -> DataFrame:
    """All documents in shards 0 to 15 under the law `bytes`. With `maps`, the newest map stored
    there is edited, so that a later run over grown data moves few rows. Without it,
    the map is stored in a folder of the run's own, as a query that reads nothing but its
    tables gives the same rows whenever it runs."""
    placed = shard_by_bytes(docs, 16, maps=maps or f"{shared_folder(docs.sparkSession)}/slot-maps-{uuid.uuid4().hex}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )
