"""Sharding by fixed virtual slots.

Records hash into ``SLOTS`` slots for good. Bytes are aggregated per slot (a table of
bounded size), and a versioned map sends slots to shards. Rebalancing edits the map and
leaves the slots of records alone, so only the slots named in an edit move.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ._shared import scratch, settled, stage

SLOTS = 8192
SHARDS = 24


@dataclass
class SlotMap:
    """Slot ``s`` belongs to shard ``shard[s]``; every edit makes a new version and lists its moves."""

    shard: list[int]
    shards: int
    version: int = 1
    moved: list[tuple[int, int, int]] = field(default_factory=list)

    @staticmethod
    def balanced(size: list[int], shards: int) -> SlotMap:
        """Largest slot first to the least loaded shard."""
        load = [(0, k) for k in range(shards)]
        shard = [0] * len(size)
        for slot in sorted(range(len(size)), key=lambda s: (-size[s], s)):
            held, k = heapq.heappop(load)
            shard[slot] = k
            heapq.heappush(load, (held + size[slot], k))
        return SlotMap(shard, shards)

    def rebalanced(self, size: list[int], shards: int | None = None, within: float = 0.002) -> SlotMap:
        """A next version for new slot sizes or a new number of shards, moving slots only off shards above the mean."""
        count = shards or self.shards
        shard, moved = list(self.shard), []
        load, held = [0] * count, [[] for _ in range(count)]
        spare = []
        for slot, k in enumerate(shard):
            if k < count:
                load[k] += size[slot]
                held[k].append(slot)
            else:
                spare.append(slot)
        mean = sum(size) / count
        for k in range(count):
            over = load[k] - mean * (1 + within)
            for slot in sorted(held[k], key=lambda s: (-size[s], s)):
                if 0 < size[slot] <= over + mean * within:
                    over -= size[slot]
                    load[k] -= size[slot]
                    spare.append(slot)
                if over <= 0:
                    break
        least = [(load[k], k) for k in range(count)]
        heapq.heapify(least)
        for slot in sorted(spare, key=lambda s: (-size[s], s)):
            total, k = heapq.heappop(least)
            if shard[slot] != k:
                moved.append((slot, shard[slot], k))
                shard[slot] = k
            heapq.heappush(least, (total + size[slot], k))
        return SlotMap(shard, count, self.version + 1, moved)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.shards, s, k) for s, k in enumerate(self.shard)], "version int, shards int, virtual_slot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet folder per version; an older version is never overwritten."""
        self.frame(spark).coalesce(1).write.parquet(f"{path}/version={self.version}")

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        """Versions that are stored under ``path``, oldest first."""
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path}/version={version}").orderBy("virtual_slot").collect()
        return SlotMap([r["shard"] for r in rows], rows[0]["shards"], version)


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32 and virtual slot of every row; texts are read once.

    A null text has no bytes. The slot is of the id; without one, of the text's checksum.
    """
    value = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(value) + 8).cast("long").alias("size"), F.crc32(F.encode(value, "UTF-8")).alias("text_crc32"))
    return narrow.withColumn("virtual_slot", F.pmod(F.xxhash64(F.coalesce("doc_id", "text_crc32")), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: at most ``slots`` rows reach the driver."""
    size, count = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():
        size[r["virtual_slot"]], count[r["virtual_slot"]] = r["size"], r["n"]
    return size, count


def assign(rows: DataFrame, mapping: SlotMap, count: list[int], path: str) -> DataFrame:
    """Adds shard, by the map stored under ``path``, and slot, the row's place in its shard, gapless from 0.

    Places are the rows of the shard's earlier virtual slots and the rank in the own one,
    so no window holds more than a virtual slot.
    """
    spark, base, filled = rows.sparkSession, [0] * len(count), [0] * mapping.shards
    for s, k in enumerate(mapping.shard):
        base[s], filled[k] = filled[k], filled[k] + count[s]
    stored = spark.read.parquet(f"{path}/version={mapping.version}").select("virtual_slot", "shard")
    begins = spark.createDataFrame(list(enumerate(base)), "virtual_slot int, base long")
    table = stored.join(F.broadcast(begins), "virtual_slot")  # a row for each of a fixed number of slots
    rank = F.row_number().over(W.Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    return rows.withColumn("rank", rank).join(F.broadcast(table), "virtual_slot").withColumn("slot", F.col("base") + F.col("rank") - 1).drop("base", "rank")


@settled
def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """One row per row of ``docs`` under the law ``bytes``: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The slot map is stored under ``map_path`` (a scratch folder by default), a version in a
    folder. Where versions are there already, the latest is edited for the sizes and shards
    of now, the edit is stored as the next version, and only slots named in it move; where
    nothing has to move, it stays. A null text has no bytes; very long texts count whole.
    Repeated rows and ids each get a place of their own, null ids as well. An empty table gives
    no rows. Other columns of ``docs`` are not read.
    """
    spark = docs.sparkSession
    rows = stage(slotted(docs, slots), "slotted")
    size, count = slot_sizes(rows, slots)
    path = map_path or scratch(spark, "slot-map")
    if versions := SlotMap.versions(spark, path):
        mapping = SlotMap.load(spark, path, versions[-1])
        if len(mapping.shard) != slots:
            raise ValueError(f"the stored map has {len(mapping.shard)} slots; slots are fixed for good")
        edited = mapping.rebalanced(size, shards)
        if edited.moved or edited.shards != mapping.shards:
            mapping = edited
            mapping.save(spark, path)
    else:
        mapping = SlotMap.balanced(size, shards)
        mapping.save(spark, path)
    return assign(rows, mapping, count, path).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(mapping.version).alias("map_version")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE: dict[str, str] = {}
QUERIES = {"op8_sharding": op8_sharding}
