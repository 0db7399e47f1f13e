"""Sharding by fixed virtual slots.

Records are hashed into thousands of virtual slots, whose number never changes. A versioned map
says which shard holds each slot. Rebalancing reads the bytes of each slot and edits the map; a
record's slot is never computed anew, so only the edited slots' records move.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import shared_folder, table, text_of, written

SLOTS = 4096
SHARDS = 16
PARTS = 16  # groups into which a slot's rows are dealt
MAP = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])


def size_of(text: str = "text") -> Column:
    return F.octet_length(text_of(text)).cast("long") + 1


def slot_of(*keys: str | Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has rows: at most as many rows as slots."""
    return records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> list[int]:
    """Version 0: slots dealt round."""
    return [slot % shards for slot in range(slots)]


def rebalance(old: Sequence[int], sizes: dict[int, int], shards: int, within: float = 0.0) -> list[int]:
    """The map with slots moved, or exchanged, from the fullest shard to the emptiest.

    It ends when the gap between them is at most `within` times the mean, or when no single move
    or exchange makes it smaller: each edit makes the sum of squared loads smaller, so it ends.
    Shards that the old map lacks start empty; slots of shards that are no more are dealt round.
    Slots without rows stay. Ties: the lower shard, the lower slot.
    """
    new = [shard if shard < shards else slot % shards for slot, shard in enumerate(old)]
    full = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(new):
        if size := sizes.get(slot, 0):
            full[shard] += size
            held[shard].append((size, slot))
    for own in held:
        own.sort()
    mean = sum(full) / shards
    while True:
        high = max(range(shards), key=lambda s: (full[s], -s))
        low = min(range(shards), key=lambda s: (full[s], s))
        gap = full[high] - full[low]
        if gap <= max(1, within * mean):
            break
        best: tuple[float, tuple, tuple | None] | None = None
        for back in [None, *held[low]]:
            want = gap / 2 + (back[0] if back else 0)
            at = bisect_left(held[high], (want, -1))
            for move in held[high][max(0, at - 1) : at + 1]:
                shift = move[0] - (back[0] if back else 0)
                if 0 < shift < gap and (best is None or abs(gap / 2 - shift) < best[0]):
                    best = (abs(gap / 2 - shift), move, back)
        if best is None:
            break
        for item, source, target in ((best[1], high, low), (best[2], low, high)):
            if item:
                held[source].remove(item)
                insort(held[target], item)
                full[source] -= item[0]
                full[target] += item[0]
                new[item[1]] = target
    return new


def write_map(spark: SparkSession, path: str, version: int, mapping: Sequence[int]) -> None:
    """Versions are never changed, only added."""
    rows = spark.createDataFrame([(slot, shard) for slot, shard in enumerate(mapping)], MAP)
    rows.coalesce(1).write.parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(f"{path}/version={version}")


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The highest version of the map at a path; None without a map."""
    try:
        return spark.read.schema("virtual_slot int, shard int, version int").parquet(path).agg(F.max("version")).first()[0]
    except AnalysisException:  # no such path
        return None


def assign(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each record's shard: no shuffle, for the map has one row for each slot."""
    return records.join(F.broadcast(mapping), "virtual_slot")


def shard_table(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard and slot (the row's place in its shard).

    The map at `path` is read, edited, and stored as the next version if the edits changed it;
    where there is none, version 0 deals slots round. `slots` must be that of the stored map.

    Null texts count one byte and have the checksum of the empty text; rows without an id take
    part like others; repeated rows each have their own place, in any order among themselves. An
    empty table gives no rows. Other columns of docs are ignored.

    What goes to the driver: one row for each virtual slot, at most `slots`. Sizes and checksums are
    stored once, with a number from 0 to PARTS - 1 dealt round, so that a slot's rows are counted
    and placed in PARTS groups: equal rows, which share a slot, aren't one task's. No text is
    shuffled.
    """
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    records = docs.select("doc_id", size_of().alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"))
    records = records.withColumn("virtual_slot", slot_of("doc_id", "text_crc32", slots=slots))
    records = written(records.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")))
    counted = {r["virtual_slot"]: (r["bytes"], r["rows"]) for r in slot_bytes(records).collect()}
    version = latest_version(spark, path)
    if version is None:
        version, old = 0, first_map(slots, shards)
        write_map(spark, path, 0, old)
    else:
        old = [r["shard"] for r in read_map(spark, path, version).orderBy("virtual_slot").collect()]
        if len(old) != slots:
            raise ValueError(f"the stored map has {len(old)} slots, not {slots}")
    new = rebalance(old, {slot: size for slot, (size, _) in counted.items()}, shards)
    if new != list(old):
        version += 1
        write_map(spark, path, version, new)
    filled, starts = [0] * shards, []
    for slot, shard in enumerate(new):
        starts.append((slot, filled[shard]))
        filled[shard] += counted.get(slot, (0, 0))[1]
    offsets = spark.createDataFrame(starts, "virtual_slot int, begin long")
    groups = records.groupBy("virtual_slot", "part").agg(F.count(F.lit(1)).alias("n"))  # at most slots * PARTS rows
    before = F.sum("n").over(W.partitionBy("virtual_slot").orderBy("part")) - F.col("n")
    groups = groups.join(F.broadcast(offsets), "virtual_slot").select("virtual_slot", "part", (F.col("begin") + before).alias("start"))
    places = assign(records, read_map(spark, path, version)).join(F.broadcast(groups), ["virtual_slot", "part"])
    order = W.partitionBy("virtual_slot", "part").orderBy("doc_id", "size", "text_crc32")
    return places.withColumn("slot", F.col("start") + F.row_number().over(order) - 1).drop("start", "part")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_table(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
