"""Sharding by fixed virtual slots.

Records hash into a fixed number of virtual slots; bytes and rows are summed per slot; a stored map says which shard
holds each slot. The first version deals slots in turn. A run loads the newest version under its path, measures it, and
if a shard stands over the mean, edits the map, moving only slots out of overfull shards, and stores that as the next
version. What reaches the driver has one row per virtual slot, whatever the corpus.

A record that is repeated so often that its slot alone would hold more than a slot's share of all rows is spread over
the slots by row number; there are no more such records than slots.

The law is ``bytes``: the map follows the measured sizes, so shards hold near-equal bytes. ``slot`` is the row's place
in its shard, gapless from 0: the rows of the shard's earlier virtual slots, plus its rank in its own.

Cases: a null text has size 16 and checksum 0; null ids hash like any value; repeated rows share a virtual slot, but for
the above, and get different places; extra columns are ignored; an empty table gives an empty result and leaves the map.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kairolog.llm._tables import Scratch
from kairolog.sources.log import Folder

SHARDS, VIRTUAL_SLOTS, RECORD_OVERHEAD = 40, 4096, 16


def first_map(virtual_slots: int, shards: int) -> list[int]:
    return [v % shards for v in range(virtual_slots)]


def rebalanced(assigned: list[int], bytes_of: dict[int, int], shards: int) -> list[int]:
    """An edit of the map: shards over the mean give up their smallest slots, which go, largest first, to the least filled."""
    target = sum(bytes_of.values()) / shards
    held: dict[int, list[int]] = defaultdict(list)
    for v, shard in enumerate(assigned):
        held[shard].append(v)
    load = {s: sum(bytes_of.get(v, 0) for v in held[s]) for s in range(shards)}
    moving: list[int] = []
    for s in range(shards):
        for v in sorted((v for v in held[s] if bytes_of.get(v)), key=lambda v: (bytes_of[v], v)):
            if load[s] <= target:
                break
            load[s] -= bytes_of[v]
            moving.append(v)
    out, heap = list(assigned), [(load[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for v in sorted(moving, key=lambda v: (-bytes_of[v], v)):
        least, s = heapq.heappop(heap)
        out[v] = s
        heapq.heappush(heap, (least + bytes_of[v], s))
    return out


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """The stored map of a version, the newest by default: its number, and the shard of each virtual slot; (0, []) if there is none."""
    known = [int(n[8:]) for n in Folder(spark, path).names() if n.startswith("version=")]
    if not known:
        return 0, []
    version = version or max(known)
    rows = spark.read.parquet(f"{path}/version={version}").select("virtual_slot", "shard").collect()  # a row per virtual slot
    return version, [s for _, s in sorted((r["virtual_slot"], r["shard"]) for r in rows)]


def store_map(spark: SparkSession, path: str, version: int, assigned: list[int]) -> None:
    table = pa.table({"virtual_slot": pa.array(range(len(assigned)), pa.int32()), "shard": pa.array(assigned, pa.int32())})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/version={version}")  # a version is never written twice


def current_map(spark: SparkSession, path: str, bytes_of: dict[int, int], virtual_slots: int, shards: int) -> tuple[int, list[int]]:
    """The newest map after this measurement; what is new is stored."""
    version, assigned = load_map(spark, path)
    if not version:
        version, assigned = 1, first_map(virtual_slots, shards)
        store_map(spark, path, version, assigned)
    if len(assigned) != virtual_slots or max(assigned) >= shards:
        raise ValueError(f"the map at {path} has {len(assigned)} virtual slots")
    edited = rebalanced(assigned, bytes_of, shards)
    if edited != assigned:
        version += 1
        store_map(spark, path, version, edited)
    return version, edited


def shard_documents(docs: DataFrame, shards: int = SHARDS, virtual_slots: int = VIRTUAL_SLOTS, map_path: str | None = None) -> tuple[DataFrame, str]:
    """The placed rows, and the path of the map, by default one of this run alone."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    map_path = map_path or f"{scratch.path}/map"
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + RECORD_OVERHEAD).alias("size"), crc.alias("text_crc32"), F.monotonically_increasing_id().alias("number"))
    rows = scratch.write(rows, "rows")
    often = rows.groupBy("doc_id", "text_crc32").agg(F.count("*").alias("n")).where(F.col("n") > max(2, -(-rows.count() // virtual_slots)))
    often = often.select(F.xxhash64("doc_id", "text_crc32").alias("often")).distinct()  # as many rows as virtual slots at most
    key = F.xxhash64("doc_id", "text_crc32")
    rows = rows.join(F.broadcast(often), key == F.col("often"), "left")
    spread = F.when(F.col("often").isNotNull(), F.xxhash64("often", "number")).otherwise(key)
    rows = scratch.write(rows.select("doc_id", "size", "text_crc32", F.pmod(spread, F.lit(virtual_slots)).cast("int").alias("virtual_slot")), "slots")
    scratch.drop("rows")
    sums = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()  # a row per virtual slot
    rows_of = {r["virtual_slot"]: r["rows"] for r in sums}
    version, assigned = current_map(spark, map_path, {r["virtual_slot"]: r["bytes"] for r in sums}, virtual_slots, shards)
    before, base = [0] * shards, []
    for v, shard in enumerate(assigned):
        base.append(before[shard])
        before[shard] += rows_of.get(v, 0)
    newest = spark.createDataFrame(pa.table({"virtual_slot": pa.array(range(virtual_slots), pa.int32()), "shard": pa.array(assigned, pa.int32()), "base": pa.array(base, pa.int64())}))
    rank = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size"))
    placed = rows.withColumn("rank", rank).join(F.broadcast(newest), "virtual_slot")
    columns = ["doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version")]
    return placed.select(*columns), map_path
