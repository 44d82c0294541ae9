"""Sharding over fixed virtual slots with a versioned slot-to-shard map, in DataFrame functions alone.

A record's slot is a hash of its doc_id and text modulo ``SLOTS`` and never changes. Shards own slots; the map from slots to
shards is a small table (``SLOTS`` rows) with a version. Version 1 spreads slots evenly. Rebalancing adds up the bytes
of each slot and edits the map: slots stay where they are while their shard is below its share, the others move to the
least loaded shard, largest first; the edited map is the next version. So sizes become near equal while most slots,
and all their records, stay in place.

Only slot-sized tables are ever ordered or broadcast; a slot holds about one record in ``SLOTS`` whatever the skew of
sources or texts (records without a doc_id have a salt, so equal texts among them don't gather), and numbers within a shard are a slot's running count plus the counts of the shard's earlier slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantspark.llm.store import cut, discard, exists, fresh_path

SLOTS = 4096
SHARDS = 40
OVERHEAD = 16


def size_of(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + OVERHEAD).cast("long")


def slot_of(doc_id: Column, text_crc32: Column, slots: int = SLOTS) -> Column:
    """A record's slot; the text's checksum keeps records apart that share a doc_id, a salt those that have none."""
    salt = F.when(doc_id.isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    return F.pmod(F.xxhash64(doc_id, text_crc32, salt), F.lit(slots)).cast("int")


def first_map(spark: SparkSession, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """Version 1 of the map: equal runs of slots for all shards."""
    return spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard"), F.lit(1).alias("version"))


def rebalanced(slot_map: DataFrame, slot_bytes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The next version of the map, edited for the bytes of each slot (slot, bytes).

    Two folds over the slots, largest first: the first lets a slot stay while its shard is below its share, the
    second gives each of the others to the least loaded shard. The map has a fixed number of rows, so the folds run
    over one array.
    """
    known = slot_map.join(slot_bytes.select("slot", "bytes"), "slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)).cast("long"))
    entry = F.struct((-F.col("bytes")).alias("order"), "slot", F.col("shard").alias("old"))
    listed = known.agg(F.array_sort(F.collect_list(entry)).alias("slots"), (F.sum("bytes") / shards).alias("share"), F.max("version").alias("version"))
    empty = F.array_repeat(F.lit(0).cast("long"), shards)

    def add(loads: Column, shard: Column, n: Column) -> Column:
        return F.transform(loads, lambda x, i: F.when(i == shard, x + n).otherwise(x))

    def stay(state: Column, s: Column) -> Column:
        fits = F.get(state["loads"], s["old"]) - s["order"] <= F.col("share")
        return F.struct(
            F.when(fits, add(state["loads"], s["old"], -s["order"])).otherwise(state["loads"]).alias("loads"),
            F.when(fits, state["left"]).otherwise(F.concat(state["left"], F.array(s))).alias("left"),
        )

    def move(state: Column, s: Column) -> Column:
        target = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        moved = F.struct(s["slot"].alias("slot"), target.alias("shard"))
        return F.struct(add(state["loads"], target, -s["order"]).alias("loads"), F.concat(state["moved"], F.array(moved)).alias("moved"))

    none = F.filter("slots", lambda s: F.lit(False))
    kept = F.aggregate("slots", F.struct(empty.alias("loads"), none.alias("left")), stay)
    listed = listed.withColumn("kept", kept)
    no_moves = F.transform(none, lambda s: F.struct(s["slot"].alias("slot"), s["old"].alias("shard")))
    listed = listed.withColumn("moved", F.aggregate("kept.left", F.struct(F.col("kept.loads").alias("loads"), no_moves.alias("moved")), move)["moved"])
    moves = listed.select("version", F.explode("moved").alias("m")).select(F.col("m.slot").alias("slot"), F.col("m.shard").alias("new"))
    edited = slot_map.join(F.broadcast(moves), "slot", "left")
    return edited.select("slot", F.coalesce("new", "shard").cast("int").alias("shard"), (F.col("version") + 1).alias("version"))


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the map table at ``path``."""
    slot_map.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map table, or the latest."""
    table = spark.read.schema("slot int, shard int, version int").parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    return table.where(F.col("version") == version)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """For each document doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot and map_version.

    ``slot`` numbers the documents of a shard from 0 without gaps. The law is ``bytes``: sizes of shards are near
    equal, as far as single slots allow. Needs doc_id and text; other columns are ignored. Null text has no bytes; rows that
    lack or share a doc_id have numbers of their own; an empty table gives an empty result.
    Where ``path`` is given the map lives there: its latest version is what is rebalanced, and the edited one is added
    to it. Otherwise a first map is made, and nothing is left in the shared folder.
    """
    spark = docs.sparkSession
    kept, path = path, path or fresh_path(spark, "slot-map")
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), size_of(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("text_crc32"))
    rows = cut(rows.withColumn("virtual_slot", slot_of(F.col("doc_id"), F.col("text_crc32"), slots)))
    per_slot = cut(rows.groupBy(F.col("virtual_slot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")))
    if not exists(spark, path):
        store_map(first_map(spark, slots, shards), path)
    store_map(rebalanced(load_map(spark, path), per_slot, shards), path)
    current = cut(load_map(spark, path))
    if not kept:
        discard(spark, path)
    before = Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    owners = current.join(per_slot, "slot").withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0)))
    owners = owners.select(F.col("slot").alias("virtual_slot"), "shard", "ahead", F.col("version").alias("map_version"))
    within = Window.partitionBy("virtual_slot").orderBy(F.col("doc_id").asc_nulls_last(), "text_crc32", "size")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1)
    joined = numbered.join(F.broadcast(owners), "virtual_slot")
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + F.col("nth")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")
