"""Sharding by a fixed number of virtual slots.

Every record hashes into one of some thousand slots, whatever the number of shards. Bytes are added up per slot, and a small
map says which shard holds a slot. The map is a table of versions: one file per version, written once and never changed, so a
reader sees a version whole or not at all. Rebalancing edits the latest version. Going through the slots from the largest
down, a slot stays where it is as long as its shard is within its share of the bytes; the slots left over go, again from the
largest down, to the shard with the least bytes. Growing is the same edit with more shards. Both are folds over one row of
slots, whose number is fixed. All steps are DataFrame functions.

A slot that alone holds a good part of a shard, as when one key has a third of all records, is split in the map into lanes,
which number the physical rows of a slot; all other slots stay whole. Places within a shard are ranks within (slot, lane) plus
offsets from the counts, so no task sorts a shard.

Defined results: a null text has no bytes (size 1); null ids are one key; repeated rows are placed one by one; an empty table
gives an empty result; only the id and the text are read by ``shard``, ``route`` carries all columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palaver.llm.shared import new_path, written

SLOTS, LANES = 4096, 32
#: A slot with more than this part of a shard's share of bytes is split into lanes.
SPLIT = 1 / 8
WHOLE = -1
MAP = "slot int, lane int, shard int, bytes long, version int"
UNIT = "array<struct<bytes:bigint,slot:int,lane:int,shard:int>>"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def sizes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", slots: int = SLOTS, lanes: int = LANES) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``v_slot``, ``v_lane``) of each record, as a written table."""
    data = F.encode(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "UTF-8")
    lane = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int")
    key = F.col(f"`{id_column}`")
    return written(
        docs.select(key, (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), slot_of(key, slots).alias("v_slot"), lane.alias("v_lane")),
        "sizes",
    )


def weights(records: DataFrame) -> DataFrame:
    """Records and bytes per (slot, lane): at most slots x lanes rows."""
    return written(records.groupBy("v_slot", "v_lane").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "weights")


def create(spark: SparkSession, path: str, shards: int, slots: int = SLOTS) -> None:
    """Version 0 of a map: the slots dealt in turn."""
    first = spark.range(slots).select(F.col("id").cast("int").alias("slot"), F.lit(WHOLE).alias("lane"), (F.col("id") % shards).cast("int").alias("shard"), F.lit(0).cast("long").alias("bytes"))
    _store(first, path, 0)


def _store(entries: DataFrame, path: str, version: int) -> None:
    """One file; a version that exists is never overwritten, so of two writers the second fails."""
    entries.coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of a map: (slot, lane, shard, bytes, version); ``bytes`` is what the edit knew of the slot."""
    return spark.read.schema(MAP).option("basePath", path).parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of a map."""
    every = versions(spark, path)
    return every.filter(F.col("version") == every.agg(F.max("version")).first()[0])


def _held(weighed: DataFrame, entries: DataFrame) -> DataFrame:
    """``weighed`` with the shard of each (slot, lane): the lane's own entry, or that of the whole slot."""
    lanes = entries.filter(F.col("lane") != WHOLE).select(F.col("slot").alias("v_slot"), F.col("lane").alias("v_lane"), F.col("shard").alias("_own"))
    whole = entries.filter(F.col("lane") == WHOLE).select(F.col("slot").alias("v_slot"), F.col("shard").alias("_whole"))
    return weighed.join(lanes, ["v_slot", "v_lane"], "left").join(whole, "v_slot", "left").withColumn("shard", F.coalesce("_own", "_whole")).drop("_own", "_whole")


def rebalance(spark: SparkSession, path: str, weighed: DataFrame, shards: int, split: float = SPLIT) -> int:
    """Edit the latest version for these weights and this number of shards; the number of the new version is returned.

    ``shards`` may be more than before: the new ones begin empty and take what the others have above their new share. With
    fewer shards, the slots of those that go are dealt out.
    """
    old = current(spark, path)
    version = old.select("version").first()[0] + 1
    held = _held(weighed, old)
    # one row per slot: its bytes by lane, the whole slot's shard, and whether it was split before
    per_slot = held.groupBy("v_slot").agg(F.sum("bytes").alias("slot_bytes"), F.collect_list(F.struct("bytes", "v_slot", F.col("v_lane").alias("lane"), "shard")).alias("lanes"), F.min("shard").alias("shard"))
    per_slot = per_slot.join(old.filter(F.col("lane") == WHOLE).select(F.col("slot").alias("v_slot"), F.col("shard").alias("home")), "v_slot", "full")
    was_split = old.filter(F.col("lane") != WHOLE).select(F.col("slot").alias("v_slot"), F.lit(True).alias("was")).distinct()
    per_slot = per_slot.join(was_split, "v_slot", "left")
    total = weighed.agg(F.sum("bytes")).first()[0] or 0
    limit, target = total * split / shards, -(-total // shards)
    whole = F.array(F.struct(F.coalesce("slot_bytes", F.lit(0)).cast("long").alias("bytes"), F.col("v_slot").cast("int").alias("slot"), F.lit(WHOLE).alias("lane"), F.coalesce("home", "shard").alias("shard")))
    # a split slot keeps an entry of its own without bytes, for lanes that get their first record later
    parts = F.concat(
        F.expr("transform(lanes, x -> named_struct('bytes', x.bytes, 'slot', x.v_slot, 'lane', x.lane, 'shard', x.shard))"),
        F.array(F.struct(F.lit(0).cast("long").alias("bytes"), F.col("v_slot").cast("int").alias("slot"), F.lit(WHOLE).alias("lane"), F.coalesce("home", "shard").alias("shard"))),
    )
    units = per_slot.select(F.when(F.col("lanes").isNotNull() & ((F.col("slot_bytes") > limit) | F.col("was")), parts).otherwise(whole).alias("units"))
    one = units.agg(F.reverse(F.array_sort(F.flatten(F.collect_list("units")))).cast(UNIT).alias("units"))

    nothing = F.expr(f"cast(array() as {UNIT})")
    loads = F.array_repeat(F.lit(0).cast("long"), shards)

    def more(held: Column, at: Column, size: Column) -> Column:
        return F.transform(held, lambda x, i: F.when(i == at, x + size).otherwise(x))

    def moved(unit: Column, shard: Column) -> Column:
        return F.array(F.struct(unit["bytes"].alias("bytes"), unit["slot"].alias("slot"), unit["lane"].alias("lane"), shard.alias("shard")))

    def stay(state: Column, unit: Column) -> Column:
        fits = (unit["shard"] < shards) & (F.get(state["loads"], unit["shard"]) + unit["bytes"] <= target)
        return F.when(
            F.coalesce(fits, F.lit(False)),
            F.struct(more(state["loads"], unit["shard"], unit["bytes"]).alias("loads"), F.concat(state["kept"], F.array(unit)).alias("kept"), state["left"].alias("left")),
        ).otherwise(F.struct(state["loads"].alias("loads"), state["kept"].alias("kept"), F.concat(state["left"], F.array(unit)).alias("left")))

    def place(state: Column, unit: Column) -> Column:
        at = (F.array_position(state["loads"], F.array_min(state["loads"])) - 1).cast("int")
        return F.struct(more(state["loads"], at, unit["bytes"]).alias("loads"), F.concat(state["kept"], moved(unit, at)).alias("kept"))

    def place_left(state: Column) -> Column:
        return F.aggregate(state["left"], F.struct(state["loads"].alias("loads"), state["kept"].alias("kept")), place, lambda s: s["kept"])

    done = one.select(F.aggregate("units", F.struct(loads.alias("loads"), nothing.alias("kept"), nothing.alias("left")), stay, place_left).alias("entries"))
    _store(done.select(F.inline("entries")).select("slot", "lane", "shard", "bytes"), path, version)
    return version


def route(docs: DataFrame, entries: DataFrame, id_column: str = "doc_id", slots: int = SLOTS, lanes: int = LANES) -> DataFrame:
    """``docs`` with ``shard`` by a version of a map, for writing shards; the map has at most some thousand rows."""
    own = docs.withColumn("_slot", slot_of(F.col(f"`{id_column}`"), slots)).withColumn("_lane", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(lanes)).cast("int"))
    whole = entries.filter(F.col("lane") == WHOLE).select(F.col("slot").alias("_slot"), F.col("shard").alias("_whole"))
    split = entries.filter(F.col("lane") != WHOLE).select(F.col("slot").alias("_slot"), F.col("lane").alias("_lane"), F.col("shard").alias("_own"))
    joined = own.drop("shard").join(F.broadcast(split), ["_slot", "_lane"], "left").join(F.broadcast(whole), "_slot", "left")
    return joined.withColumn("shard", F.coalesce("_own", "_whole")).drop("_slot", "_lane", "_own", "_whole")


def shard(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shards: int = 16, slots: int = SLOTS, lanes: int = LANES, path: str | None = None) -> DataFrame:
    """(id, ``size``, ``text_crc32``, ``shard``, ``slot``) with near equal bytes per shard; ``slot`` is the place in the shard.

    ``path`` is the map's folder; a map that is there is edited, else one is made.
    """
    spark = docs.sparkSession
    records = sizes(docs, id_column, text, slots, lanes)
    weighed = weights(records)
    if path is None:
        path = new_path(spark, "slot-map")
        create(spark, path, shards, slots)
    rebalance(spark, path, weighed, shards)
    held = _held(weighed, current(spark, path))
    lane_before = F.sum("n").over(Window.partitionBy("shard", "v_slot").orderBy("v_lane")) - F.col("n")
    cells = written(held.withColumn("_lane_at", lane_before), "cells")
    totals = cells.groupBy("shard", "v_slot").agg(F.sum("n").alias("slot_n"))
    slot_before = F.sum("slot_n").over(Window.partitionBy("shard").orderBy("v_slot")) - F.col("slot_n")
    cells = cells.join(totals.withColumn("_slot_at", slot_before), ["shard", "v_slot"])
    cells = cells.select("v_slot", "v_lane", "shard", (F.col("_slot_at") + F.col("_lane_at")).alias("_at"))
    key = F.col(f"`{id_column}`")
    rank = F.row_number().over(Window.partitionBy("v_slot", "v_lane").orderBy(key, "text_crc32", "size"))
    placed = records.withColumn("_rank", rank).join(cells, ["v_slot", "v_lane"])
    return placed.select(key, "size", "text_crc32", "shard", (F.col("_at") + F.col("_rank") - 1).cast("long").alias("slot"))
