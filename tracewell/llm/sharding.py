"""Sharding by fixed virtual slots, with DataFrame functions only.

Records hash into a fixed number of virtual slots; bytes are summed per slot;
a small table maps slots to shards.  The table carries a version: rebalancing
edits it, moves few slots and leaves the records' slots as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut, stored

#: Virtual slots.  Their number is fixed, so tables by slot are bounded and may be broadcast.
SLOTS = 8192
#: Bytes that a record costs besides its text.
OVERHEAD = 16


def virtual_slot(key: Column, slots: int = SLOTS) -> Column:
    """The record's slot; depends on its key alone (null is a key of its own)."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.lit("\u0000"))), F.lit(slots)).cast("int")


def slot_bytes(sized: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) for every slot, used or not."""
    used = sized.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    every = sized.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").select("vslot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("n", F.lit(0)).alias("n"))


def _deal(slots: Column, loads: Column) -> Column:
    """Fold over slots in falling order of bytes: each goes to the shard with the least load so far."""
    start = F.struct(loads.cast("array<long>").alias("loads"), F.array().cast("array<int>").alias("to"))

    def step(acc, slot):
        least = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda x, i: F.when(i == least, x + slot["bytes"]).otherwise(x))
        return F.struct(grown.alias("loads"), F.array_append(acc["to"], least).alias("to"))

    return F.aggregate(slots, start, step)["to"]


def assign_slots(load: DataFrame, shards: int) -> DataFrame:
    """Version 1 of the map: (vslot, shard, bytes, version), shards near equal in bytes.

    The slots, whose number is fixed, are folded in falling order of bytes.
    """
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("neg"), "vslot", "bytes")))
    row = load.groupBy().agg(ordered.alias("slots"))
    row = row.withColumn("to", _deal(F.col("slots"), F.array_repeat(F.lit(0), shards)))
    flat = row.select(F.posexplode("slots").alias("i", "s"), "to")
    return flat.select("s.vslot", F.element_at("to", F.col("i") + 1).alias("shard"), "s.bytes", F.lit(1).alias("version"))


def grow_map(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version of the map, for one shard more: slots move only to the new shard.

    Each old shard gives up slots, from its smallest on, while what it keeps is
    still the new mean or more; all others stay where they are.
    """
    mean = slot_map.agg((F.sum("bytes") / (shards + 1)).alias("mean"), (F.max("version") + 1).alias("next"))
    by = Window.partitionBy("shard")
    ranked = slot_map.withColumn("given", F.sum("bytes").over(by.orderBy("bytes", "vslot"))).withColumn("held", F.sum("bytes").over(by))
    ranked = ranked.crossJoin(F.broadcast(mean))
    moves = (F.col("bytes") > 0) & (F.col("held") - F.col("given") >= F.col("mean"))
    return ranked.select("vslot", F.when(moves, shards).otherwise(F.col("shard")).alias("shard"), "bytes", F.col("next").alias("version"))


def shard_records(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, slot_map: DataFrame | None = None) -> DataFrame:
    """Put every record into one of ``shards`` shards of near equal bytes.

    Returns one row per input row: doc_id, size (UTF-8 bytes of the text plus
    16; null text: 16), text_crc32, law ('bytes'), shard, slot (the record's
    place in its shard, gapless from 0), grown_shard (null under this law),
    virtual_slot.  A given ``slot_map`` (vslot, shard, ..) is applied as it is;
    else version 1 is made from the bytes per slot and stored in the shared
    folder.  Rows that repeat an id share its virtual slot and so its shard.
    A null id is one more key.  Empty input gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        virtual_slot(F.col(id_col), slots).alias("vslot"),
    )
    sized = stored(sized, "sized")
    load = cut(slot_bytes(sized, slots))
    if slot_map is None:
        slot_map = stored(assign_slots(load, shards), "slot-map-v1")
    # places: the shard's slots in order, then the records of each slot
    placed = load.join(slot_map.select("vslot", "shard"), "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    placed = cut(placed.select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "size", "text_crc32"))
    out = sized.withColumn("rank", rank).join(F.broadcast(placed), "vslot")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("vslot").alias("virtual_slot"),
    )
