"""Sharding by fixed virtual slots; DataFrame functions only.

Records hash into SLOTS virtual slots, a number that never changes.  The slot-to-shard map is a small versioned
table.  Version 1 deals the slots round the shards before anything is known of the records; then bytes are summed
per slot, and rebalancing edits the map: it moves whole slots, and only those that a shard holds above its fair share.  Records stay in
their slots.  A slot of many times the mean's rows, as repeated rows make it, is split into PARTS units that move
alone.  A record's place in its shard is the rows of the shard's earlier units plus its rank in
its unit, so no task ever holds a whole shard.

Records of equal texts aren't kept together: a group of them may hold a third of all rows, and shards have near equal bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .store import Scratch

SLOTS = 4096
PARTS = 64
HEAVY = 16  # times the mean slot's rows, and times PARTS


def slot_of(*keys: Column, slots: int = SLOTS) -> Column:
    """The leading 32 bits of the keys' MD5, modulo the slots; a null key counts as an empty one."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % slots).cast("int")


def slot_sizes(records: DataFrame) -> DataFrame:
    """records(virtual_slot, size, part) -> (virtual_slot, part, bytes, rows): a unit is a slot, or a part of a heavy one."""
    return records.groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))


def with_parts(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """records(virtual_slot, size, row) with their part: 0, or row modulo PARTS in a slot of more than HEAVY times the mean rows, or PARTS."""
    sizes = records.groupBy("virtual_slot").agg(F.count("*").alias("rows"))
    heavy = sizes.crossJoin(F.broadcast(sizes.agg(F.greatest(F.lit(PARTS), F.sum("rows") / slots).alias("least"))))  # one row
    heavy = heavy.where(F.col("rows") > HEAVY * F.col("least")).select("virtual_slot", F.lit(True).alias("heavy"))
    part = F.when(F.col("heavy"), F.pmod("row", F.lit(PARTS))).otherwise(0).cast("int")
    return records.join(F.broadcast(heavy), "virtual_slot", "left").withColumn("part", part).drop("heavy")  # fewer than slots / HEAVY rows


def even_slot_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, part, shard, bytes, rows): slots dealt round the shards, before sizes are known."""
    slot = F.col("id").cast("int")
    return spark.range(slots).select(slot.alias("virtual_slot"), F.lit(0).alias("part"), (slot % shards).alias("shard"), F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("rows"))


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The map edited for new sizes and so many shards, moving units only out of shards above their fair share.

    A shard keeps its largest units up to its fair share of the bytes; the others, and those that are new or whose shard no longer
    exists, go largest first to the shard with least bytes.  sizes may lack slots that are now empty.
    """
    now = sizes.join(slot_map.select("virtual_slot", "part", "shard"), ["virtual_slot", "part"], "left")
    fair = now.agg((F.sum("bytes") / shards).alias("fair"))
    run = F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot", "part"))
    stays = F.col("shard").isNotNull() & (F.col("shard") < shards) & (F.col("run") <= F.col("fair"))
    marked = now.withColumn("run", run).crossJoin(F.broadcast(fair)).withColumn("stays", F.coalesce(stays, F.lit(False)))  # one row
    kept, moved = marked.where("stays"), marked.where("not stays")
    loads = kept.groupBy("shard").agg(F.sum("bytes").alias("load"))
    by_shard = F.map_from_entries(F.collect_list(F.struct("shard", "load")))
    held = loads.agg(by_shard.alias("m")).select(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("start"))
    order = F.reverse(F.array_sort(F.collect_list(F.struct("bytes", "rows", "virtual_slot", "part"))))  # units, a bounded number
    packed = moved.agg(order.alias("units")).crossJoin(F.broadcast(held))  # one row each

    def place(acc: Column, unit: Column) -> Column:
        shard = F.array_position(acc["loads"], F.array_min(acc["loads"])).cast("int") - 1
        grown = F.transform(acc["loads"], lambda v, i: F.when(i == shard, v + unit["bytes"]).otherwise(v))
        return F.struct(grown.alias("loads"), F.concat(acc["shards"], F.array(shard)).alias("shards"))

    start = F.struct(F.col("start").alias("loads"), F.array().cast("array<int>").alias("shards"))
    placed = packed.select("units", F.aggregate("units", start, place)["shards"].alias("shards"))
    again = placed.select(F.explode(F.arrays_zip("units", "shards")).alias("x")).select("x.units.virtual_slot", "x.units.part", F.col("x.shards").alias("shard"), "x.units.bytes", "x.units.rows")
    return kept.select("virtual_slot", "part", "shard", "bytes", "rows").union(again)


def save_slot_map(slot_map: DataFrame, folder: str, version: int) -> None:
    """One folder a version; a version is never written over."""
    slot_map.coalesce(1).write.mode("error").parquet(f"{folder}/version={version}")


def load_slot_map(spark: SparkSession, folder: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, part int, shard int, bytes long, rows long").parquet(f"{folder}/version={version}")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot) of every row; a null text has size 1 and the checksum of no bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", slot_of(F.col(id_col), F.col("text_crc32"), slots=slots))


def place(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """rows with shard and slot, the gapless place from 0 within the shard."""
    before = Window.partitionBy("shard").orderBy("virtual_slot", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("virtual_slot", "part", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "part").orderBy(id_col, "text_crc32", "size", "row"))
    return rows.join(F.broadcast(offsets), ["virtual_slot", "part"]).withColumn("slot", F.col("offset") + rank - 1).drop("offset")  # a row for each unit


def shard_by_slots(df: DataFrame, shards: int, folder: str, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(id, size, text_crc32, virtual_slot, part, shard, slot, map_version) of every row of df; law: near equal bytes.

    The slot map is stored under `folder`: version 1 as dealt out, version 2 as edited for the bytes, which is read back and used.
    Null ids and repeated rows are records like others: a null id is spread by its text, repeated rows share a slot,
    whose parts take turns if it's heavy.  An empty table gives an empty result.  Other columns of df are left out.
    """
    spark = df.sparkSession
    # a row's number is written once, so that all that follows sees the same one
    rows = Scratch(spark, "sharding").keep(measured(df, id_col, text_col, slots).withColumn("row", F.monotonically_increasing_id()), "rows")
    rows = with_parts(rows, slots)
    save_slot_map(even_slot_map(spark, shards, slots), folder, 1)
    save_slot_map(rebalance(load_slot_map(spark, folder, 1), slot_sizes(rows), shards), folder, 2)
    return place(rows, load_slot_map(spark, folder, 2), id_col).withColumn("map_version", F.lit(2)).drop("row")
