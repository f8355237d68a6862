"""Sharding over fixed virtual slots with a stored, versioned slot-to-shard map (DataFrame functions only)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import new_path
from .common import cut

#: Virtual slots; a record never changes its slot.
SLOTS = 4096
#: Bytes a record takes besides its text.
OVERHEAD = 16

MAP_SCHEMA = "vslot int, shard int, version int"


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The record's slot, from its key alone (a null key has a slot too)."""
    return F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, rows) of every slot, empty ones included; records has vslot and size."""
    spark = records.sparkSession
    held = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(held, "vslot", "left").na.fill(0, ["bytes", "rows"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1: slots dealt round, before any bytes are known. vslot, shard, version."""
    return spark.range(slots).select(F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(shards)).cast("int").alias("shard"), F.lit(1).alias("version"))


def load_map(spark: SparkSession, path: str) -> DataFrame:
    """All versions of the map stored below path (a folder for each version)."""
    return spark.read.schema(MAP_SCHEMA).parquet(path)


def newest(slot_map: DataFrame) -> DataFrame:
    return slot_map.join(slot_map.agg(F.max("version").alias("version")), "version").select("vslot", "shard", "version")


def store_version(version: DataFrame, path: str) -> None:
    """Add one version to the map stored below path. A version is written once and never changed."""
    for n in [r["version"] for r in version.select("version").distinct().collect()]:
        version.where(F.col("version") == n).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={n}")


def rebalance(slot_map: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.0) -> DataFrame:
    """The next version of the map: its newest one, edited so that the shards' bytes come near each other with few moves.

    A shard that holds more than its equal part, by more than ``tolerance`` times that, gives up slots, large ones first, as long as it stays at its part or
    above; a shard that is no longer wanted gives up all. These slots go, in descending bytes, to the shard with the least bytes; all others
    stay where they are. No rows if nothing has to move. Each shard's slots are one row while they are looked through, and so are those that
    move: SLOTS entries at most, however many records there are. slot_map: vslot, shard, version; sizes: vslot, bytes.
    """
    last = newest(slot_map).join(sizes.select("vslot", "bytes"), "vslot")
    part = last.agg(F.floor(F.sum("bytes") / shards).alias("part"))
    by_shard = last.groupBy("shard").agg(F.max("version").alias("version"), F.sum("bytes").alias("load"), F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("minus"), "vslot"))).alias("held")).crossJoin(F.broadcast(part))  # part: one row
    leaves = F.col("shard") >= shards
    over = F.when(leaves, F.col("load")).when(F.col("load") > F.col("part") * (1 + tolerance), F.col("load") - F.col("part")).otherwise(0)
    start = F.struct(over.cast("long").alias("over"), F.array().cast("array<struct<minus: bigint, vslot: int>>").alias("out"))
    give = lambda s, x: F.when((x["minus"] < 0) & (-x["minus"] <= s["over"]), F.struct((s["over"] + x["minus"]).alias("over"), F.concat(s["out"], F.array(x)).alias("out"))).otherwise(s)
    out = F.when(leaves, F.col("held")).otherwise(F.aggregate("held", start, give)["out"])
    by_shard = by_shard.withColumn("out", out).withColumn("load", F.col("load") + F.aggregate("out", F.lit(0).cast("long"), lambda a, x: a + x["minus"]))

    loads = F.map_from_entries(F.collect_list(F.when(~leaves, F.struct("shard", "load"))))
    all_moves = by_shard.agg(F.max("version").alias("version"), loads.alias("by"), F.sort_array(F.flatten(F.collect_list("out"))).alias("out"))
    begin = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(F.coalesce(F.try_element_at("by", k), F.lit(0)).cast("long").alias("load"), k.cast("int").alias("shard")))
    state = F.struct(begin.alias("loads"), F.array().cast("array<int>").alias("to"))

    def put(s, x):
        least = F.array_min(s["loads"])["shard"]
        grown = F.transform(s["loads"], lambda g: F.when(g["shard"] == least, F.struct((g["load"] - x["minus"]).alias("load"), g["shard"].alias("shard"))).otherwise(g))
        return F.struct(grown.alias("loads"), F.concat(s["to"], F.array(least)).alias("to"))

    moves = all_moves.select("version", F.explode(F.arrays_zip("out", F.aggregate("out", state, put)["to"].alias("to"))).alias("z"))
    moves = cut(moves.select(F.col("z.out.vslot").alias("vslot"), F.col("z.to").alias("to"), F.col("version").alias("edited")), "moves")
    after = last.join(moves, "vslot", "left").crossJoin(F.broadcast(moves.agg(F.max("edited").alias("any"))))  # one row
    return after.where("any is not null").select("vslot", F.coalesce("to", "shard").alias("shard"), (F.col("version") + 1).alias("version"))


def shard_documents(docs: DataFrame, shards: int = 40, slots: int = SLOTS, map_path: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """Every row of docs in one of the shards, near equal in bytes (law ``bytes``), by the newest version of the map.

    map_path: where the map is stored. If there is one, it is edited for docs' bytes and ``shards`` and the new version is added; else a first version is stored
    and edited. Without a path the map lives in the session's shared folder.
    Rows: doc_id, size (UTF-8 bytes of the text + 16), text_crc32, law, shard, slot (its place in the
    shard, gapless from 0), grown_shard (null: the law is ``bytes``), vslot, version.
    A null text has no bytes and the CRC of the empty text; rows with equal doc_id, null included, share a virtual slot and
    keep all their copies; equal texts aren't kept together, so a large group of them spreads; an empty table gives no rows; further columns are left aside.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    records = cut(
        docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("vslot")),
        "records",
    )
    sizes = cut(slot_bytes(records, slots), "slot_bytes")
    path = map_path or new_path(spark, "slot_map")
    try:
        maps = load_map(spark, path)
    except AnalysisException:  # nothing stored there yet
        store_version(first_map(spark, shards, slots), path)
        maps = load_map(spark, path)
    store_version(cut(rebalance(maps, sizes, shards, tolerance), "next_version"), path)
    begin = newest(load_map(spark, path)).join(sizes, "vslot").withColumn("begin", F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)))
    begin = begin.select("vslot", "version", "shard", F.coalesce("begin", F.lit(0)).alias("begin"))
    at = Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")
    placed = records.withColumn("within", F.row_number().over(at) - 1).join(F.broadcast(begin), "vslot")  # as many rows as slots
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "version"
    )
