"""Sharding a track library by fixed virtual slots and a versioned slot map.

Tracks are hashed into thousands of slots once and for all. A small table says which
shard each slot belongs to; re-balancing edits that table and stores it under the next
version, so that only the tracks of edited slots move. DataFrame expressions only.

    <store>/version=<n>   the whole map of one version, renamed into place when written
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage, scratch_folder

SLOTS = 4096
_MAP = "array<struct<slot:int,shard:int>>"


def slot_of(slots: int = SLOTS) -> Column:
    """The virtual slot of a track: by its key and, where keys repeat, its payload."""
    return F.pmod(F.xxhash64(F.col("hash"), F.coalesce("payload", F.lit(""))), F.lit(slots)).cast("int")


def slotted(tracks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(hash, size, crc, vslot): every track with its size in bytes and its slot.

    ``tracks`` is (hash, payload), further columns ignored. The size is that of the
    payload in UTF-8 plus 8 for the key; a null payload has 8.
    """
    text = F.coalesce("payload", F.lit(""))
    return tracks.select(
        "hash", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), slot_of(slots).alias("vslot")
    )


def slot_loads(placed: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, tracks) of all ``slots``, empty ones too."""
    spark = placed.sparkSession
    sums = placed.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("tracks"))
    every = spark.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(sums, "vslot", "left").fillna(0, ["bytes", "tracks"])


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: (version, vslot, shard), slots dealt to shards in ranges."""
    return spark.range(slots).select(
        F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), F.floor(F.col("id") * shards / slots).cast("int").alias("shard")
    )


def edited_map(slot_map: DataFrame, loads: DataFrame, shards: int) -> DataFrame:
    """The next version of ``slot_map``: its slots re-balanced by bytes over ``shards``.

    Slots are taken from the heaviest on. One stays where it is while its shard has room
    below the mean; else it goes to the shard with the least bytes so far. So no shard
    ends above the mean by more than one slot that was moved late, that is, a light one,
    and a new shard, being empty, takes what others have too much. A shard number that is
    no longer in use gives all its slots up. The work is one fold over the slots, a
    number fixed beforehand, whatever the data.
    """
    rows = loads.join(slot_map.select("version", "vslot", "shard"), "vslot")
    packed = rows.agg(
        F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), F.col("vslot").alias("slot"), "shard"))).alias("slots"),
        F.sum("bytes").alias("total"), F.max("version").alias("version"),
    )
    kind = f"struct<load:array<bigint>,placed:{_MAP}>"
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), shards).alias("load"), F.array().cast(_MAP).alias("placed")).cast(kind)

    def step(acc: Column, s: Column) -> Column:
        bytes_, load = -s["b"], acc["load"]
        lightest = F.array_position(load, F.array_min(load)).cast("int") - 1
        stays = (s["shard"] < shards) & (F.coalesce(F.try_element_at(load, s["shard"] + 1), F.lit(0)) + bytes_ <= F.col("total") / shards)
        to = F.when(stays, s["shard"]).otherwise(lightest)
        return F.struct(
            F.transform(load, lambda x, i: F.when(i == to, x + bytes_).otherwise(x)).alias("load"),
            F.concat(acc["placed"], F.array(F.struct(s["slot"].alias("slot"), to.alias("shard")))).alias("placed"),
        ).cast(kind)

    return packed.select((F.col("version") + 1).alias("version"), F.explode(F.aggregate("slots", start, step, lambda acc: acc["placed"])).alias("x")).select(
        "version", F.col("x.slot").alias("vslot"), "x.shard"
    )


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored_versions(spark: SparkSession, store: str) -> list[int]:
    """The versions that a store holds, in order; empty for a folder that is not there."""
    files, where = _files(spark, store)
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def stored_map(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """(version, vslot, shard) of one stored version, the newest if none is named."""
    if version is None:
        version = max(stored_versions(spark, store))
    rows = spark.read.schema("vslot int, shard int").parquet(f"{store}/version={version}")
    return rows.select(F.lit(version).alias("version"), "vslot", "shard")


def store_map(slot_map: DataFrame, store: str, version: int) -> DataFrame:
    """``slot_map`` stored as ``version`` and read back. A stored version is never written again.

    Rows are written aside and renamed, so a version is there whole or not at all. One
    edit of a store goes on at a time.
    """
    spark = slot_map.sparkSession
    files, target = _files(spark, f"{store}/version={version}")
    if files.exists(target):
        raise ValueError(f"version {version} is stored already")
    draft = f"{store}/draft-{uuid.uuid4().hex}"
    slot_map.select("vslot", "shard").coalesce(1).write.parquet(draft)
    if not files.rename(_files(spark, draft)[1], target):
        raise OSError(f"version {version} could not be stored")
    return stored_map(spark, store, version)


def rebalanced(spark: SparkSession, loads: DataFrame, shards: int, slots: int, store: str) -> DataFrame:
    """The map of ``store`` after one edit for these loads.

    An empty store gets version 0 first. When no slot has to move, nothing is stored and
    the newest version stays.
    """
    if not stored_versions(spark, store):
        store_map(first_map(spark, shards, slots), store, 0)
    now = stored_map(spark, store)
    if now.count() != slots:
        raise ValueError(f"the stored map does not have {slots} slots; tracks are hashed to a fixed number of them")
    edited = cut_lineage(edited_map(now, loads, shards).coalesce(1))
    moved = now.join(edited.select("vslot", F.col("shard").alias("to")), "vslot").where("shard <> to")
    return now if moved.isEmpty() else store_map(edited, store, max(stored_versions(spark, store)) + 1)


def _fresh(spark: SparkSession) -> str:
    return f"{scratch_folder(spark)}/slots-{uuid.uuid4().hex}"


def _placed(tracks: DataFrame, shards: int, slots: int, store: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(placed, loads, map): tracks with their slots, bytes per slot, the map edited for them."""
    placed = cut_lineage(slotted(tracks, slots))
    loads = cut_lineage(slot_loads(placed, slots).coalesce(1))
    return placed, loads, rebalanced(tracks.sparkSession, loads, shards, slots, store)


def balanced_map(tracks: DataFrame, shards: int, slots: int = SLOTS, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed, maps): all tracks with their slots, and every stored version of the map with today's loads.

    Without ``store`` the map starts from version 0 in a new folder of the shared one.
    """
    spark = tracks.sparkSession
    store = store or _fresh(spark)
    placed, loads, _ = _placed(tracks, shards, slots, store)
    maps = None
    for version in stored_versions(spark, store):
        one = stored_map(spark, store, version)
        maps = one if maps is None else maps.unionByName(one)
    return placed, maps.join(loads, "vslot")


def shard_tracks(tracks: DataFrame, shards: int = 24, slots: int = SLOTS, store: str | None = None) -> DataFrame:
    """(hash, size, crc, vslot, shard, slot) of every track, shards of near-equal bytes.

    ``tracks`` is (hash, payload). The newest map in ``store`` is edited for the tracks'
    bytes and stored under the next version; only tracks of edited slots change shards.
    Without ``store`` the map starts anew. ``shard`` runs from 0; ``slot`` is the track's place
    in its shard, gapless from 0: its place in its virtual slot after the tracks of the
    shard's earlier slots, so no shard is ever one task's work.

    * A null payload counts as empty, a null hash is a key like any other.
    * Rows that repeat a hash go by their payload too; rows equal in both share a slot
      and stand in it one after another.
    * An empty table gives no rows; a track of any size goes whole to one shard.
    """
    placed, loads, now = _placed(tracks, shards, slots, store or _fresh(tracks.sparkSession))
    current = now.join(loads, "vslot")
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = current.select("vslot", "shard", F.coalesce(F.sum("tracks").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("vslot").orderBy("hash", "crc", "size"))
    # at most `slots` rows, a number fixed beforehand
    return placed.withColumn("place", inside).join(F.broadcast(offsets), "vslot").select(
        "hash", "size", "crc", "vslot", "shard", (F.col("offset") + F.col("place") - 1).cast("long").alias("slot")
    )
