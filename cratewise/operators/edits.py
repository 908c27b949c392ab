"""Edits as append-only events with current state derived from them.

An event carries its entity, a value and ``updated`` (made unique by a sequence
number where needed). State is an aggregate, so replaying events changes nothing,
late events merge, and a hot entity is combined before the shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import music, text as T
from ..functions.reads import clamp_step


def latest_fields(events: DataFrame, key: str, fields: list[str], at: str = "updated") -> DataFrame:
    """Latest non-null value per field: a partial update leaves the other fields alone."""
    return events.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields
    ])


def rating_state(events: DataFrame, key: str, at: str = "updated") -> DataFrame:
    """Current (stars, grade, note) of partial rating events, cleaned."""
    cleaned = events.select(
        key, at, F.when(F.col("stars").isNotNull(), T.star_value(F.col("stars"))).alias("stars"),
        T.grade_text(F.col("grade")).alias("grade"), T.note_text(F.col("note")).alias("note"),
    )
    state = latest_fields(cleaned, key, ["stars", "grade", "note"], at)
    return state.select(key, F.coalesce("stars", F.lit(0)).alias("stars"), F.coalesce("grade", F.lit("")).alias("grade"), F.coalesce("note", F.lit("")).alias("note"))


def artist_leaderboard(state: DataFrame, name: str = "artist") -> DataFrame:
    """Rated artists, most stars first, then name without case (L3)."""
    return state.orderBy(F.desc("stars"), F.lower(name))


def upsert(rows: DataFrame, key: list[str], at: str = "updated") -> DataFrame:
    """The latest row per unique key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*key, "_r.*")


def toggled(events: DataFrame, key: list[str]) -> DataFrame:
    """Memberships toggled an odd number of times."""
    return events.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") % 2 == 1).drop("_n")


def forget(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of forgotten tracks."""
    return {name: df.join(gone.select(key), key, "left_anti") for name, df in tables.items()}


def label_state(events: DataFrame, key: str, at: str = "updated") -> tuple[DataFrame, DataFrame]:
    """(labels, rejects) from confirm / reject events on (key, genre) (E5).

    A confirm labels for good and clears an earlier reject. A reject after it stands beside the label.
    """
    pairs = events.groupBy(key, "genre").agg(
        F.min_by("source", F.when(F.col("action") == "confirm", F.col(at))).alias("source"),
        F.max(F.when(F.col("action") == "confirm", F.col(at))).alias("_c"),
        F.max(F.when(F.col("action") == "reject", F.col(at))).alias("_r"),
    )
    labels = pairs.where(F.col("_c").isNotNull()).select(key, "genre", "source")
    rejects = pairs.where(F.col("_r").isNotNull() & (F.col("_c").isNull() | (F.col("_r") > F.col("_c")))).select(key, "genre")
    return labels, rejects


def add_manual(wanted: DataFrame, tracks: DataFrame, key: str, genre: str) -> tuple[DataFrame, DataFrame]:
    """(label rows for known tracks, keys not in the library) (E5)."""
    known = wanted.select(key).distinct().join(tracks.select(key), key, "left_semi")
    unknown = wanted.select(key).distinct().join(tracks.select(key), key, "left_anti")
    return known.select(key, F.lit(genre).alias("genre"), F.lit("manual").alias("source")), unknown


def clear_genre(rows: DataFrame, genre: str) -> DataFrame:
    """Rows of every other genre, compared without case."""
    return rows.where(F.lower("genre") != F.lower(F.trim(F.lit(genre))))


def override_state(events: DataFrame, key: str, at: str = "updated") -> DataFrame:
    """Standing overrides; a null or unusable name clears or is ignored."""
    usable = events.where(F.col("override").isNull() | T.folder_name(F.col("override")).isNotNull())
    latest = usable.groupBy(key).agg(F.max_by(F.struct("override"), at).alias("_o"))
    return latest.select(key, F.trim("_o.override").alias("override")).where(F.col("override").isNotNull())


def adjustment_state(events: DataFrame, key: str, at: str = "updated") -> DataFrame:
    """(key, steps, drops) from whole-part edit events of either kind.

    An omitted (null) part keeps its last value and zero steps vanish. A drop takes
    the step set before or with it for good, even if the drop is lifted later.
    """
    steps = F.map_filter(
        F.transform_values(F.transform_keys("steps", lambda k, v: F.trim(k)), lambda k, v: clamp_step(v)),
        lambda k, v: (v != 0) & (k != ""),
    )
    clean = events.select(
        key, at, F.when(F.col("steps").isNotNull(), steps).alias("steps"), T.clean_drops(F.col("drops")).alias("drops")
    )
    state = clean.groupBy(key).agg(
        F.max_by(F.struct("steps", F.col(at).alias("at")), F.when(F.col("steps").isNotNull(), F.col(at))).alias("_s"),
        F.max_by("drops", F.when(F.col("drops").isNotNull(), F.col(at))).alias("drops"),
    )
    dropped = clean.select(key, at, F.explode("drops").alias("genre")).groupBy(key, "genre").agg(F.max(at).alias("_d"))
    tall = state.select(key, F.col("_s.at").alias("_at"), F.explode("_s.steps").alias("genre", "step"))
    kept = tall.join(dropped, [key, "genre"], "left").where(F.col("_d").isNull() | (F.col("_d") < F.col("_at")))
    # One entry per genre the user adjusted on a track.
    maps = kept.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("genre", "step")))).alias("steps"))
    return state.select(key, "drops").join(maps, key, "left").select(
        key, F.coalesce("steps", F.create_map().cast("map<string,int>")).alias("steps"),
        F.coalesce("drops", F.array().cast("array<string>")).alias("drops"),
    )


def key_corrections(events: DataFrame, key: str, at: str = "updated") -> DataFrame:
    """Standing key corrections: the latest valid event, a null key clears."""
    valid = events.where(F.col("key").isNull() | (F.col("key").isin(music.KEY_NAMES) & F.col("scale").isin(music.MODES)))
    latest = valid.groupBy(key).agg(F.max_by(F.struct("key", "scale"), at).alias("_k"))
    return latest.select(key, "_k.key", "_k.scale").where(F.col("key").isNotNull())


def corrected_keys(tracks: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """Detected keys overlaid by corrections, the Camelot code recomputed for those."""
    fixes = corrections.select(key, F.col("key").alias("_k"), F.col("scale").alias("_s"))
    joined = tracks.join(fixes, key, "left")
    fixed = F.col("_k").isNotNull()
    return joined.select(
        key,
        F.when(fixed, F.col("_k")).otherwise(F.col("key")).alias("key"),
        F.when(fixed, F.col("_s")).otherwise(F.col("scale")).alias("scale"),
        F.when(fixed, music.camelot(F.col("_k"), F.col("_s"))).otherwise(F.col("camelot")).alias("camelot"),
        F.when(fixed, "manual").otherwise("detector").alias("key_source"),
    )


def vibe_members(events: DataFrame, at: str = "updated") -> DataFrame:
    """(vibe, hash, weight) from set / remove / reset / clear / delete events.

    Vibe-wide events (null hash) act on everything set before them: clear and
    delete empty the vibe, reset brings every weight back to 1.
    """
    wide = events.where(F.col("hash").isNull()).groupBy("vibe").agg(
        F.max(F.when(F.col("action").isin("clear", "delete"), F.col(at))).alias("_cleared"),
        F.max(F.when(F.col("action") == "reset", F.col(at))).alias("_reset"),
    )
    members = events.where(F.col("hash").isNotNull()).groupBy("vibe", "hash").agg(
        F.max_by(F.struct("action", "weight", F.col(at).alias("at")), at).alias("_m")
    ).join(wide, "vibe", "left")
    live = (F.col("_m.action") == "set") & (F.col("_cleared").isNull() | (F.col("_m.at") > F.col("_cleared")))
    weight = F.when(F.col("_reset") > F.col("_m.at"), 1.0).otherwise(F.coalesce(F.col("_m.weight"), F.lit(1.0)))
    return members.where(live).select("vibe", "hash", weight.alias("weight"))


def clean_weight(weight: Column) -> Column:
    """Member weight in -1..1; unreadable is 1."""
    w = weight.try_cast("double")
    return F.when(w.isNull(), 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w)))


def import_vibes(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged members, counts) of a vibe import matched by name.

    ``existing`` is (name, hash, weight); ``incoming`` is (name, pos, hash, weight).
    """
    clean = incoming.withColumn("name", F.trim("name")).where(F.coalesce("name", F.lit("")) != "")
    links = clean.where(F.coalesce(F.col("hash").cast("string"), F.lit("")) != "").select("name", "hash", clean_weight(F.col("weight")).alias("weight"), "pos")
    latest = links.groupBy("name", "hash").agg(F.max_by("weight", "pos").alias("weight"))
    kept = existing.where(F.col("hash").isNotNull()).join(latest.select("name", "hash"), ["name", "hash"], "left_anti")
    names = clean.groupBy("name").agg(F.lit(1).alias("one")).join(
        existing.select("name").distinct().withColumn("old", F.lit(True)), "name", "left"
    )
    tally = names.agg(F.count_if(F.col("old").isNull()).alias("created"), F.count_if("old").alias("merged"))
    written = links.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return kept.select("name", "hash", "weight").unionByName(latest), tally.withColumn("links", written)


def take_snapshot(tables: dict[str, DataFrame], folder: str, snapshot_id: str, label: str, created: float) -> DataFrame:
    """Write each table under ``snapshot_id`` and return its metadata row."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("append").partitionBy("snapshot_id").parquet(f"{folder}/{name}")
    meta = spark.createDataFrame([(snapshot_id, label, float(created))], "snapshot_id string, label string, created double")
    meta.write.mode("append").parquet(f"{folder}/_snapshots")
    return meta


def list_snapshots(spark, folder: str) -> DataFrame:
    """Snapshots, newest first."""
    return spark.read.parquet(f"{folder}/_snapshots").orderBy(F.desc("created"), F.desc("snapshot_id"))


def restore_snapshot(spark, folder: str, snapshot_id: str, name: str, tracks: DataFrame, key: str) -> DataFrame:
    """A table's rows in a snapshot whose tracks still exist."""
    saved = spark.read.parquet(f"{folder}/{name}").where(F.col("snapshot_id") == snapshot_id).drop("snapshot_id")
    return saved.join(tracks.select(key), key, "left_semi")


def input_stamp(versions: dict[str, DataFrame], at: str, *settings: str) -> str:
    """Digest of the newest version of every input and the settings; equal means reuse."""
    parts = [f"{name}:{df.agg(F.max(at)).first()[0]}:{df.count()}" for name, df in sorted(versions.items())]
    return hashlib.sha256("|".join([*parts, *settings]).encode()).hexdigest()


def stamp_table(versions: DataFrame, name: str, version: str, settings: str = "") -> DataFrame:
    """(stamp) over a (name, version) table, for use inside a plan."""
    newest = versions.groupBy(name).agg(F.max(version).alias("v"))
    # One row per input table.
    joined = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(name), F.col("v").cast("string")))), "|")
    return newest.agg(F.sha2(F.concat(joined, F.lit(settings)), 256).alias("stamp"))
