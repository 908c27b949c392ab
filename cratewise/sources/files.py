"""Folders of files: scan, identity, dedupe, gates, path audit and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Audio suffixes and folders never entered.
AUDIO_SUFFIXES = [
    ".mp3", ".flac", ".m4a", ".mp4", ".aac", ".alac", ".ogg", ".oga", ".opus", ".wav", ".aif", ".aiff",
    ".aifc", ".wma", ".wv", ".ape", ".mpc", ".dsf",
]
SKIP_FOLDERS = [
    "$recycle.bin", "system volume information", "windows", "program files", "program files (x86)",
    "programdata", "users", "appdata", ".git", "node_modules", "__pycache__", "temp",
]
EXAMPLES = 25


def is_audio_path(path: Column) -> Column:
    """Audio suffix, not a ``._`` sidecar, not under a system folder."""
    name = F.substring_index(path, "/", -1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    folders = F.slice(F.split(F.lower(path), "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    system = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_FOLDERS))) | F.exists(folders, lambda f: f.startswith("pytest-of-"))
    return suffix.isin(AUDIO_SUFFIXES) & ~name.startswith("._") & ~system


def below(path: Column, root: str | None) -> Column:
    """The part of a path under the scanned folder: rules on folder names start there."""
    if root is None:
        return path
    return F.element_at(F.split(path, "\\Q" + root.rstrip("/") + "\\E", 2), -1)


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, length) of the audio files under a folder."""
    suffixes = ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in AUDIO_SUFFIXES)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{suffixes}}}").load(folder)
    return files.where(is_audio_path(below(F.col("path"), folder))).select("path", "content", "length")


def content_hash(files: DataFrame) -> DataFrame:
    """(hash, path, length): SHA-1 of the bytes; the bytes go no further."""
    return files.select(F.sha1("content").alias("hash"), "path", "length")


def first_paths(hashed: DataFrame) -> DataFrame:
    """(hash, path, copies): one row per content, the first path in order."""
    return hashed.groupBy("hash").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("copies"))


def duration_gate(rows: DataFrame, minimum: float, duration: str = "duration") -> tuple[DataFrame, DataFrame]:
    """(rows long enough or of unknown length, number of short ones)."""
    short = F.coalesce(F.col(duration) < minimum, F.lit(False))
    return rows.where(~short), rows.agg(F.count_if(short).alias("short"), F.count(F.lit(1)).alias("processed"))


def unseen(rows: DataFrame, tracks: DataFrame, key: str = "hash") -> DataFrame:
    """Rows whose key the track table does not hold."""
    return rows.join(tracks.select(key), key, "left_anti")


def path_states(tracks: DataFrame, present: DataFrame, key: str = "hash") -> DataFrame:
    """Tracks with ``state`` ok, broken or missing; ``present`` lists the files that exist."""
    there = present.select(F.col("path").alias("filepath")).distinct().withColumn("_there", F.lit(True))
    blank = F.trim(F.coalesce("filepath", F.lit(""))) == ""
    return tracks.join(there, "filepath", "left").withColumn(
        "state", F.when(blank, "missing").when(F.col("_there"), "ok").otherwise("broken")
    ).drop("_there")


def path_report(states: DataFrame) -> DataFrame:
    """(state, n)."""
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def path_examples(states: DataFrame, key: str = "hash", n: int = EXAMPLES) -> DataFrame:
    """The first 25 broken and the first 25 missing tracks."""
    order = Window.partitionBy("state").orderBy(key)
    return states.where(F.col("state") != "ok").withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)


def repair_paths(tracks: DataFrame, scanned: DataFrame, present: DataFrame, overwrite_broken: bool = True, key: str = "hash") -> DataFrame:
    """(key, old, filepath, action) for tracks found on disk: filled, repointed or kept."""
    states = path_states(tracks, present, key).select(key, F.col("filepath").alias("old"), "state")
    found = states.join(scanned.select(key, "path"), key)
    action = F.when(F.col("state") == "missing", "filled").when((F.col("state") == "broken") & F.lit(overwrite_broken), "repointed").otherwise("kept")
    return found.withColumn("action", action).select(
        key, "old", F.when(F.col("action") == "kept", F.col("old")).otherwise(F.col("path")).alias("filepath"), "action"
    )


def repair_report(repairs: DataFrame, scanned: DataFrame) -> DataFrame:
    """One row: matched, filled, repointed, kept, unanalysed."""
    files = scanned.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return repairs.agg(
        F.count(F.lit(1)).alias("matched"), *[F.count_if(F.col("action") == a).alias(a) for a in ("filled", "repointed", "kept")]
    ).withColumn("unanalysed", files - F.col("matched"))
