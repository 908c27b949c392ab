"""Exports: NDJSON, label CSV, TSV, M3U, collection XML, vibes, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music, text as T
from ..operators.labels import SOURCES
from ..plans.ranks import group_rank

# Fixed value: rating per star in the collection file.
RATING_STEP = 51


def write_results(results: DataFrame, path: str) -> DataFrame:
    """Batch results as NDJSON, and one row of totals."""
    results.write.mode("append").json(path)
    return batch_totals(results)


def batch_totals(results: DataFrame) -> DataFrame:
    """(processed, total, failed, short) of a batch of (status) rows."""
    return results.agg(
        F.count_if(F.col("status") == "ok").alias("processed"), F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "error").alias("failed"), F.count_if(F.col("status") == "short").alias("short"),
    )


def label_csv_rows(labels: DataFrame) -> DataFrame:
    """Label rows in file order: source priority, then hash."""
    return labels.select("hash", "filepath", "genre", "source").orderBy(F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source")), "hash")


def write_label_csv(labels: DataFrame, path: str) -> None:
    label_csv_rows(labels).write.mode("overwrite").option("header", True).csv(path)


def read_label_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash string, filepath string, genre string, source string").option("header", True).csv(path)


def listing_text(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """The listing's visible columns as display text."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("—"))
    shown = {
        "key": lambda: music.key_text(F.col("key"), F.col("scale")), "duration": lambda: music.length_text(F.col("duration")),
        "created": lambda: music.date_text(F.col("created")), "bpm": lambda: F.col("bpm").cast("string"),
    }
    return tracks.select(*[dash(shown[c]() if c in shown else F.col(c).cast("string")).alias(c) for c in columns])


def write_listing_tsv(tracks: DataFrame, columns: list[str], path: str) -> None:
    listing_text(tracks, columns).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def m3u_lines(entries: DataFrame, base: str) -> DataFrame:
    """(id, pos, line): the playlist file, a label line and an address per track."""
    artist = F.coalesce(T.blank_to_null(F.col("artist")), F.lit(""))
    label = F.concat(F.when(artist == "", "").otherwise(F.concat(artist, F.lit(" - "))), F.coalesce(T.blank_to_null(F.col("title")), F.lit("Track")))
    body = entries.select("id", "pos", F.explode(F.array(
        F.struct(F.lit(0).alias("part"), F.concat(F.lit("#EXTINF:-1,"), label).alias("line")),
        F.struct(F.lit(1).alias("part"), F.concat(F.lit(base), F.col("hash")).alias("line")),
    )).alias("l")).select("id", (F.col("pos") * 2 + F.col("l.part") + 1).cast("long").alias("pos"), "l.line")
    head = entries.select("id").distinct().select("id", F.lit(0).cast("long").alias("pos"), F.lit("#EXTM3U").alias("line"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str) -> None:
    """Lines in order, one folder per playlist; a long playlist spans several ordered files."""
    lines.orderBy("id", "pos").select("id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("id").text(path)


def _attr(name: str, value: Column) -> Column:
    """``name="value"`` with the five XML specials escaped."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;"), ("\r", "&#13;"), ("\t", "&#9;")):
        v = F.replace(v, F.lit(raw), F.lit(safe))
    return F.concat(F.lit(f'{name}="'), v, F.lit('"'))


def collection_tracks(entries: DataFrame, ratings: DataFrame, key: str = "hash", sizes_from: DataFrame | None = None) -> DataFrame:
    """(id, track_id, line): one TRACK element per entry with a path, numbered in list order.

    ``sizes_from`` is a table of (id) with a row for every entry, see :func:`group_rank`.
    """
    rated = entries.where(F.trim(F.coalesce("filepath", F.lit(""))) != "").join(ratings.select(key, "stars", "grade", "note"), key, "left")
    numbered = group_rank(rated, ["id"], [F.col("pos")], out="track_id", sizes_from=sizes_from)
    comment = T.comment_text(F.coalesce("grade", F.lit("")), F.coalesce("note", F.lit("")))
    when = lambda ok, c: F.when(ok, c)
    line = F.concat(F.lit("<TRACK "), F.concat_ws(
        " ", _attr("TrackID", F.col("track_id")), _attr("Name", F.col("title")), _attr("Artist", F.col("artist")),
        _attr("Location", T.file_url(F.col("filepath"))), _attr("Rating", T.star_value(F.coalesce("stars", F.lit(0)).cast("string")) * RATING_STEP),
        when(comment != "", _attr("Comments", comment)), when(F.coalesce("bpm", F.lit(0.0)) != 0, _attr("AverageBpm", F.bround(F.col("bpm"), 2))),
        when(F.coalesce("key", F.lit("")) != "", _attr("Tonality", F.col("key"))),
        when(F.coalesce("duration", F.lit(0.0)) != 0, _attr("TotalTime", F.col("duration").cast("long"))),
    ), F.lit("/>"))
    return numbered.select("id", "track_id", line.alias("line"))


def collection_counts(entries: DataFrame) -> DataFrame:
    """(id, exported, skipped): a track without a path is left out and counted."""
    has = F.trim(F.coalesce("filepath", F.lit(""))) != ""
    return entries.groupBy("id").agg(F.count_if(has).alias("exported"), F.count_if(~has).alias("skipped"))


def collection_xml(entries: DataFrame, ratings: DataFrame, playlists: DataFrame, product: str = "cratewise") -> DataFrame:
    """(id, pos, line): the whole collection document of each playlist.

    Lines carry their place, so the document is an ordered write and never one task.
    """
    body = collection_tracks(entries, ratings)
    counts = playlists.select("id", "name").join(collection_counts(entries), "id", "left").select(
        "id", "name", F.coalesce("exported", F.lit(0)).alias("n"), F.coalesce("skipped", F.lit(0)).alias("skipped")
    )
    n = F.col("n")
    at = lambda part, pos, line: F.struct(F.lit(part).alias("part"), pos.cast("long").alias("pos"), line.alias("line"))
    zero = F.lit(0)
    note = F.concat(F.lit("<!-- "), F.col("skipped").cast("string"), F.lit(" track(s) omitted: no stored file path -->"))
    frame = [
        at(0, zero, F.lit('<?xml version="1.0" encoding="UTF-8"?>')), at(0, zero + 1, F.lit('<DJ_PLAYLISTS Version="1.0.0">')),
        at(0, zero + 2, F.lit(f'<PRODUCT Name="{product}" Version="1.0"/>')),
        at(0, zero + 3, F.when(F.col("skipped") > 0, note)),
        at(0, zero + 4, F.concat(F.lit("<COLLECTION "), _attr("Entries", n), F.lit(">"))),
        at(2, zero, F.lit("</COLLECTION>")), at(2, zero + 1, F.lit("<PLAYLISTS>")),
        at(2, zero + 2, F.lit('<NODE Type="0" Name="ROOT" Count="1">')),
        at(2, zero + 3, F.concat(F.lit("<NODE "), F.concat_ws(" ", _attr("Name", F.col("name")), F.lit('Type="1" KeyType="0"'), _attr("Entries", n)), F.lit(">"))),
        *[at(4, zero + i, F.lit(s)) for i, s in enumerate(["</NODE>", "</NODE>", "</PLAYLISTS>", "</DJ_PLAYLISTS>"])],
    ]
    outer = counts.select("id", F.explode(F.array(*frame)).alias("l")).select("id", "l.part", "l.pos", "l.line").where(F.col("line").isNotNull())
    ref = F.concat(F.lit("<TRACK "), _attr("Key", F.col("track_id")), F.lit("/>"))
    inner = body.select("id", F.explode(F.array(
        at(1, F.col("track_id"), F.col("line")), at(3, F.col("track_id"), ref)
    )).alias("l")).select("id", "l.part", "l.pos", "l.line")
    width = 1 << 40
    return outer.unionByName(inner).select("id", (F.col("part") * width + F.col("pos")).alias("pos"), "line")


def vibe_rows(vibes: DataFrame, members: DataFrame) -> DataFrame:
    """(name, hash, weight): one line per member, a null weight as 1; empty vibes keep a line."""
    return vibes.select(F.col("id").alias("vibe_id"), "name").join(members, "vibe_id", "left").select(
        "name", "hash", F.when(F.col("hash").isNotNull(), F.coalesce("weight", F.lit(1.0))).alias("weight")
    )


def write_vibes(vibes: DataFrame, members: DataFrame, path: str) -> None:
    vibe_rows(vibes, members).write.mode("overwrite").json(path)


def write_manifest(entries: DataFrame, path: str) -> None:
    """Training-set manifest, one JSON line per hash."""
    entries.write.mode("overwrite").json(path)
