"""Folder tables as streams, skip folders, zero tempo, empty groups, long lists."""

import pytest
from pyspark.sql import functions as F

from cratewise.catalog import QUERIES
from cratewise.operators import profiles, search
from cratewise.sources import files
from cratewise.streaming import frames


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The same few rows as lone files would hold, written as folders of part files."""
    out = str(tmp_path_factory.mktemp("tables"))
    days = F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600)
    events = spark.range(60).select(
        F.col("id").alias("event_id"), days.alias("ts"), (F.col("id") % 4).alias("user_id"),
        F.element_at(F.array(F.lit("view"), F.lit("click")), (F.col("id") % 2 + 1).cast("int")).alias("event_type"), (F.col("id") + 1.0).alias("value"),
    )
    events.repartition(3).write.parquet(f"{out}/events.parquet")
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") % 10 * 10).cast("int")).alias("text"))
    docs.repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


def test_streams_read_folder_tables(spark, tables):
    assert QUERIES["frame_stream"](spark, tables).count() == 60
    assert QUERIES["ingest_documents"](spark, tables).count() == 6  # 40 words or more, each length once
    report = {r["status"]: r["files"] for r in QUERIES["ingest_report"](spark, tables).collect()}
    assert report == {"ok": 6, "short": 4}


@pytest.mark.parametrize("folder", ["$RECYCLE.BIN", "Users", "AppData", ".git", "node_modules", "__pycache__", "Temp", "Windows", "pytest-of-me"])
def test_folders_never_entered(spark, folder):
    ok = files.is_audio_path(F.col("p"))
    rows = spark.createDataFrame([(f"music/{folder}/a.mp3",), (f"music/{folder}.mp3",), (f"music/my {folder}/a.mp3",)], "p string")
    assert [r[0] for r in rows.select(ok).collect()] == [False, True, True]


def test_scan_reads_audio_suffixes_only(spark, tmp_path):
    for name in ("a.MP3", "b.txt", "c.flac", "._d.mp3"):
        (tmp_path / name).write_bytes(b"x")
    assert {r["path"].rsplit("/", 1)[1] for r in files.scan_folder(spark, str(tmp_path)).collect()} == {"a.MP3", "c.flac"}


def test_zero_tempo_does_not_stop_a_job(spark):
    rows = spark.createDataFrame([("zero", "8A", 0.0), ("timed", "8A", 120.0), ("open", "8A", None)], "hash string, camelot string, bpm double")
    assert {r["hash"] for r in search.harmonic_matches(rows, "hash", "8A", 120.0).collect()} == {"timed", "open"}
    assert {r["hash"]: r["partners"] for r in search.harmonic_counts(rows, "hash").collect()} == {"zero": 1, "timed": 1, "open": 2}


def test_card_of_empty_groups(spark):
    row = profiles.summary_card(spark.createDataFrame([("a", 0, "")], "name string, count long, description string"), "name").first()
    assert row["members"] == 0 and row["largest_share"] == 0


def test_frames_may_come_out_of_order(spark, tmp_path):
    rows = [("t", i, [("Techno" if i < 3 else "House", 0.9)]) for i in range(8)]
    schema = "hash string, frame_idx long, top array<struct<style:string,score:double>>"
    for part, chosen in enumerate([rows[:2], rows[5:8], rows[2:4], rows[4:5] + rows[1:2]]):
        spark.createDataFrame(chosen, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{part}"))

    def labels(order, contiguous):
        out = tmp_path / f"out-{contiguous}-{len(order)}-{order[0]}"
        for part in order:  # each part is a batch of its own, the state goes on
            target = tmp_path / f"feed-{out.name}"
            spark.read.parquet(str(tmp_path / f"in{part}")).coalesce(1).write.mode("append").parquet(str(target))
            stream = frames.label_stream(spark.readStream.schema(schema).parquet(str(target)), "hash", contiguous=contiguous)
            stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{out}/rows").collect()

    mixed = labels([0, 1, 2, 3], True)
    assert [(r["frame_idx"], r["style"]) for r in sorted(mixed, key=lambda r: r["frame_idx"]) if not r["late"]] == [
        (0, "Techno"), (1, "Techno"), (2, "Techno"), (3, "Techno"), (4, "House"), (5, "House"), (6, "House"), (7, "House")
    ]
    assert [r["frame_idx"] for r in mixed if r["late"]] == [1]
    late = [r["frame_idx"] for r in labels([1, 0], False) if r["late"]]
    assert sorted(late) == [0, 1]
