"""Folder ingest, exactly once (R1, S9): batches of files in, unseen analysed tracks added.

A store is a log of committed batches. The rows of a batch, good and bad, are staged in a
folder of their own; the batch exists from the moment its one log entry, named by run and
batch number, is renamed into place. A batch that died before is never read, one that is
replayed after finds its entry and adds nothing.

    <store>/rows-<id>/                   staged rows
    <store>/log/<run>-<number>.json      {"rows": <folder>}
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music, reads
from ..operators.learn import Engines, analyse
from ..sources.files import below, is_audio_path

STORE = (
    "hash string, path string, styles array<struct<style:string,score:double>>, bpm double, key string, scale string, "
    "camelot string, duration double, status string, error string"
)


class BatchLog:
    """The committed batches of a store; one writer at a time."""

    def __init__(self, spark: SparkSession, store: str) -> None:
        self.spark, self.store = spark, store
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(store).getFileSystem(spark._jsc.hadoopConfiguration())

    def _entry(self, run: str, number: int):
        return self._path(f"{self.store}/log/{run}-{number}.json")

    def holds(self, run: str, number: int) -> bool:
        return self._files.exists(self._entry(run, number))

    def stage(self, rows: DataFrame) -> str:
        """Write rows where no reader looks yet; the name of their folder."""
        folder = f"rows-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.store}/{folder}")
        return folder

    def commit(self, run: str, number: int, folder: str) -> bool:
        """Make staged rows part of the store; False if the batch was committed before."""
        draft = self._path(f"{self.store}/log/.{run}-{number}-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(bytearray(json.dumps({"rows": folder}).encode()))
        out.close()
        if self.holds(run, number) or not self._files.rename(draft, self._entry(run, number)):
            self._files.delete(draft, False)
            return False
        return True

    def rows(self) -> DataFrame:
        """All rows of committed batches."""
        where = self._path(f"{self.store}/log")
        names = [] if not self._files.exists(where) else [s.getPath().getName() for s in self._files.listStatus(where)]
        entries = [f"{self.store}/log/{n}" for n in sorted(names) if n.endswith(".json") and not n.startswith(".")]
        if not entries:
            return self.spark.createDataFrame([], STORE)
        folders = [json.loads(r["value"])["rows"] for r in self.spark.read.text(entries).collect()]  # a name per batch
        return self.spark.read.schema(STORE).parquet(*[f"{self.store}/{f}" for f in sorted(folders)])


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The tracks of a store, empty before the first batch."""
    return BatchLog(spark, store).rows().where("status = 'ok'")


def new_tracks(
    files: DataFrame, known: DataFrame, engines: Engines, minimum: float = 0.0, root: str | None = None
) -> DataFrame:
    """Analysed rows for content not stored yet; failures and short files are rows with a status."""
    # The bytes are hashed where they are read; only hashes and paths are shuffled to choose among them.
    hashed = files.where(is_audio_path(below(F.col("path"), root))).select(F.sha1("content").alias("hash"), "path", "content")
    narrow = hashed.select("hash", "path").join(known.where(F.col("status") == "ok").select("hash"), "hash", "left_anti")
    once = narrow.groupBy("hash").agg(F.min("path").alias("path"))
    out = analyse(hashed.join(once, ["hash", "path"], "left_semi"), engines).dropDuplicates(["hash"])
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("duration") < minimum, "short").otherwise("ok")
    return out.select(
        "hash", "path", reads.trim_flat(F.col("styles")).alias("styles"), "bpm", "key", "scale",
        music.camelot(F.col("key"), F.col("scale")).alias("camelot"), "duration", status.alias("status"), "error",
    )


def ingest_batch(
    files: DataFrame, store: str, engines: Engines, minimum: float = 0.0, root: str | None = None, run: str | None = None, number: int = 0
) -> None:
    """Add one batch of (path, content) to ``store``: its tracks, and its failures and short files, in one commit.

    A batch of the same ``run`` and ``number`` that is in the store already is left out whole.
    """
    log, run = BatchLog(files.sparkSession, store), run or uuid.uuid4().hex
    if not log.holds(run, number):
        log.commit(run, number, log.stage(new_tracks(files, read_store(files.sparkSession, store), engines, minimum, root)))


def read_skipped(spark: SparkSession, store: str) -> DataFrame:
    """Files that failed or were short, one row per content; empty before the first."""
    return BatchLog(spark, store).rows().where("status <> 'ok'").dropDuplicates(["hash"])


def ingest_report(spark: SparkSession, store: str) -> DataFrame:
    """(status, files, seconds): totals of an ingest: stored, short and failed."""
    kept = read_store(spark, store)
    skipped = read_skipped(spark, store).join(kept.select("hash"), "hash", "left_anti")
    return kept.unionByName(skipped).groupBy("status").agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("duration"), 2).alias("seconds"))


def run_ingest(files: DataFrame, store: str, checkpoint: str, engines: Engines, minimum: float = 0.0, root: str | None = None):
    """Start the ingest of a stream of (path, content). Batches are named by the checkpoint, so a replayed one adds nothing."""
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex
    return (
        files.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: ingest_batch(batch, store, engines, minimum, root, run, number)).start()
    )


def ingest_stream(spark: SparkSession, folder: str, store: str, checkpoint: str, engines: Engines, minimum: float = 0.0):
    """Streaming form of :func:`ingest_batch` over a folder of files. The checkpoint resumes."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = (
        spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1000).load(folder)
    )
    return run_ingest(files, store, checkpoint, engines, minimum, folder)
