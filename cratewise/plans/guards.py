"""Size-checked broadcasting, lineage cuts and small bounded fetches."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

# Largest side that is ever shipped whole to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024


_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: what ``spark.checkpoint.dir`` names.

    Only a local session without that setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="cratewise-checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    One job, unlike an eager checkpoint, and a lost executor re-reads files
    instead of replaying every earlier round.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/cratewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`cut_lineage` wrote and nothing will read again.

    Call it when what was worked out from them is itself written; other frames are left alone.
    """
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fetch_bounded(df: DataFrame, limit: int) -> list | None:
    """All rows of ``df`` when there are at most ``limit``, else None.

    At most ``limit + 1`` rows ever travel, whatever the size of the table.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None
