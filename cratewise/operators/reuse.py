"""Results kept by what they were worked out from.

A store holds the result rows of a piece of work that is done key by key, and for every
key a digest of its source rows. Unchanged source files are recognised by path, length
and time and not read. Otherwise only keys whose digest changed are worked out again.

    <path>/rows/gen=<n>      rows worked out in run n; never changed later
    <path>/keys/version=<n>  (key, digest, gen) of every key and the stamp; renamed into place last
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage

MOST_GENERATIONS = 16  # beyond it all live rows are written together again


@dataclass(frozen=True)
class Reused:
    """``rows`` of all keys with their ``gen``, the version read, the keys worked out in this call (None: none)."""

    rows: DataFrame
    version: int
    touched: DataFrame | None


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def file_stamp(source: DataFrame, code: str) -> str | None:
    """A digest of the files under ``source``, its columns and ``code``; None when no files are under it.

    Only paths, lengths and times are looked at.
    """
    spark, parts = source.sparkSession, []
    for name in sorted(source.inputFiles()):
        files, _ = _files(spark, name)
        status = files.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name)))
        parts.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    if not parts:
        return None
    return hashlib.sha256("\n".join([code, source.schema.json(), *parts]).encode()).hexdigest()


def key_digests(source: DataFrame, key: str) -> DataFrame:
    """(key, digest) over all rows of each key, whatever their order; combined before the shuffle."""
    columns = [F.col(f"`{c}`") for c in source.columns]
    # Nulls are skipped by the hashes, so a row says where it has them.
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in columns])
    sums = source.select(
        F.col(key), F.xxhash64(nulls, *columns).alias("_a"), F.xxhash64(*columns[::-1], nulls).alias("_b")
    ).groupBy(key).agg(F.sum(F.col("_a").cast("decimal(20,0)")).alias("_s"), F.bit_xor("_b").alias("_x"), F.count(F.lit(1)).alias("_n"))
    return sums.select(key, F.concat_ws(":", "_s", "_x", "_n").alias("digest"))


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, where = _files(spark, f"{path}/keys")
    names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def _open(spark: SparkSession, path: str, version: int, key: str, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys, rows) of a version; rows of generations that a key has left are not among them."""
    keys = spark.read.parquet(f"{path}/keys/version={version}")
    gens = [r[0] for r in keys.select("gen").distinct().orderBy("gen").collect()]  # at most MOST_GENERATIONS
    rows = None
    for gen in gens or [version]:
        part = spark.read.parquet(f"{path}/rows/gen={gen}").withColumn("gen", F.lit(gen))
        rows = part if rows is None else rows.unionByName(part)
    live = keys.select(F.col(key).alias("_key"), F.col("gen").alias("_gen"))
    return keys, rows.join(live, F.col(key).eqNullSafe(F.col("_key")) & (F.col("gen") == F.col("_gen")), "left_semi")


def _stored_stamp(spark: SparkSession, path: str, version: int, code: str) -> str | None:
    found = spark.read.text(f"{path}/keys/version={version}/stamp").first()
    return found[0] if found and found[0].endswith(f" {code}") else None


def reused(source: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], path: str, code: str = "1") -> Reused:
    """What ``work(source)`` gives, worked out again only for keys whose source rows changed.

    ``work`` takes source rows of some keys, whole, and returns rows that hold the key
    column; the rows of a key may depend on that key's source rows only. ``code`` names
    the work and how ``source`` is derived from its files: under another code everything
    is worked out anew.

    * Unchanged files: nothing of the source is read, no job runs over it.
    * New and changed keys are worked out, keys that are gone leave the result, a null key
      is a key like any other, an empty source gives an empty result.
    * A run that dies leaves the last whole version in force. One run goes on at a time.
    * ``source`` must have no column called ``gen``, ``work`` must return none.
    """
    spark = source.sparkSession
    versions = _versions(spark, path)
    last = versions[-1] if versions else None
    stamp = f"{file_stamp(source, code) or 'none'} {code}"
    known = _stored_stamp(spark, path, last, code) if versions else None
    if known == stamp and not stamp.startswith("none "):
        return Reused(_open(spark, path, last, key)[1], last, None)

    version = 0 if last is None else last + 1
    fresh = cut_lineage(key_digests(source, key))
    if known is None:
        keys, touched, wanted = fresh.withColumn("gen", F.lit(version)), fresh.select(key), source
        work(wanted).write.mode("overwrite").parquet(f"{path}/rows/gen={version}")
    else:
        old = spark.read.parquet(f"{path}/keys/version={last}").select(F.col(key).alias("_key"), F.col("digest").alias("_digest"), F.col("gen").alias("_gen"))
        same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
        keys = cut_lineage(fresh.join(old, same, "left").select(key, "digest", F.coalesce("_gen", F.lit(version)).alias("gen")))
        touched = keys.where(F.col("gen") == version).select(key)
        chosen = touched.select(F.col(key).alias("_key"))
        work(source.join(chosen, F.col(key).eqNullSafe(F.col("_key")), "left_semi")).write.mode("overwrite").parquet(f"{path}/rows/gen={version}")
        if keys.select("gen").distinct().count() > MOST_GENERATIONS:
            keys = _together(keys, key, path, version)
    draft = f"{path}/keys-draft-{uuid.uuid4().hex}"
    keys.write.parquet(draft)
    spark.range(1, numPartitions=1).select(F.lit(stamp).alias("value")).write.text(f"{draft}/stamp")
    files, target = _files(spark, f"{path}/keys/version={version}")
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(_files(spark, draft)[1], target):
        raise OSError(f"version {version} of {path} could not be stored")
    return Reused(_open(spark, path, version, key)[1], version, touched)


def _together(keys: DataFrame, key: str, path: str, version: int) -> DataFrame:
    """All live rows written as one generation, above that of this run."""
    spark = keys.sparkSession
    live = keys.select(F.col(key).alias("_key"), F.col("gen").alias("_gen"))
    rows = None
    for (gen,) in keys.select("gen").distinct().collect():
        part = spark.read.parquet(f"{path}/rows/gen={gen}").withColumn("_from", F.lit(gen))
        rows = part if rows is None else rows.unionByName(part)
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_from") == F.col("_gen"))
    whole = cut_lineage(rows.join(live, met, "left_semi").drop("_from"))
    whole.write.mode("overwrite").parquet(f"{path}/rows/gen={version}")
    return keys.withColumn("gen", F.lit(version))
