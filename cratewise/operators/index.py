"""A stored index of vectors: built once, appended to, asked many times.

Vectors lie under pivots. A cell's blocks are files of its own folder, its radius and
size stand in the version's record. A question opens the nearest cells first; with the
k-th answer found there as a floor, only cells that the angles cannot rule out follow,
so answers are exact and other files are never read.

    <path>/blocks-<id>/cell=<n>/...   one folder per build or append
    <path>/versions/<number>          which folders belong to it; written last
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.guards import cut_lineage
from .grouped import best_of_cells
from .knn import BLOCK_BYTES, BOUNDS, MAX_CELLS, NEIGHBOURS, PROBES, _ANGLE_SLACK, _assign, _best, neighbour_verdict

QUERY_ROWS = 1024
FORMAT = 2  # of the stored files; part of a path that is named by content


@dataclass
class VectorIndex:
    """One version of an index; see :func:`build_index` and :func:`open_index`."""

    spark: SparkSession
    path: str
    version: int
    folders: list[str]
    pivots: np.ndarray  # (cells, dim); at most MAX_CELLS
    radius: np.ndarray  # -1 for an empty cell
    rows: np.ndarray
    kind: str  # type of the key
    eps: float | None

    def stored(self, cells: list[int]) -> DataFrame:
        """(cell, keys, unit) of the vectors of some cells; the folders of others are not opened."""
        schema = f"keys array<{self.kind}>, units array<double>, cell int"
        out = None
        for folder in self.folders:
            part = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}").where(F.col("cell").isin(cells))
            out = part if out is None else out.unionByName(part)
        dim = self.pivots.shape[1]
        return out.select("cell", "units", F.posexplode("keys").alias("at", "key")).select(
            "cell", F.array("key").alias("keys"), F.slice("units", F.col("at") * dim + 1, dim).alias("unit")
        )

    def append(self, tracks: DataFrame, key: str, vec: str) -> VectorIndex:
        """The next version, with ``tracks`` added; this one stays readable."""
        folder, stats = _write_blocks(tracks, key, vec, self)
        radius, rows = self.radius.copy(), self.rows.copy()
        for cell, n, angle in stats:
            radius[cell], rows[cell] = max(radius[cell], angle), rows[cell] + n
        return _record(VectorIndex(self.spark, self.path, self.version + 1, [*self.folders, folder], self.pivots, radius, rows, self.kind, self.eps))

    def nearest(self, asked: DataFrame, key: str, vec: str, k: int, others: bool = False) -> DataFrame:
        """(key, rank, neighbour, sim): the ``k`` stored vectors nearest to each asked one, by cosine, ties to the smaller key.

        With ``others`` a stored vector of the asked one's own key is no answer. Null
        vectors and an empty index give no rows.
        """
        live = self.radius >= 0
        if not live.any():
            kind = dict(asked.dtypes)[key]
            return self.spark.createDataFrame([], f"{key} {kind}, rank int, neighbour {self.kind}, sim double")
        pivots, radius, most = self.pivots, self.radius, k + 1 if others else k

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    sims = np.where(live, np.stack(pdf["unit"].to_numpy()) @ pivots.T, -np.inf)
                    first = np.argsort(-sims, axis=1, kind="stable")[:, : min(PROBES, int(live.sum()))]
                    yield pd.DataFrame({"vid": pdf["vid"], "unit": pdf["unit"], "own": first[:, 0].astype(np.int32), "cells": list(first.astype(np.int32))})

        rows = asked.where(F.col(vec).isNotNull()).select(F.col(key).cast("string").alias("vid"), F.col(key).alias("_key"), V.unit(vec, self.eps).alias("unit"))
        rows = cut_lineage(rows)
        placed = cut_lineage(rows.select("vid", "unit").mapInPandas(near, "vid string, unit array<double>, own int, cells array<int>"))
        # Blocks of asked vectors by their nearest cell; at most MAX_CELLS counts.
        counts = sorted((r["own"], math.ceil(r["count"] / QUERY_ROWS)) for r in placed.groupBy("own").count().collect())
        begins = np.cumsum([0] + [subs for _, subs in counts])
        dim = self.spark.createDataFrame([(own, subs, int(at)) for (own, subs), at in zip(counts, begins)], "own int, subs int, start long")
        blocked = placed.join(F.broadcast(dim), "own").withColumn("ord", F.col("start") + F.pmod(F.xxhash64("vid"), F.col("subs")))
        meet = lambda pairs: self._met(blocked.select("ord", "vid", "unit"), pairs, int(begins[-1]), most)
        near_pairs = blocked.select("ord", F.explode("cells").alias("cell")).distinct()
        first = cut_lineage(meet(near_pairs))
        floor = _best(first, most).groupBy("vid").agg(F.when(F.count("*") >= most, F.min("sim")).otherwise(-1.0).alias("floor"))

        def open_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    angles = np.arccos(np.clip(np.stack(pdf["unit"].to_numpy()) @ pivots.T, -1.0, 1.0))
                    closest = np.maximum(angles - radius[None, :] - _ANGLE_SLACK, 0.0)
                    wanted = (np.cos(closest) >= pdf["floor"].to_numpy()[:, None] - 1e-9) & live
                    for at, rows in pdf.groupby("ord").indices.items():
                        yield pd.DataFrame({"ord": at, "cell": np.nonzero(wanted[rows].any(axis=0))[0].astype(np.int32)})

        more = blocked.select("vid", "unit", "ord").join(floor, "vid").mapInPandas(open_, "ord long, cell int").distinct()
        more = cut_lineage(more.join(near_pairs, ["ord", "cell"], "left_anti"))
        hits = first.unionByName(meet(more)) if not more.isEmpty() else first
        best = _best(hits, most).join(rows.select("vid", "_key").distinct(), "vid")
        if others:
            best = best.where(F.col("neighbour") != F.col("_key"))
        ranked = best.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "sim"))).alias("near"))
        return ranked.select(F.col("_key").alias(key), F.posexplode(F.slice("near", 1, k)).alias("rank", "e")).select(
            key, (F.col("rank") + 1).alias("rank"), "e.neighbour", "e.sim"
        )

    def _met(self, asked: DataFrame, pairs: DataFrame, blocks: int, k: int) -> DataFrame:
        """Hits of the asked blocks (ord, vid, unit) in the cells of (ord, cell)."""
        cells = [r[0] for r in pairs.select("cell").distinct().collect()]  # at most MAX_CELLS numbers
        stored = self.stored(cells)
        kind = stored.schema["keys"].dataType.elementType
        return best_of_cells(asked, pairs, stored, blocks, QUERY_ROWS, self.pivots.shape[1], k, kind)


def _write_blocks(tracks: DataFrame, key: str, vec: str, index: VectorIndex) -> tuple[str, list[tuple]]:
    """A folder of blocks of ``tracks``, and (cell, rows, radius) of the cells it has."""
    units = tracks.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), V.unit(vec, index.eps).alias("unit"))
    filed = cut_lineage(units.withColumn("at", _assign(index.pivots)("unit")).select("key", "unit", "at.cell", "at.angle"))
    size = max(64, BLOCK_BYTES // (8 * max(index.pivots.shape[1], 1)))
    counts = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("angle"))
    parts = counts.select("cell", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    cut = filed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))  # at most MAX_CELLS rows
    blocks = cut.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("key", "unit"))).alias("b"))
    folder = f"blocks-{uuid.uuid4().hex}"
    blocks.select(F.col("b.key").alias("keys"), F.flatten("b.unit").alias("units"), "cell").write.partitionBy("cell").parquet(f"{index.path}/{folder}")
    return folder, [tuple(r) for r in counts.collect()]


def _record(index: VectorIndex) -> VectorIndex:
    """Write the version's record; it fails if another writer was first."""
    cells = [(c.tolist(), float(r), int(n)) for c, r, n in zip(index.pivots, index.radius, index.rows, strict=True)]
    row = [(index.folders, cells, index.kind, index.eps)]
    schema = "folders array<string>, cells array<struct<center:array<double>,radius:double,rows:bigint>>, kind string, eps double"
    index.spark.createDataFrame(row, schema).coalesce(1).write.parquet(f"{index.path}/versions/{index.version:06d}")
    return index


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the index at ``path`` that are written whole."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return []
    done = lambda p: files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
    return sorted(int(s.getPath().getName()) for s in files.listStatus(where) if done(s.getPath()))


def open_index(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex | None:
    """The index stored at ``path`` in its latest or a given ``version``; None if there is none."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        return None
    version = known[-1] if version is None else version
    row = spark.read.parquet(f"{path}/versions/{version:06d}").first()
    cells = row["cells"]
    return VectorIndex(
        spark, path, version, list(row["folders"]), np.array([c["center"] for c in cells], dtype=np.float64).reshape(len(cells), len(cells[0]["center"]) if cells else 0),
        np.array([c["radius"] for c in cells]), np.array([c["rows"] for c in cells]), row["kind"], row["eps"],
    )


def build_index(tracks: DataFrame, key: str, vec: str, path: str, cells: int | None = None, eps: float | None = None) -> VectorIndex:
    """Store an index of ``tracks`` (key, vec) at ``path`` as version 1. Null vectors are left out.

    ``cells`` pivots are picked by a hash of their keys; by default about the root of the
    number of rows, at most MAX_CELLS.
    """
    spark = tracks.sparkSession
    rows = tracks.where(F.col(vec).isNotNull()).select(key, vec)
    n = rows.count()
    cells = min(cells or max(1, math.isqrt(n)), MAX_CELLS)
    seed = rows.orderBy(F.xxhash64(key), key).limit(cells).select(vec).collect()
    pivots = np.array([r[0] for r in seed], dtype=np.float64).reshape(len(seed), len(seed[0][0]) if seed else 0)
    norm = np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots = pivots / np.where(norm > 0, norm, 1.0)
    index = VectorIndex(spark, path, 1, [], pivots, np.full(len(pivots), -1.0), np.zeros(len(pivots), dtype=np.int64), dict(tracks.dtypes)[key], eps)
    if len(pivots):
        folder, stats = _write_blocks(rows, key, vec, index)
        index.folders = [folder]
        for cell, count, angle in stats:
            index.radius[cell], index.rows[cell] = angle, count
    return _record(index)


def check_outside(index: VectorIndex, asked: DataFrame, styles: DataFrame, key: str, vec: str, k: int = NEIGHBOURS, others: bool = False, bounds=BOUNDS) -> DataFrame:
    """What the stored neighbours say about each of ``asked`` (key, vec, style, family, confidence).

    ``styles`` is (key, style, family) of the stored tracks. A vector with fewer than
    three stored neighbours has no verdict.
    """
    near = cut_lineage(index.nearest(asked, key, vec, k, others))
    enough = near.groupBy(key).agg(F.count("*").alias("n")).where("n >= 3").select(key)
    return neighbour_verdict(near.join(enough, key), asked.drop(vec), styles, key, bounds)
