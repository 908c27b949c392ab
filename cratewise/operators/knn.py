"""k-nearest-neighbour joins, the similarity graph and the misread audit.

Exact kNN is all-against-all work, so the plan is built to prune it and to spread
what is left evenly:

* equal vectors are collapsed first and carry only their ``k + 1`` smallest keys,
  which is all that any top-k can use, so a large group of copies costs one row;
* vectors are filed under their nearest pivot, and every cell is cut into blocks of
  bounded size by hash, so a crowded cell is many blocks;
* round one compares each block with its nearest cells. Round two visits only the
  cells that the triangle inequality on angles cannot rule out. Skipping none of
  those keeps the result exact;
* blocks are asked in groups (see :mod:`grouped`): a group holds its blocks' k best and
  the rows of the cells they want stream through it; pairs of rows never leave the task.

``mode="ivf"`` stops after round one: approximate. Without a given number of ``probes``
it compares a sample with everything and searches as many cells as hold SAMPLE_RECALL of
the sample's neighbours: few where there are clusters, nearly all where there are none.
``mode="lsh"`` files vectors under signed random projections instead (see :mod:`lsh`).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.guards import cut_lineage
from .grouped import best_of_cells, top as _top
from .lsh import lsh_vectors

MAX_CELLS = 4096
BLOCK_BYTES = 4 * 1024 * 1024
# Cells of round one in exact mode, and how ivf chooses its own: rows sampled, share to find (0.9 and a margin).
PROBES = 4
SAMPLE = 256
SAMPLE_RECALL = 0.95
# Fixed values of the misread rule.
CONF_MAX = 0.55
AGREE_MIN = 0.60
SIM_MIN = 0.80
NEIGHBOURS = 8
_ANGLE_SLACK = 1e-6


def _distinct_vectors(df: DataFrame, key: str, vec: str, k: int, eps: float | None) -> tuple[DataFrame, DataFrame]:
    """(members: key -> vid) and (one row per distinct vector with its k+1 smallest keys)."""
    rows = df.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    # Two independent 64-bit hashes, so that distinct vectors do not share an id.
    members = rows.withColumn("vid", F.concat(F.hex(F.xxhash64("vec")), F.hex(F.xxhash64(F.lit(7), "vec"))))
    first = Window.partitionBy("vid", "vec").orderBy("key")
    lead = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    reps = lead.groupBy("vid", "vec").agg(F.sort_array(F.collect_list("key")).alias("keys"))
    return members, reps.withColumn("unit", V.unit("vec", eps)).drop("vec")


def _assign(pivots: np.ndarray):
    """Arrow UDF to (cell, angle to the cell's pivot)."""

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest(unit: pd.Series) -> pd.DataFrame:
        m = np.stack(unit.to_numpy()) if len(unit) else np.zeros((0, pivots.shape[1]))
        sims = m @ pivots.T
        cell = sims.argmax(axis=1)
        best = np.clip(sims[np.arange(len(m)), cell], -1.0, 1.0)
        return pd.DataFrame({"cell": cell.astype(np.int32), "angle": np.arccos(best)})

    return nearest


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vid").orderBy(F.desc("sim"), "neighbour")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def _enough_probes(filed: DataFrame, order: np.ndarray, k: int) -> int:
    """The least number of cells, by ``order``, that hold SAMPLE_RECALL of a sample's k nearest vectors."""
    rows = filed.orderBy(F.xxhash64(F.lit(11), "vid"), "vid").limit(SAMPLE).select("cell", "unit").collect()
    if not rows:
        return 1
    asked = np.array([r["unit"] for r in rows], dtype=np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                sims = asked @ np.stack(pdf["unit"].to_numpy()).T
                qi, ci = _top(sims, k)
                yield pd.DataFrame({"q": qi.astype(np.int32), "sim": sims[qi, ci], "cell": pdf["cell"].to_numpy()[ci]})

    hits = filed.select("unit", "cell").mapInPandas(nearest, "q int, sim double, cell int")
    best = Window.partitionBy("q").orderBy(F.desc("sim"), "cell")
    found = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).select("q", "cell").collect()
    place = np.argsort(order, axis=1)
    at = np.sort([place[rows[h["q"]]["cell"], h["cell"]] for h in found])
    return int(at[math.ceil(SAMPLE_RECALL * len(at)) - 1]) + 1


def knn_vectors(
    reps: DataFrame, n: int, dim: int, k: int, mode: str = "exact", probes: int | None = None,
    cells: int | None = None, block_rows: int | None = None,
) -> DataFrame:
    """(vid, neighbour, sim, n): the k nearest keys of every distinct vector, its own included.

    ``n`` and ``dim`` are the number of rows (an upper bound will do) and of dimensions.
    """
    block_rows = block_rows or max(64, min(2048, BLOCK_BYTES // (8 * dim)))
    cells = cells or max(1, min(MAX_CELLS, math.ceil(n / block_rows)))
    spark = reps.sparkSession
    if cells == 1:
        pivots, radius = np.zeros((1, dim)), np.zeros(1)
        subs = np.array([max(1, math.ceil(n / block_rows))], dtype=np.int64)
        filed = reps.select("vid", "keys", "unit").withColumn("cell", F.lit(0))
    else:
        reps = cut_lineage(reps)  # read for the pivots, their statistics and the blocks
        # At most MAX_CELLS rows reach the driver, by a choice that depends on the data alone.
        seed = reps.orderBy(F.xxhash64("vid"), "vid").limit(cells).select("unit").collect()
        pivots = np.array([r["unit"] for r in seed], dtype=np.float64)
        norms = np.linalg.norm(pivots, axis=1, keepdims=True)
        pivots = pivots / np.where(norms > 0, norms, 1.0)
        subs, radius = np.ones(len(pivots), dtype=np.int64), np.full(len(pivots), -1.0)
        filed = (
            reps.select("vid", "keys", "unit").withColumn("at", _assign(pivots)("unit"))
            .select("vid", "keys", "unit", "at.cell", "at.angle")
        )
        stats = filed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))
        for row in stats.collect():
            subs[row["cell"]], radius[row["cell"]] = math.ceil(row["rows"] / block_rows), row["radius"]
    starts = np.cumsum(np.where(radius >= 0, subs, 0)) - np.where(radius >= 0, subs, 0)
    used = [(int(i), int(subs[i]), int(starts[i])) for i in range(len(subs)) if radius[i] >= 0]
    sub_dim = F.broadcast(spark.createDataFrame(used, "cell int, subs int, start long"))  # at most MAX_CELLS rows
    filed = filed.join(sub_dim, "cell")
    filed = filed.withColumn("ord", F.col("start") + F.pmod(F.xxhash64("vid"), F.col("subs"))).drop("subs", "start")
    blocks, kind = sum(u[1] for u in used), filed.schema["keys"].dataType.elementType
    compare = lambda pairs: best_of_cells(
        filed.select("ord", "vid", "unit"), pairs, filed.select("cell", "keys", "unit"), blocks, block_rows, dim, k, kind
    )
    alike = pivots @ pivots.T
    np.fill_diagonal(alike, np.inf)  # a cell is its own nearest
    order = np.argsort(-alike, axis=1)
    if probes is None:
        probes = _enough_probes(filed, order, k) if mode == "ivf" and len(pivots) > 1 else PROBES
    near = order[:, : max(1, probes)]

    full = {u[0] for u in used}
    near_dim = spark.createDataFrame(
        [(i, [int(c) for c in dict.fromkeys(near[i]) if c in full]) for i in full], "cell int, near array<int>"
    )
    ids = filed.select("cell", "ord").distinct()
    first = compare(ids.join(F.broadcast(near_dim), "cell").select("ord", F.explode("near").alias("cell")))
    if mode == "ivf" or len(pivots) <= probes:
        return _best(first, k)

    first = cut_lineage(first)  # both the floors and the final choice read it
    floor = _best(first, k).groupBy("vid").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("sim")).otherwise(-1.0).alias("floor")
    )

    def needed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            angles = np.arccos(np.clip(np.stack(pdf["unit"].to_numpy()) @ pivots.T, -1.0, 1.0))
            closest = np.maximum(angles - radius[None, :] - _ANGLE_SLACK, 0.0)
            wanted = (np.cos(closest) >= pdf["floor"].to_numpy()[:, None] - 1e-9) & (radius[None, :] >= 0)
            for (cell, at), rows in pdf.groupby(["cell", "ord"]).indices.items():
                targets = np.setdiff1d(np.nonzero(wanted[rows].any(axis=0))[0], near[cell])
                yield pd.DataFrame({"ord": at, "cell": targets.astype(np.int32)})

    more = (
        filed.select("vid", "unit", "cell", "ord").join(floor, "vid").drop("vid")
        .mapInPandas(needed, "ord long, cell int").distinct()
    )
    return _best(first.unionByName(compare(more)), k)


def knn_join(
    df: DataFrame, key: str, vec: str, k: int, mode: str = "exact", eps: float | None = None, **options
) -> DataFrame:
    """(key, rank, neighbour, sim): the k nearest other rows by cosine, ties to the smaller key."""
    members, reps = _distinct_vectors(df, key, vec, k, eps)
    size = df.where(F.col(vec).isNotNull()).select(F.size(vec)).head(1)
    n, dim = (df.count(), size[0][0]) if size else (0, 1)
    hits = lsh_vectors(reps, n, dim, k + 1, **options) if mode == "lsh" else knn_vectors(reps, n, dim, k + 1, mode, **options)
    near = hits.groupBy("vid").agg(F.sort_array(F.collect_list(F.struct("n", "neighbour", "sim"))).alias("near"))
    others = F.slice(F.filter("near", lambda e: e["neighbour"] != F.col("key")), 1, k)
    return (
        members.select("key", "vid").join(near, "vid")
        .select("key", F.posexplode(others).alias("rank", "e"))
        .select(F.col("key").alias(key), (F.col("rank") + 1).alias("rank"), F.col("e.neighbour").alias("neighbour"), F.col("e.sim").alias("sim"))
    )


def recall(exact: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(asked, recall): the share of the exact neighbours that an approximate join found."""
    hits = found.select(key, "neighbour", F.lit(1).alias("_hit"))
    return exact.join(hits, [key, "neighbour"], "left").agg(
        F.count(F.lit(1)).alias("asked"), F.round(F.coalesce(F.try_divide(F.count("_hit"), F.count(F.lit(1))), F.lit(1.0)), 4).alias("recall")
    )


def similarity_graph(neighbours: DataFrame, key: str) -> DataFrame:
    """Undirected edges (a, b, sim) from a kNN table: positive sims, each pair once."""
    edges = neighbours.where(F.col("sim") > 0).select(
        F.least(key, "neighbour").alias("a"), F.greatest(key, "neighbour").alias("b"), "sim"
    )
    return edges.groupBy("a", "b").agg(F.round(F.max("sim"), 3).alias("sim"))


BOUNDS = (CONF_MAX, AGREE_MIN, SIM_MIN)


def neighbour_verdict(
    neighbours: DataFrame, own: DataFrame, styles: DataFrame, key: str, bounds: tuple[float, float, float] = BOUNDS
) -> DataFrame:
    """Vote of a kNN table on each row's family.

    ``own`` is (key, style, family, confidence), ``styles`` is (key, style, family)
    of every row. Sims at or below zero do not vote. Ties go to the family met first.
    """
    votes = neighbours.join(
        styles.select(F.col(key).alias("neighbour"), F.col("style").alias("nstyle"), F.col("family").alias("nfamily")), "neighbour"
    )
    live = votes.where(F.col("sim") > 0)
    by_style = live.groupBy(key, "nfamily", "nstyle").agg(F.sum("sim").alias("w"), F.min("rank").alias("r"))
    by_family = by_style.groupBy(key, "nfamily").agg(
        F.sum("w").alias("fw"), F.min("r").alias("fr"),
        F.max_by("nstyle", F.struct("w", -F.col("r"))).alias("best_style"),
    )
    verdict = by_family.groupBy(key).agg(
        F.max_by(F.struct("nfamily", "best_style", "fw"), F.struct("fw", -F.col("fr"))).alias("win"), F.sum("fw").alias("total")
    )
    top = neighbours.groupBy(key).agg(F.max("sim").alias("top"))
    agree = F.col("win.fw") / F.col("total")
    return own.join(verdict, key).join(top, key).select(
        key, "style", "family",
        F.bround("confidence", 3).alias("confidence"),
        F.col("win.nfamily").alias("suggested_family"),
        F.col("win.best_style").alias("suggested_style"),
        F.bround(agree, 3).alias("agreement"),
        F.bround("top", 3).alias("top_sim"),
        (
            (F.col("confidence") < bounds[0]) & (F.col("win.nfamily") != F.col("family"))
            & (agree >= bounds[1]) & (F.col("top") >= bounds[2])
        ).alias("flag"),
    )


def misread_audit(
    tracks: DataFrame, key: str, vec: str, k: int = NEIGHBOURS, bounds: tuple[float, float, float] = BOUNDS, **options
) -> DataFrame:
    """Flagged tracks of (key, vec, style, family, confidence); nothing below four rows."""
    enough = tracks.where(F.col(vec).isNotNull()).limit(4).agg((F.count(F.lit(1)) >= 4).alias("ok")).select("ok").scalar()
    near = knn_join(tracks, key, vec, k, eps=1e-9, **options)
    verdict = neighbour_verdict(near, tracks.drop(vec), tracks.select(key, "style", "family"), key, bounds)
    return verdict.where("flag").where(enough).orderBy("confidence", key)


def check_one(vector: list[float], style: str, family: str, confidence: float, tracks: DataFrame, key: str, vec: str, k: int = NEIGHBOURS) -> DataFrame:
    """The verdict on one vector outside the table; empty with fewer than three rows."""
    near = (
        tracks.where(F.col(vec).isNotNull())
        .select(F.col(key).alias("neighbour"), V.cosine_to(F.col(vec), vector).alias("sim"))
        .orderBy(F.desc("sim"), "neighbour").limit(k)
    )
    enough = tracks.where(F.col(vec).isNotNull()).limit(3).agg((F.count(F.lit(1)) >= 3).alias("ok")).select("ok").scalar()
    ranked = near.select(
        F.lit("query").alias(key), F.row_number().over(Window.orderBy(F.desc("sim"), "neighbour")).alias("rank"), "neighbour", "sim"
    ).where(enough)
    own = tracks.sparkSession.createDataFrame([("query", style, family, float(confidence))], f"{key} string, style string, family string, confidence double")
    return neighbour_verdict(ranked, own, tracks.select(key, "style", "family"), key)
