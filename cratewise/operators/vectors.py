"""Similarity search, centroids and projections."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.guards import BROADCAST_BYTES, fetch_bounded
from ..plans.ranks import nearest_rank, order_stats

MATCH_THRESHOLD = 0.60


def similar_to(tracks: DataFrame, key: str, vec: str, target, k: int = 12) -> DataFrame:
    """The k most similar rows to one row, itself left out, sims to 4 places."""
    k = max(1, min(40, k))
    found = fetch_bounded(tracks.where((F.col(key) == F.lit(target)) & F.col(vec).isNotNull()).select(vec), 1)
    if not found:
        return tracks.select(key).withColumn("sim", F.lit(0.0)).limit(0)
    others = tracks.where((F.col(key) != F.lit(target)) & F.col(vec).isNotNull())
    scored = others.select(key, F.round(V.cosine_to(F.col(vec), found[0][0]), 4).alias("sim"))
    return scored.orderBy(F.desc("sim"), key).limit(k)


def weighted_centroids(members: DataFrame, group: list[str], vec: str, weight: str | None = None) -> DataFrame:
    """``sum(w * v) / sum(|w|)`` per group; a null weight counts 1, a zero total drops the group (A1, A2)."""
    w = F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)
    scaled = members.where(F.col(vec).isNotNull()).select(
        *group, w.alias("_w"),
        array_to_vector(F.transform(vec, lambda x: x.cast("double") * w)).alias("_v"),
    )
    sums = scaled.groupBy(*group).agg(
        Summarizer.sum(F.col("_v")).alias("_s"), F.sum(F.abs("_w")).alias("_t"), F.count(F.lit(1)).alias("members")
    )
    return sums.where(F.col("_t") > 0).select(
        *group, "members", F.transform(vector_to_array("_s"), lambda x: x / F.col("_t")).alias("centroid")
    )


def _score_block(ids: list, names: np.ndarray):
    m = names / np.where(np.linalg.norm(names, axis=1, keepdims=True) > 0, np.linalg.norm(names, axis=1, keepdims=True), 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            e = np.stack(pdf["vec"].to_numpy()).astype(np.float64)
            n = np.linalg.norm(e, axis=1, keepdims=True)
            sims = (e / np.where(n > 0, n, 1.0)) @ m.T
            yield pd.DataFrame({
                "key": np.repeat(pdf["key"].to_numpy(), len(ids)), "target": np.tile(np.asarray(ids, dtype=object), len(pdf)),
                "sim": sims.ravel(),
            })

    return run


def match_centroids(tracks: DataFrame, key: str, vec: str, centroids: DataFrame, name: str, salt: int = 16) -> DataFrame:
    """Every row scored against every centroid, ranked per row, sims to 4 places.

    The centroid table travels to the executors only when its measured size is
    small. Beyond that, both sides meet block by block under a salted equi-join.
    """
    rows = tracks.where(F.col(vec).isNotNull()).select(F.col(key).alias("key"), F.col(vec).alias("vec"))
    kind = tracks.schema[key].dataType.simpleString()
    target_kind = centroids.schema[name].dataType.simpleString()
    n, dim = centroids.agg(F.count(F.lit(1)), F.max(F.size("centroid"))).first()
    schema = f"key {kind}, target {target_kind}, sim double"
    if not n:
        scored = tracks.sparkSession.createDataFrame([], schema)
    elif n * dim * 8 <= BROADCAST_BYTES:
        block = centroids.select(name, "centroid").orderBy(name).collect()
        scored = rows.mapInPandas(_score_block([r[0] for r in block], np.array([r[1] for r in block])), schema)
    else:
        blocks = math.ceil(n * dim * 8 / (8 * 1024 * 1024))
        packed = (
            centroids.withColumn("blk", F.pmod(F.xxhash64(name), F.lit(blocks)))
            .groupBy("blk").agg(F.collect_list(name).alias("ids"), F.collect_list("centroid").alias("cs"))
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        )
        spread = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salt)).cast("int")).withColumn(
            "blk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        )

        def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for _, part in pdf.groupby("blk"):
                    first = part.iloc[0]
                    yield from _score_block(list(first["ids"]), np.stack(first["cs"]))(iter([part[["key", "vec"]]]))

        scored = spread.join(packed, ["blk", "salt"]).mapInPandas(meet, schema)
    order = Window.partitionBy("key").orderBy(F.desc("sim"), "target")
    return scored.withColumn("sim", F.round("sim", 4)).select(
        F.col("key").alias(key), F.col("target").alias(name), "sim", F.row_number().over(order).alias("rank")
    )


def rank_by_centroid(tracks: DataFrame, key: str, vec: str, centroid: list[float], members: DataFrame, threshold: float = MATCH_THRESHOLD) -> DataFrame:
    """Rows at or above the threshold to one centroid, with a membership flag."""
    scored = tracks.where(F.col(vec).isNotNull()).select(key, V.cosine_to(F.col(vec), centroid).alias("sim"))
    kept = scored.where(F.col("sim") >= threshold)
    flags = members.select(key).distinct().withColumn("member", F.lit(True))
    return kept.join(flags, key, "left").select(
        key, F.round("sim", 4).alias("sim"), F.coalesce("member", F.lit(False)).alias("member")
    )


def label_candidates(tracks: DataFrame, key: str, vec: str, labelled: DataFrame, rejected: DataFrame, limit: int = 25) -> DataFrame:
    """Rows nearest to the mean of the labelled ones; labelled and rejected rows never return."""
    limit = max(1, min(200, limit))
    seeds = tracks.join(labelled.select(key).distinct(), key, "left_semi")
    found = weighted_centroids(seeds, [], vec).select("centroid").head(1)
    if not found:
        return tracks.select(key).withColumn("sim", F.lit(0.0)).limit(0)
    pool = tracks.join(labelled.select(key), key, "left_anti").join(rejected.select(key), key, "left_anti")
    scored = pool.where(F.col(vec).isNotNull()).select(key, F.round(V.cosine_to(F.col(vec), found[0][0]), 4).alias("sim"))
    return scored.orderBy(F.desc("sim"), key).limit(limit)


def pca_coords(tracks: DataFrame, key: str, vec: str, components: int = 8) -> DataFrame:
    """Up to eight principal coordinates, each at unit standard deviation."""
    rows = tracks.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    dim, n = rows.agg(F.max(F.size(vector_to_array("v"))), F.count(F.lit(1))).first()
    if not n:
        return tracks.select(key).withColumn("e", F.array().cast("array<double>")).limit(0)
    model = PCA(k=min(components, dim, n), inputCol="v", outputCol="p").fit(rows)
    projected = model.transform(rows).select(key, "p")
    # Projections of uncentred rows differ from centred ones by a constant per component.
    mean, spread = projected.agg(Summarizer.mean(F.col("p")), Summarizer.std(F.col("p"))).first()
    scale = [s * math.sqrt((n - 1) / n) if n > 1 else 0.0 for s in spread.toArray()]
    shift = F.array(*[F.lit(float(x)) for x in mean.toArray()])
    factor = F.array(*[F.lit(float(s) if s > 0 else 1.0) for s in scale])
    centred = F.zip_with(vector_to_array("p"), shift, lambda a, b: a - b)
    return projected.select(key, F.transform(F.zip_with(centred, factor, lambda a, b: a / b), lambda x: F.round(x, 4)).alias("e"))


def group_axes(coords: DataFrame, group: str, vec: str, axes: int = 3, q: float = 0.9) -> DataFrame:
    """Per group the components of highest variance and the q-quantile of |x - mean| on each."""
    tall = coords.where(F.col(vec).isNotNull()).select(group, F.posexplode(vec).alias("component", "x"))
    stats = tall.groupBy(group, "component").agg(F.var_pop("x").alias("variance"), F.avg("x").alias("mean"))
    order = Window.partitionBy(group).orderBy(F.desc("variance"), "component")
    best = stats.withColumn("axis", F.row_number().over(order)).where(F.col("axis") <= axes)
    spread = tall.join(best.select(group, "component", "mean"), [group, "component"]).withColumn("_d", F.abs(F.col("x") - F.col("mean")))
    picks = order_stats(spread, [group, "component"], "_d", {"spread": nearest_rank(q)}, size_out="members")
    return best.join(picks, [group, "component"]).select(group, "axis", "component", "variance", "spread", "members")
