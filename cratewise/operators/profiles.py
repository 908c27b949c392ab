"""Per-genre profiles and groupings."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.ranks import (
    exclusive_decile, exclusive_decile_picks, group_rank, median_picks, nearest_rank, order_stats,
)

# The ratio band of an octave misread, decile minimum, band count, size states.
OCTAVE_BAND = (1.7, 2.3)
DECILE_MIN = 10
BANDS = 5
SOLID_SIZE = 10


def tempo_stats(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(group, n, median, lo, hi, p10, p90) of the positive values, rounded half-even (A4).

    Deciles are the exclusive kind and exist from ten values on; below that they
    are the extremes.
    """
    positive = rows.where(F.col(value) > 0)
    picks = {**median_picks(), **exclusive_decile_picks(1, "_d1"), **exclusive_decile_picks(9, "_d9"),
             "_lo": lambda n: F.lit(1), "_hi": lambda n: n}
    stats = order_stats(positive, group, value, picks, size_out="n")
    n = F.col("n")
    whole = lambda c: F.bround(c, 0).cast("long")
    p = lambda i, edge: F.when(n >= DECILE_MIN, whole(exclusive_decile(i, f"_d{i}", n))).otherwise(whole(edge))
    return stats.select(
        *group, "n", whole((F.col("_med_lo") + F.col("_med_hi")) / 2).alias("median"),
        whole(F.col("_lo")).alias("lo"), whole(F.col("_hi")).alias("hi"),
        p(1, F.col("_lo")).alias("p10"), p(9, F.col("_hi")).alias("p90"),
    )


def octave_flag(median: Column, lo: Column, hi: Column) -> Column:
    """"half" or "double" when the observed median is about an octave off the canonical middle (A5)."""
    mid = (lo + hi) / 2
    valid = (median > 0) & mid.isNotNull() & (mid != 0)
    return (
        F.when(valid & (mid / median).between(*OCTAVE_BAND), "half")
        .when(valid & (median / mid).between(*OCTAVE_BAND), "double")
    )


def top_tracks(tracks: DataFrame, group: list[str], key: str, n: int = 5) -> DataFrame:
    """The n most representative tracks per group: share, then confidence, then key.

    The rank limit is pushed below the shuffle, so a large group sends n rows per task.
    """
    order = Window.partitionBy(*group).orderBy(F.desc("share"), F.desc("confidence"), key)
    return tracks.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def keystone_profile(tracks: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """One row per keystone of (keystone, subgenre, bpm): counts, share, tempo, octave flag (A3)."""
    by_sub = tracks.groupBy("keystone", "subgenre").agg(F.count(F.lit(1)).alias("c"))
    counts = by_sub.groupBy("keystone").agg(
        F.sum("c").alias("count"),
        F.coalesce(F.sum(F.when(F.col("subgenre") == F.col("keystone"), F.col("c"))), F.lit(0)).alias("self_count"),
        F.count_if(F.col("subgenre").isNotNull() & (F.col("subgenre") != F.col("keystone"))).alias("subgenres"),
    )
    total = counts.agg(F.sum("count").alias("t")).select("t").scalar()
    joined = counts.join(tempo_stats(tracks, ["keystone"], "bpm"), "keystone", "left")
    out = joined.withColumn("share", F.bround(F.col("count") / total, 4))
    if canonical is None:
        return out
    flagged = out.join(canonical.select("keystone", F.col("lo").alias("_clo"), F.col("hi").alias("_chi")), "keystone", "left")
    return flagged.withColumn("octave_flag", octave_flag(F.col("median"), F.col("_clo"), F.col("_chi"))).drop("_clo", "_chi")


def subgenre_profile(tracks: DataFrame) -> DataFrame:
    """Count and tempo of every subgenre other than the keystone's own name (A3)."""
    named = tracks.where(F.col("subgenre").isNotNull() & (F.col("subgenre") != F.col("keystone")))
    counts = named.groupBy("keystone", "subgenre").agg(F.count(F.lit(1)).alias("count"))
    return counts.join(tempo_stats(named, ["keystone", "subgenre"], "bpm"), ["keystone", "subgenre"], "left")


def group_rollup(profiles: DataFrame, group: str, order: DataFrame | None = None) -> DataFrame:
    """Totals and shares of a tier above keystones (group, keystone, count).

    ``order`` is (group, position); groups it does not list come last by name.
    """
    totals = profiles.groupBy(group).agg(
        F.sum("count").alias("count"),
        # Bounded by the number of keystones.
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("c"), "keystone"))), lambda e: e["keystone"]), ", ").alias("keystones"),
    )
    grand = profiles.agg(F.sum("count").alias("t")).select("t").scalar()
    out = totals.withColumn("share", F.bround(F.col("count") / grand, 4))
    if order is None:
        return out
    placed = out.join(order.select(group, "position"), group, "left")
    return placed.orderBy(F.col("position").asc_nulls_last(), group)


def majority_parent(tracks: DataFrame, style: str, family: str) -> DataFrame:
    """(style, parent, count): each style's most frequent family, ties to the larger family."""
    pairs = tracks.groupBy(style, family).agg(F.count(F.lit(1)).alias("c"))
    sizes = pairs.groupBy(family).agg(F.sum("c").alias("size"))
    return pairs.join(sizes, family).groupBy(style).agg(
        F.max_by(family, F.struct("c", "size", family)).alias("parent"), F.sum("c").alias("count")
    )


def tree_groups(tracks: DataFrame, style: str, family: str) -> DataFrame:
    """(parent, count, self_count, leaves) after every style hangs under one parent."""
    return majority_parent(tracks, style, family).groupBy("parent").agg(
        F.sum("count").alias("count"),
        F.coalesce(F.sum(F.when(F.col(style) == F.col("parent"), F.col("count"))), F.lit(0)).alias("self_count"),
        F.count_if(F.col(style) != F.col("parent")).alias("leaves"),
    )


def membership_counts(tracks: DataFrame, keystones: str) -> DataFrame:
    """(keystone, count): a fusion counts under each of its keystones."""
    return tracks.select(F.explode(keystones).alias("keystone")).groupBy("keystone").agg(F.count(F.lit(1)).alias("count"))


def size_state(count: Column) -> Column:
    """empty, growing (below ten) or solid."""
    return F.when(F.coalesce(count, F.lit(0)) == 0, "empty").when(count < SOLID_SIZE, "growing").otherwise("solid")


def summary_card(groups: DataFrame, name: str) -> DataFrame:
    """One row of totals over (name, count, description)."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"), F.sum("count").alias("members"),
        F.max("count").alias("largest_count"),
        F.count_if(F.trim(F.coalesce("description", F.lit(""))) != "").alias("described"),
        F.min_by(name, F.struct((-F.col("count")).alias("c"), F.col(name))).alias("largest"),
    ).withColumn("largest_share", F.round(F.coalesce(F.try_divide("largest_count", "members"), F.lit(0.0)), 4))


def affinity(edges: DataFrame, nodes: DataFrame, key: str, group: str) -> DataFrame:
    """(ga, gb, bond): summed similarity of the edges between two groups."""
    side = lambda end, out: nodes.select(F.col(key).alias(end), F.col(group).alias(out))
    joined = edges.join(side("a", "x"), "a").join(side("b", "y"), "b").where(F.col("x") != F.col("y"))
    return joined.groupBy(F.least("x", "y").alias("ga"), F.greatest("x", "y").alias("gb")).agg(
        F.round(F.sum(F.coalesce("sim", F.lit(0.75))), 6).alias("bond")
    )


def first_membership(members: DataFrame, key: str, name: str) -> DataFrame:
    """Each track's first group by name."""
    return members.groupBy(key).agg(F.min(name).alias(name))


def quantile_bands(rows: DataFrame, keys: list[str], value: str, cuts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """``rows`` plus ``band`` 0..4: how many nearest-rank cuts lie below the value."""
    picks = {f"_c{i}": nearest_rank(q) for i, q in enumerate(cuts)}
    bounds = order_stats(rows.where(F.col(value) > 0), keys, value, picks, size_out="_n").drop("_n")
    if keys:
        joined = rows.join(bounds, keys, "left")
    else:
        packed = bounds.select(F.struct(*picks).alias("c")).scalar()
        joined = rows.withColumn("_c", packed).select("*", "_c.*").drop("_c")
    v = F.coalesce(F.col(value), F.lit(0))
    band = sum((F.coalesce((v > F.coalesce(F.col(c), F.lit(0))).cast("int"), F.lit(0)) for c in picks), F.lit(0))
    return joined.withColumn("band", band).drop(*picks)


def band_labels(banded: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(band, count, label) with the rounded tempo range of each band."""
    return banded.groupBy(*keys, "band").agg(
        F.count(F.lit(1)).alias("count"),
        F.concat(F.floor(F.min(F.when(F.col(value) > 0, F.col(value))) + 0.5).cast("string"), F.lit("-"),
                 F.floor(F.max(value) + 0.5).cast("string")).alias("label"),
    )


def similarity_bands(rows: DataFrame, group: str, key: str, vec: str, bands: int = BANDS) -> DataFrame:
    """(key, group, sim, band): similarity to the group's own mean cut into equal ranks."""
    live = rows.where(F.col(vec).isNotNull())
    means = live.select(group, array_to_vector(F.col(vec).cast("array<double>")).alias("v")).groupBy(group).agg(
        Summarizer.mean(F.col("v")).alias("m")
    ).select(group, vector_to_array("m").alias("_mean"))
    scored = rows.join(means, group, "left").withColumn(
        "sim", F.coalesce(F.round(V.cosine(F.col(vec), F.col("_mean")), 9), F.lit(0.0))
    )
    ranked = group_rank(scored.select(key, group, "sim"), [group], [-F.col("sim"), F.col(key)], size_out="_n")
    band = F.least(F.lit(bands - 1), F.floor((F.col("rank") - 1) / (F.col("_n") / bands)).cast("int"))
    return ranked.withColumn("band", band).drop("_n")


def group_value(kind: str) -> Column:
    """Grouping value of a listing row: tempo decade, key text or the column itself (L2)."""
    if kind == "bpm_band":
        return F.when(F.col("bpm").isNotNull(), (F.floor(F.col("bpm") / 10) * 10).cast("string"))
    return F.coalesce(F.col(kind).cast("string"), F.lit(""))


def group_label(kind: str) -> Column:
    if kind == "bpm_band":
        low = (F.floor(F.col("bpm") / 10) * 10).cast("long")
        return F.when(low.isNull(), "no BPM").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string"), F.lit(" BPM")))
    return F.coalesce(F.nullif(F.col(kind).cast("string"), F.lit("")), F.lit("(none)"))


def grouped_listing(tracks: DataFrame, kind: str) -> DataFrame:
    """(label, count) of a listing grouped by genre, key, camelot, artist or tempo decade (L2)."""
    return tracks.groupBy(group_label(kind).alias("label")).agg(F.count(F.lit(1)).alias("count"))


def sort_listing(tracks: DataFrame, column: str, descending: bool = False, group: str | None = None) -> DataFrame:
    """Library order: the group ascending (no tempo last), then the column, text without case (L1)."""
    kind = dict(tracks.dtypes)[column]
    value = F.lower(F.coalesce(F.col(column), F.lit(""))) if kind == "string" else F.coalesce(F.col(column), F.lit(0))
    order = [value.desc() if descending else value.asc()]
    if group == "bpm_band":
        order.insert(0, F.floor(F.col("bpm") / 10).asc_nulls_last())
    elif group:
        order.insert(0, F.lower(group_value(group)).asc())
    return tracks.orderBy(*order)
