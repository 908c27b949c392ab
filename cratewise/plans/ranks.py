"""Exact ranks and order statistics that never sort one huge group in one task.

A plain ``row_number() over (partition by group order by ...)`` puts a whole
group in one task, which fails once a single genre holds a third of a library.
Here groups are counted first (one combined count over the key columns). When the
largest fits a task, the plan is one window. Otherwise large groups are cut into
ranges by splitters from a bottom-k-by-hash sample, which depends on the data
alone, so a recomputed task sees the same ranges. Counts per range give each
range's offset, and only rows of one range are sorted together. Both ways are exact.

What is broadcast has a fixed bound: a group is cut only when it also holds more
than 1/10 000 of all rows, so there are fewer than 10 000 of them, each with at
most 64 splitters and 64 offsets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64
_STEP = 8  # splitters are searched in two steps of eight
LARGE_GROUP = 2_000_000
MAX_LARGE = 10_000


def _cut_large(rows: DataFrame, keys: list[str], weight: Column, ranges: int, large: int) -> DataFrame:
    """Add ``_range``, ``_off`` and ``_total`` (null for an uncut group) to rows with ``_ord``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_c"), F.sum(weight).alias("_total"))
    most, total = sizes.agg(F.max("_c"), F.sum("_c")).first()
    limit = max(large, (total or 0) / MAX_LARGE)
    if (most or 0) <= limit:
        none = F.lit(None).cast("long")
        return rows.withColumns({"_range": F.lit(0), "_off": none, "_total": none})
    hot = sizes.where(F.col("_c") > limit).select(*keys, "_total")
    pick = Window.partitionBy(*keys).orderBy("_h", "_ord")
    sample = (
        rows.join(F.broadcast(hot.select(*keys)), keys).select(*keys, "_ord", F.xxhash64("_ord").alias("_h"))
        .withColumn("_n", F.row_number().over(pick)).where(F.col("_n") < ranges)
    )
    splits = sample.groupBy(*keys).agg(F.sort_array(F.collect_list("_ord")).alias("_fine"))
    coarse = F.filter("_fine", lambda s, i: i % _STEP == _STEP - 1)
    cuts = hot.join(F.broadcast(splits.withColumn("_coarse", coarse)), keys)
    below = lambda s: s < F.col("_ord")
    found = rows.join(F.broadcast(cuts), keys, "left").withColumn("_at", F.size(F.filter("_coarse", below)) * _STEP)
    ranged = found.withColumn("_range", F.when(F.col("_fine").isNull(), 0).otherwise(
        F.col("_at") + F.size(F.filter(F.slice("_fine", F.col("_at") + 1, _STEP - 1), below))
    ))
    counts = ranged.where(F.col("_fine").isNotNull()).groupBy(*keys, "_range").agg(F.sum(weight).alias("_c"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_range", F.sum("_c").over(before).alias("_off"))
    return ranged.drop("_fine", "_coarse", "_at").join(F.broadcast(offsets), [*keys, "_range"], "left")


def group_rank(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    out: str = "rank",
    size_out: str | None = None,
    ranges: int = RANGES,
    large: int = LARGE_GROUP,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """``df`` plus the exact 1-based rank of each row within its group.

    ``order`` sorts ascending and should end in a unique column. ``size_out``
    names an optional column for the group size. No keys means one group. ``sizes_from``
    is a cheap table with the key columns and at least as many rows of every group, such
    as the raw table under a join: when its groups are all small, ``df`` is not counted.
    """
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    rows = rows.withColumn("_ord", F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    if sizes_from is not None and keys and (sizes_from.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= large:
        none = F.lit(None).cast("long")
        cut = rows.withColumns({"_range": F.lit(0), "_off": none, "_total": none})
    else:
        cut = _cut_large(rows, by, F.lit(1), ranges, large)
    part = Window.partitionBy(*by, "_range")
    ranked = cut.withColumn(
        out, (F.coalesce("_off", F.lit(0)) + F.row_number().over(part.orderBy("_ord"))).cast("long")
    )
    if size_out:
        ranked = ranked.withColumn(size_out, F.coalesce("_total", F.count(F.lit(1)).over(part)).cast("long"))
    return ranked.drop("_all", "_ord", "_range", "_off", "_total")


def order_stats(
    df: DataFrame,
    keys: list[str],
    value: str,
    picks: dict[str, Callable[[Column], Column]],
    size_out: str = "n",
    ranges: int = RANGES,
    large: int = LARGE_GROUP,
) -> DataFrame:
    """The values at chosen 1-based ranks of each group, and the group size.

    ``picks`` maps an output name to a function from the group size to a rank.
    Values are counted per distinct value first, so repeats never travel.
    """
    by = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_ord")).agg(F.count(F.lit(1)).alias("_w"))
    cut = _cut_large(counted, by, F.col("_w"), ranges, large)
    part = Window.partitionBy(*by, "_range")
    placed = cut.withColumn(
        "_hi", F.coalesce("_off", F.lit(0)) + F.sum("_w").over(part.orderBy("_ord").rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_size", F.coalesce("_total", F.sum("_w").over(part)))
    inside = lambda rank: (rank > F.col("_hi") - F.col("_w")) & (rank <= F.col("_hi"))
    hits = {name: inside(make(F.col("_size"))) for name, make in picks.items()}
    any_hit = F.lit(False)
    for hit in hits.values():
        any_hit = any_hit | hit
    return placed.where(any_hit).groupBy(*by).agg(
        F.max("_size").cast("long").alias(size_out),
        *[F.max(F.when(hit, F.col("_ord"))).alias(name) for name, hit in hits.items()],
    ).drop("_all")


def median_picks(prefix: str = "_med") -> dict[str, Callable[[Column], Column]]:
    """Ranks whose mean is the median."""
    return {
        f"{prefix}_lo": lambda n: F.floor((n + 1) / 2),
        f"{prefix}_hi": lambda n: F.floor(n / 2) + 1,
    }


def nearest_rank(q: float) -> Callable[[Column], Column]:
    """0-based ``floor(q * (n - 1))`` as a 1-based rank."""
    return lambda n: F.floor(F.lit(q) * (n - 1)) + 1


def exclusive_decile_picks(i: int, prefix: str) -> dict[str, Callable[[Column], Column]]:
    """The two ranks an exclusive decile interpolates between."""
    lower = lambda n: F.greatest(F.lit(1), F.least(F.floor((n + 1) * i / 10), n - 1))
    return {f"{prefix}_lo": lower, f"{prefix}_hi": lambda n: lower(n) + 1}


def exclusive_decile(i: int, prefix: str, n: Column) -> Column:
    """Interpolate the picks of :func:`exclusive_decile_picks`."""
    j = F.greatest(F.lit(1), F.least(F.floor((n + 1) * i / 10), n - 1))
    d = (n + 1) * i - j * 10
    return (F.col(f"{prefix}_lo") * (F.lit(10) - d) + F.col(f"{prefix}_hi") * d) / 10
