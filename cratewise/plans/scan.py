"""Ordered scans over a dense index, cut into chunks so a long series is many tasks.

Each helper works in two levels: inside fixed-size chunks of the index, then over
one summary row per chunk, then back. The widest sort is one chunk of rows or one
row per chunk, never one whole series of frames. When the longest series fits a
task (see :func:`chunk_for`) the same result comes from one plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 4096
LONG_SERIES = 200_000


def chunk_for(df: DataFrame, idx: str, long: int = LONG_SERIES) -> int | None:
    """The chunk size the longest series calls for; None when a plain window will do."""
    last = df.agg(F.max(idx)).first()[0]
    return None if last is None or last < long else CHUNK


def _chunk(idx: str, chunk: int) -> Column:
    return F.floor(F.col(idx) / chunk)


def neighbour(
    df: DataFrame, keys: list[str], idx: str, value: Column, out: str, step: int = -1, chunk: int | None = CHUNK
) -> DataFrame:
    """Add the value ``step`` positions away in index order (-1 previous, +1 next)."""
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(idx)
        return df.withColumn(out, (F.lag(value) if step < 0 else F.lead(value)).over(whole))
    rows = df.withColumn("_v", value).withColumn("_chunk", _chunk(idx, chunk))
    edge = F.max_by("_v", idx) if step < 0 else F.min_by("_v", idx)
    order = Window.partitionBy(*keys).orderBy("_chunk")
    shift = F.lag("_edge") if step < 0 else F.lead("_edge")
    edges = (
        rows.groupBy(*keys, "_chunk").agg(edge.alias("_edge"))
        .withColumn("_carry", shift.over(order)).drop("_edge")
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(idx)
    near = F.lag("_v").over(local) if step < 0 else F.lead("_v").over(local)
    at_edge = (F.row_number().over(local) == 1) if step < 0 else F.lead(F.lit(1)).over(local).isNull()
    return (
        rows.join(edges, [*keys, "_chunk"])
        .withColumn(out, F.when(at_edge, F.col("_carry")).otherwise(near))
        .drop("_v", "_chunk", "_carry")
    )


def running_sum(
    df: DataFrame, keys: list[str], idx: str, value: Column, out: str, chunk: int | None = CHUNK
) -> DataFrame:
    """Add the inclusive running sum in index order."""
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(whole))
    rows = df.withColumn("_v", value).withColumn("_chunk", _chunk(idx, chunk))
    order = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_t"))
        .withColumn("_carry", F.coalesce(F.sum("_t").over(order), F.lit(0))).drop("_t")
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(totals, [*keys, "_chunk"])
        .withColumn(out, F.col("_carry") + F.sum("_v").over(local))
        .drop("_v", "_chunk", "_carry")
    )


def last_known(
    df: DataFrame, keys: list[str], idx: str, value: Column, out: str, chunk: int | None = CHUNK
) -> DataFrame:
    """Add the most recent non-null value at or before each row in index order."""
    if chunk is None:
        whole = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(whole))
    rows = df.withColumn("_v", value).withColumn("_chunk", _chunk(idx, chunk))
    order = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tails = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(idx))).alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(order)).drop("_tail")
    )
    local = Window.partitionBy(*keys, "_chunk").orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(tails, [*keys, "_chunk"])
        .withColumn(out, F.coalesce(F.last("_v", ignorenulls=True).over(local), F.col("_carry")))
        .drop("_v", "_chunk", "_carry")
    )
