"""The best span at every place of a dense axis, by aligned nodes.

A span ``[lo, hi)`` of places is at most two aligned nodes per power of two. Of all
spans that share a node only the best is kept, combined before the shuffle, so a
span over a whole series is a few rows and a million spans over one place are one.
The nodes left are opened in two steps, first to pieces of ``2**PIECE`` places, so
no task opens a whole series. A place meets at most one row per power of two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 12  # places of a piece, as a power of two


def _nodes(lo: str, hi: str) -> Column:
    """Level and number of the aligned nodes that make up ``[lo, hi)``."""
    left = f"shiftright({lo} + shiftleft(1L, e) - 1, e)"
    right = f"shiftright({hi}, e)"
    node = lambda edge, at: f"IF({left} < {right} AND {edge} % 2 = 1, named_struct('level', e, 'node', {at}), NULL)"
    pairs = f"transform(sequence(0, length(bin({hi}))), e -> array({node(left, left)}, {node(right, right + ' - 1')}))"
    return F.expr(f"filter(flatten({pairs}), x -> x IS NOT NULL)")


def best_at(spans: DataFrame, keys: list[str], lo: str, hi: str, best: Column, out: str = "best", idx: str = "idx", piece: int = PIECE) -> DataFrame:
    """(keys, idx, out): the least ``best`` of the spans ``[lo, hi)`` over each place; bare places have no row.

    ``lo`` and ``hi`` are longs of at least 0; a span with a null or empty extent covers nothing.
    """
    least = F.min("_best").alias("_best")
    real = spans.where(F.col(lo) < F.col(hi)).select(*keys, best.alias("_best"), F.explode(_nodes(lo, hi)).alias("_n"))
    nodes = real.select(*keys, "_n.level", "_n.node", "_best").groupBy(*keys, "level", "node").agg(least)
    wide = f"greatest(level - {piece}, 0)"
    parts = nodes.withColumn("_at", F.explode(F.expr(f"sequence(shiftleft(node, {wide}), shiftleft(node + 1, {wide}) - 1)")))
    pieces = parts.select(*keys, F.least("level", F.lit(piece)).alias("level"), F.col("_at").alias("node"), "_best").groupBy(
        *keys, "level", "node"
    ).agg(least)
    opened = pieces.withColumn(idx, F.explode(F.expr("sequence(shiftleft(node, level), shiftleft(node + 1, level) - 1)")))
    return opened.groupBy(*keys, idx).agg(F.min("_best").alias(out))
