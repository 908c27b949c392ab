"""Connected components of a table of links, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, root): every node of ``links`` (a, b) with the smallest node it reaches.

    Each round hangs the larger neighbours of a node on its smallest one, then the
    smaller ones likewise, and is written to the shared folder. The links become
    stars in a number of rounds that grows with the logarithm of the longest path.
    A hub is aggregated before the shuffle. Nulls and self-links are left out; no
    links give no rows.
    """
    edges = cut_lineage(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        near = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(near, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct()
        )
        nxt = cut_lineage(small)
        if _digest(nxt) == _digest(edges):
            return nxt.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                nxt.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        edges = nxt


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
