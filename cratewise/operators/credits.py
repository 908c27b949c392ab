"""Artist credits split on library-wide evidence, and ratings over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed value: a pairing seen more often than this is an act of its own.
PAIRING_MAX = 2


def evidence_index(credits: DataFrame, credit: str) -> DataFrame:
    """(name, seen): how often each piece and each part occurs over all credits.

    Equal credits are counted once first, so a repeated credit travels as one row.
    """
    counted = credits.where(F.col(credit).isNotNull()).groupBy(credit).agg(F.count(F.lit(1)).alias("w"))
    pieces = counted.select("w", F.explode(T.credit_pieces(F.col(credit))).alias("piece"))
    split = pieces.withColumn("parts", T.credit_parts(F.col("piece")))
    names = split.select("w", F.explode("parts").alias("name")).unionByName(
        split.where(F.size("parts") > 1).select("w", F.col("piece").alias("name"))
    )
    return names.groupBy("name").agg(F.sum("w").alias("seen"))


def split_credits(credits: DataFrame, credit: str) -> DataFrame:
    """(credit, pos, artist): every distinct credit split into the artists it names.

    Credit words always split. A slash or comma splits unless the whole is an act:
    seen more than twice with no part ever seen without it. ``&``, and, x, with, +
    split only when a half is known on its own and the pairing is rare and no
    commoner than that half. Repeats differing in case keep the first.
    """
    index = evidence_index(credits, credit)
    seen = lambda name, out: index.select(F.col("name").alias(name), F.col("seen").alias(out))
    distinct = credits.select(credit).where(F.col(credit).isNotNull()).distinct()
    pieces = distinct.select(credit, F.posexplode(T.credit_pieces(F.col(credit))).alias("p1", "piece")).withColumn(
        "parts", T.credit_parts(F.col("piece"))
    )
    acts = (
        pieces.where(F.size("parts") > 1).select("piece", F.explode("parts").alias("part")).distinct()
        .join(seen("piece", "whole"), "piece").join(seen("part", "alone"), "part")
        .groupBy("piece").agg(
            (F.max("whole") > PAIRING_MAX).alias("often"), F.bool_and(F.col("alone") == F.col("whole")).alias("bound")
        ).where("often and bound").select("piece", F.lit(True).alias("act"))
    )
    hard = pieces.join(acts, "piece", "left").select(
        credit, "p1", F.posexplode(F.when(F.col("act"), F.array("piece")).otherwise(F.col("parts"))).alias("p2", "name")
    ).withColumn("halves", T.credit_halves(F.col("name")))
    pairs = (
        hard.where(F.size("halves") > 1).select("name", F.explode("halves").alias("half")).distinct()
        .join(seen("half", "known"), "half", "left").join(seen("name", "pairing"), "name", "left")
        .groupBy("name").agg(F.coalesce(F.max("known"), F.lit(0)).alias("known"), F.coalesce(F.max("pairing"), F.lit(0)).alias("pairing"))
        .where((F.col("known") > 0) & (F.col("pairing") <= F.col("known")) & (F.col("pairing") <= PAIRING_MAX))
        .select("name", F.lit(True).alias("pair"))
    )
    soft = hard.join(pairs, "name", "left").select(
        credit, "p1", "p2", F.posexplode(F.when(F.col("pair"), F.col("halves")).otherwise(F.array("name"))).alias("p3", "artist")
    )
    # Names of one credit: a handful of rows.
    once = soft.groupBy(credit, F.lower("artist").alias("folded")).agg(
        F.min(F.struct("p1", "p2", "p3", "artist")).alias("first")
    )
    order = F.sort_array(F.collect_list("first"))
    return once.groupBy(credit).agg(order.alias("names")).select(
        credit, F.posexplode(F.transform("names", lambda e: e["artist"])).alias("pos", "artist")
    )


def artist_stars(tracks: DataFrame, key: str, credit: str, ratings: DataFrame, artist_ratings: DataFrame) -> DataFrame:
    """(key, stars): the best of the track's stars and those of its artists or raw credit.

    ``ratings`` is (key, stars); ``artist_ratings`` is (artist_key, stars). A credit's
    best artist is found once per distinct credit.
    """
    names = split_credits(tracks, credit).select(credit, T.artist_key(F.col("artist")).alias("artist_key"))
    raw = tracks.select(credit).where(F.col(credit).isNotNull()).distinct().select(credit, T.artist_key(F.col(credit)).alias("artist_key"))
    best = names.unionByName(raw).join(artist_ratings, "artist_key").groupBy(credit).agg(F.max("stars").alias("_a"))
    own = ratings.select(key, F.col("stars").alias("_t"))
    return tracks.select(key, credit).join(own, key, "left").join(best, credit, "left").select(
        key, F.greatest(F.coalesce("_t", F.lit(0)), F.coalesce("_a", F.lit(0))).alias("stars")
    )
