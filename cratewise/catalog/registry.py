"""Registration of queries and the tables in the roles they play."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sequences

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a ``(spark, folder) -> DataFrame`` under its name, with its checking SQL."""

    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The style each event type stands for when a user is read as a track.
STYLES = {"view": "Deep House", "click": "Techno", "purchase": "Drum n Bass", "signup": "Dubstep", "error": "Dark Ambient"}
KEYSTONES = {"Deep House": "House", "Techno": "Techno", "Drum n Bass": "Drum n Bass", "Dubstep": "Dubstep", "Dark Ambient": "Ambient"}


def _case(column: str, pairs: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {default} END"


STYLE_SQL = _case("event_type", STYLES)
KEYSTONE_SQL = _case("style", KEYSTONES)


def style_of(column: str = "event_type"):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLES.items() for x in kv]), F.col(column))


# (user_id, style, score): a user as a track, its events as scored styles.
READS_SQL = f"reads AS (SELECT user_id, {STYLE_SQL} AS style, round(sum(value), 2) AS score FROM events GROUP BY ALL)"


def user_reads(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", style_of().alias("style"), "value")
    return events.groupBy("user_id", "style").agg(F.round(F.sum("value"), 2).alias("score"))


def packed_reads(reads: DataFrame, key: str = "user_id", out: str = "read") -> DataFrame:
    """Tall reads as one ranked array per key; a key has at most one entry per style."""
    packed = reads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("n"), "style"))).alias("_a"))
    return packed.select(key, F.transform("_a", lambda e: F.struct(e["style"].alias("style"), (-e["n"]).alias("score"))).alias(out))


# (user_id, frame_idx, style, score): half-day frames of a user, scores as shares of the frame.
SLOTS_SQL = f"""slots AS (
  SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) * 2 + (hour(ts) // 12) AS slot, {STYLE_SQL} AS style,
         sum(value) AS v FROM events GROUP BY ALL),
frames AS (
  SELECT user_id, dense_rank() OVER (PARTITION BY user_id ORDER BY slot) - 1 AS frame_idx, style,
         round(v / sum(v) OVER (PARTITION BY user_id, slot), 3) AS score, round(sum(v) OVER (PARTITION BY user_id, slot), 2) AS energy
  FROM slots),
topk AS (SELECT *, row_number() OVER (PARTITION BY user_id, frame_idx ORDER BY score DESC, style) AS rank FROM frames),
winners AS (SELECT user_id, frame_idx, style, score, energy FROM topk WHERE rank = 1)"""


def sql_round(x: Column, places: int) -> Column:
    """``round`` as DuckDB does it: of the double times a power of ten, where Spark rounds the shortest decimal that prints it."""
    return F.round(x * 10.0**places) / 10.0**places


def user_slots(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, frame_idx, style, score, energy) of half-day frames with a dense index."""
    events = table(spark, folder, "events")
    slot = F.datediff("ts", F.lit("2024-01-01").cast("date")) * 2 + F.floor(F.hour("ts") / 12)
    cells = events.select("user_id", slot.alias("slot"), style_of().alias("style"), "value").groupBy("user_id", "slot", "style").agg(F.sum("value").alias("v"))
    totals = cells.groupBy("user_id", "slot").agg(F.sum("v").alias("total"))
    indexed = sequences.with_frame_index(totals, "user_id", [F.col("slot")])
    # A frame without energy has no shares: NaN, as the SQL's 0 / 0, where Spark's division is an error.
    share = F.when(F.col("total") == 0, F.col("v") * float("inf")).otherwise(F.col("v") / F.col("total"))
    return cells.join(indexed, ["user_id", "slot"]).select(
        "user_id", "frame_idx", "style", sql_round(share, 3).alias("score"), sql_round(F.col("total"), 2).alias("energy")
    )


def user_topk(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.frame_topk(user_slots(spark, folder), "user_id")


def user_winners(spark: SparkSession, folder: str) -> DataFrame:
    """(user_id, frame_idx, style, score, energy) of the best style of each frame."""
    return user_slots(spark, folder).groupBy("user_id", "frame_idx").agg(
        F.min_by(F.struct("style", "score", "energy"), F.struct((-F.col("score")).alias("n"), F.col("style"))).alias("w")
    ).select("user_id", "frame_idx", "w.style", "w.score", "w.energy")


# (user_id, frame_idx, value): a user's event values in time order.
SERIES_SQL = """series AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, value FROM events),
sizes AS (SELECT user_id, count(*) AS n FROM series GROUP BY user_id)"""


def user_series(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", "ts", "event_id", "value")
    return sequences.with_frame_index(events, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "frame_idx", "value")
