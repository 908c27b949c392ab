"""Saved pages and annotation files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import music, text as T

# One genre node of the saved map page, with or without attribute quotes.
_Q = r"""["']?"""
NODE = (
    rf"(?is)^<div\s+id={_Q}item\d+{_Q}[^>]*?style={_Q}color:\s*(#[0-9a-fA-F]{{6}});\s*top:\s*(\d+)px;\s*left:\s*(\d+)px;"
    rf"\s*font-size:\s*(\d+)%{_Q}[^>]*?onclick={_Q}playx\(&quot;([^&]*)&quot;,\s*&quot;(.*?)&quot;"
)
EXAMPLE = rf"(?is)title={_Q}e\.g\.\s*(.*?)\s*&quot;(.*?)&quot;"


def extract_elements(pages: DataFrame, key: str, html: str, pattern: str, groups: dict[str, int]) -> DataFrame:
    """(key, pos, one column per group): every match of a pattern in each page."""
    parts = [F.regexp_extract_all(html, F.lit(pattern), F.lit(g)) for g in groups.values()]
    zipped = F.arrays_zip(*[p.alias(n) for n, p in zip(groups, parts)])
    tall = pages.select(key, F.posexplode(zipped).alias("pos", "e"))
    return tall.select(key, "pos", *[F.col("e")[str(i)].alias(n) if n not in _names(tall) else F.col(f"e.{n}").alias(n) for i, n in enumerate(groups)])


def _names(tall: DataFrame) -> list[str]:
    return tall.schema["e"].dataType.names


def first_by(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The first row per key; later duplicates lose."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def genre_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, name, x, y, color, size, track_id, artist, title): the nodes of a saved genre map."""
    chunks = pages.select(key, F.posexplode(F.split(html, "<div ")).alias("pos", "c")).where(F.col("pos") > 0)
    whole = F.concat(F.lit("<div "), F.col("c"))
    get = lambda g: F.regexp_extract(whole, NODE, g)
    opening = F.regexp_replace("c", r"(?s)>.*$", "")
    rows = chunks.select(
        key, "pos", F.trim(T.unescape(get(6))).alias("name"), get(3).try_cast("int").alias("x"), get(2).try_cast("int").alias("y"),
        F.lower(get(1)).alias("color"), get(4).try_cast("int").alias("size"), T.blank_to_null(get(5)).alias("track_id"),
        T.blank_to_null(F.trim(T.unescape(F.regexp_extract(opening, EXAMPLE, 1)))).alias("artist"),
        T.blank_to_null(F.trim(T.unescape(F.regexp_extract(opening, EXAMPLE, 2)))).alias("title"),
    ).where(F.col("name") != "")
    return first_by(rows, [key, "name"], F.col("pos"))


def parse_annotation(text: Column) -> Column:
    """``struct(key, scale)`` of a ``tonic mode`` label; anything else is null."""
    t = T.squeeze(text)
    tonic = music.spell(F.regexp_extract(t, r"^(\S+) (major|minor)$", 1))
    scale = F.regexp_extract(t, r"^(\S+) (major|minor)$", 2)
    return F.when(scale != "", F.struct(tonic.alias("key"), scale.alias("scale")))


def read_annotations(spark: SparkSession, folder: str, confidence: DataFrame | None = None) -> DataFrame:
    """(id, key, scale, confidence) from one annotation file per track."""
    files = spark.read.text(folder, wholetext=True).withColumn("_path", F.input_file_name())
    name = F.regexp_extract(F.try_url_decode("_path"), r"([^/]+)\.[^./]+$", 1)
    rows = files.select(name.alias("id"), parse_annotation(F.col("value")).alias("k")).where(F.col("k").isNotNull()).select("id", "k.key", "k.scale")
    if confidence is None:
        return rows.withColumn("confidence", F.lit(None).cast("int"))
    first = F.substring_index("id", " ", 1)
    notes = confidence.select(F.col("id").alias("_c"), F.col("confidence").cast("int").alias("confidence"))
    return rows.join(notes, first == F.col("_c"), "left").drop("_c")
