"""The track table: parsing, listing columns, pruned views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T, vectors as V

# Output field to the tag names that may hold it, best first, and the length cap.
TAG_FIELDS = {
    "title": ["title"],
    "artist": ["artist"],
    "album": ["album"],
    "albumartist": ["album_artist", "albumartist"],
    "genre": ["genre"],
    "date": ["date", "year", "originalyear"],
    "tracknumber": ["track", "tracknumber"],
    "discnumber": ["disc", "discnumber"],
    "composer": ["composer"],
    "bpm": ["bpm", "tbpm"],
}
TAG_LENGTH = 300
# Which columns each view of the track table reads.
VIEWS = {
    "map": ["hash", "title", "filename", "filepath", "payload", "embedding"],
    "listing": ["hash", "title", "filename", "filepath", "created", "style", "bpm", "key", "scale", "camelot", "duration", "tag_artist"],
    "similar": ["hash", "title", "filename", "style", "bpm", "camelot", "tag_artist", "embedding"],
    "style_embeddings": ["hash", "style", "embedding"],
    "audit": ["hash", "title", "payload", "embedding"],
    "embeddings": ["hash", "title", "filename", "payload", "embedding"],
    "payloads": ["hash", "title", "filename", "filepath", "payload"],
    "paths": ["hash", "title", "filename", "filepath"],
    "hash_paths": ["hash", "filepath"],
    "hash_payloads": ["hash", "payload"],
    "summary": ["hash", "title", "filename", "payload"],
}


def read_tracks(spark: SparkSession, path: str, view: str | None = None) -> DataFrame:
    """A track table, only the columns of a view; similarity views skip rows without a vector."""
    df = spark.read.parquet(path)
    if view is None:
        return df
    have = [c for c in VIEWS[view] if c in df.columns]
    out = df.select(*have)
    return out.where(F.col("embedding").isNotNull()) if view in ("similar", "style_embeddings", "audit") else out


def parse_json(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """``df`` with the column parsed into ``out``; rows that do not parse are left out.

    The parse stands behind an explode of one element, so it runs once per row and
    not once per field that is read from it.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.col(column), f"{schema}, _corrupt string", options)
    rest = [c for c in df.columns if c != out]
    whole = df.select(*rest, F.explode(F.array(parsed)).alias(out))
    return whole.where(F.col(out).isNotNull() & F.col(f"{out}._corrupt").isNull()).withColumn(out, F.col(out).dropFields("_corrupt"))


def parse_payload(tracks: DataFrame, column: str = "payload", schema: str = schemas.PAYLOAD) -> DataFrame:
    """The payload as nested columns; a narrower ``schema`` builds only the fields a job reads."""
    return parse_json(tracks, column, schema, column)


def listing_columns(tracks: DataFrame, payload: str = "payload") -> DataFrame:
    """The columns a listing shows, lifted out of the parsed payload (S3)."""
    p = F.col(payload)
    return tracks.select(
        "*", F.try_element_at(p["styles"], F.lit(1))["style"].alias("style"), *[p[c].alias(c) for c in ("bpm", "key", "scale", "camelot", "duration")],
        T.tag_artist(F.try_element_at(p["tags"]["tag"], F.lit("artist")), F.try_element_at(p["tags"]["tag"], F.lit("albumartist"))).alias("tag_artist"),
    )


def decode_vectors(tracks: DataFrame, column: str = "embedding") -> DataFrame:
    """Stored float32 bytes as arrays."""
    return tracks.withColumn(column, V.decode_blob(F.col(column)))


def normalise_tags(tags: Column) -> Column:
    """Map of the known fields: first usable alias, any case, at most 300 characters."""
    low = F.map_from_entries(F.array_distinct(F.transform(F.map_entries(tags), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))))

    def usable(name: str) -> Column:
        v = F.trim(F.try_element_at(low, F.lit(name)))
        return F.when((v != "") & (F.length(v) <= TAG_LENGTH), v)

    pairs = [F.struct(F.lit(f).alias("key"), F.coalesce(*[usable(a) for a in names], F.lit(None)).alias("value")) for f, names in TAG_FIELDS.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()))


# --- stored lookup responses ----------------------------------------------------------

_NAMED = "array<struct<name:string,count:string>>"  # a count may be a number or its text


def lookup_names(cache: DataFrame) -> DataFrame:
    """(hash, source, pos, name, count) from stored responses of the three sources.

    Release styles then genres of the best match keep their order; recording genres
    and tags keep the larger count per name, largest first; track tags keep their
    order, a lone object counting as a list of one.
    """
    src, js = F.col("source"), F.col("response_json")
    plain = lambda path: F.coalesce(F.from_json(F.get_json_object(js, path), "array<string>"), F.array().cast("array<string>"))
    counted = lambda path: F.coalesce(F.from_json(F.get_json_object(js, path), _NAMED), F.array().cast(_NAMED))
    release = F.transform(F.concat(plain("$.results[0].style"), plain("$.results[0].genre")), lambda n: F.struct(n.alias("name"), F.lit(None).cast("string").alias("count")))
    recording = F.concat(counted("$.recordings[0].genres"), counted("$.recordings[0].tags"))
    tag = F.get_json_object(js, "$.toptags.tag")
    listed = F.when(F.ltrim(tag).startswith("{"), F.concat(F.lit("["), tag, F.lit("]"))).otherwise(tag)
    track = F.coalesce(F.from_json(listed, _NAMED), F.array().cast(_NAMED))
    entries = F.when(src == "discogs", release).when(src == "musicbrainz", recording).otherwise(track)
    tall = cache.select("hash", "source", F.posexplode(entries).alias("p", "e")).select("hash", "source", "p", F.trim("e.name").alias("name"), F.col("e.count").try_cast("int").alias("count")).where(F.coalesce("name", F.lit("")) != "")
    folded = F.when(src == "lastfm", F.concat_ws(":", "p", "name")).otherwise(F.lower("name"))
    best = tall.groupBy("hash", "source", folded.alias("_k")).agg(
        F.min_by(F.struct("name", "count"), F.struct(F.when(src == "musicbrainz", -F.coalesce("count", F.lit(0))).otherwise(0), "p")).alias("e"), F.min("p").alias("p")
    )
    size = F.when(src == "musicbrainz", -F.coalesce("e.count", F.lit(0))).otherwise(0)
    # The names of one stored response.
    order = Window.partitionBy("hash", "source").orderBy(size, "p")
    return best.select("hash", "source", (F.row_number().over(order) - 1).alias("pos"), "e.name", "e.count")
