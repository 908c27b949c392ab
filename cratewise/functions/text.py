"""String rules for names, credits, tags, paths and pages."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, punctuation and soft words that join artists in a credit.
CREDIT_WORDS = r"(?i)\s+(?:featuring|feat\.?|ft\.?|versus|vs\.?|presents|pres\.?)\s+"
CREDIT_PUNCT = r"\s*/\s*|\s*,\s*"
CREDIT_SOFT = r"(?i)\s+(?:&|and|x|with)\s+|\s*\+\s*"
CREDIT_TRIM = r"^[ .\-\t]+|[ .\-\t]+$"
# Bracketed descriptors that mark a remix.
REMIX = r"(?i)[\(\[]([^)\]]*\b(?:remix|edit|bootleg|vip|flip|rework|re-?edit|mix|dub)\b[^)\]]*)[\)\]]"
# Tag spellings of "and", separators of a multi-genre tag, vague and umbrella tags.
AND_WORDS = r"\s*(?:&|\band\b|'n'|\bn'|'n\b)\s*"
TAG_SPLIT = r"\s*[;,|/\x00]\s*"
LABEL_SPLIT = r"\s*[;,|\x00]\s*"
VAGUE_TAGS = ["electro"]
UMBRELLA_TAGS = [
    "electronic", "electronicmusic", "electronique", "lectronique", "elektronisch", "electronica",
    "electronico", "electronicdance", "dance", "edm", "club", "other", "unknown", "misc", "various",
    "genre", "music",
]
# Prose that says nothing about a genre.
GENERIC_PROSE = ["music genre", "electronic music genre", "genre of music", "musical genre"]


def squeeze(s: Column) -> Column:
    """Trim and collapse runs of whitespace to one space."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def blank_to_null(s: Column) -> Column:
    return F.nullif(s, F.lit(""))


def fold_and(s: Column, hyphens: bool = False) -> Column:
    """``&`` / ``and`` / ``'n'`` as `` n ``; optionally hyphens as spaces."""
    return squeeze(F.regexp_replace(F.regexp_replace(s, "-", " ") if hyphens else s, AND_WORDS, " n "))


def name_key(s: Column) -> Column:
    """Accent-free, lower-case join key with ``&`` as ``and``."""

    @F.pandas_udf("string")
    def _plain(v: pd.Series) -> pd.Series:
        return v.map(
            lambda x: "" if x is None else "".join(
                c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)
            )
        )

    folded = F.regexp_replace(F.lower(_plain(s)), "&", " and ")
    return squeeze(F.regexp_replace(folded, "[^a-z0-9]+", " "))


def artist_key(s: Column) -> Column:
    """Whitespace collapsed and lower-cased; blank stays blank."""
    return F.lower(squeeze(F.coalesce(s, F.lit(""))))


def split_clean(s: Column, pattern: str) -> Column:
    """Split on a pattern, strip `` .-`` from each part, drop empties (F8)."""
    parts = F.transform(F.split(s, pattern), lambda p: F.regexp_replace(p, CREDIT_TRIM, ""))
    return F.filter(parts, lambda p: p != "")


def credit_pieces(credit: Column) -> Column:
    return split_clean(credit, CREDIT_WORDS)


def credit_parts(piece: Column) -> Column:
    return split_clean(piece, CREDIT_PUNCT)


def credit_halves(name: Column) -> Column:
    return split_clean(name, CREDIT_SOFT)


def tag_artist(artist: Column, album_artist: Column) -> Column:
    """First non-empty of artist and album artist, stripped (S3)."""
    return F.trim(F.coalesce(blank_to_null(artist), blank_to_null(album_artist), F.lit("")))


def stem(filename: Column) -> Column:
    """File name without folder and last suffix."""
    base = F.regexp_replace(filename, r"^.*/", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def artist_or_guess(tagged: Column, title: Column, filename: Column) -> Column:
    """Tag artist, else what stands left of `` - `` in the title or file stem."""
    base = F.coalesce(blank_to_null(title), stem(filename), F.lit(""))
    guess = F.when(F.instr(base, " - ") > 0, F.trim(F.substring_index(base, " - ", 1))).otherwise("")
    return F.coalesce(blank_to_null(tagged), guess)


def search_fields(tagged: Column, tag_title: Column, title: Column, filename: Column) -> Column:
    """``struct(artist, title, remix)`` to search by, the remix bracket taken off the title."""
    name = F.coalesce(blank_to_null(F.trim(title)), stem(filename), F.lit(""))
    has_dash = F.instr(name, " - ") > 0
    left = F.trim(F.substring_index(name, " - ", 1))
    right = F.trim(F.when(has_dash, F.substr(name, F.instr(name, " - ") + 3)).otherwise(name))
    artist = F.coalesce(blank_to_null(F.trim(tagged)), F.when(has_dash, left), F.lit(""))
    track = F.coalesce(blank_to_null(F.trim(tag_title)), right)
    clean = F.regexp_replace(F.regexp_replace(track, REMIX, ""), r"^[ \-_]+|[ \-_]+$", "")
    return F.struct(
        artist.alias("artist"),
        F.coalesce(blank_to_null(clean), track).alias("title"),
        F.trim(F.regexp_extract(track, REMIX, 1)).alias("remix"),
    )


def is_vague(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), "[^a-z]", "").isin(VAGUE_TAGS)


def is_umbrella(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), "[^a-z]", "").isin(UMBRELLA_TAGS)


def tag_parts(tag: Column) -> Column:
    """The specific parts of a file tag: blanks and vague names dropped (F16)."""
    parts = F.split(F.coalesce(tag, F.lit("")), TAG_SPLIT)
    return F.array_distinct(F.filter(parts, lambda p: (F.trim(p) != "") & ~is_vague(p)))


def clean_drops(drops: Column) -> Column:
    """Trimmed, non-blank, distinct names in the order given."""
    return F.array_distinct(F.filter(F.transform(drops, lambda d: F.trim(d)), lambda d: F.coalesce(d, F.lit("")) != ""))


def list_param(s: Column) -> Column:
    """A comma list as trimmed ordered distinct values."""
    parts = F.transform(F.split(F.coalesce(s, F.lit("")), ","), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def year_of(s: Column) -> Column:
    """Leading year; a minus sign counts only before 1900."""
    t = F.trim(s)
    year = F.regexp_extract(t, r"^-?(\d{1,4})", 1).try_cast("int")
    return F.when(~t.startswith("-") | (year > 1900), year).otherwise(-year)


def safe_name(s: Column) -> Column:
    """Letters, digits, space, ``_`` and ``-`` kept; anything else is ``_``."""
    return F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"[^\p{L}\p{N} _-]", "_"))


def folder_name(s: Column) -> Column:
    """:func:`safe_name`, or null without a single letter or digit."""
    return F.when(F.coalesce(s, F.lit("")).rlike(r"[\p{L}\p{N}]"), blank_to_null(safe_name(s)))


def star_value(v: Column) -> Column:
    """Stars clamped to 0..5, junk is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(v.try_cast("int"), F.lit(0))))


def grade_text(v: Column) -> Column:
    return F.substring(F.upper(F.trim(v)), 1, 4)


def note_text(v: Column) -> Column:
    return F.substring(F.trim(v), 1, 1000)


def comment_text(grade: Column, note: Column) -> Column:
    """``grade - note`` without a dangling separator."""
    return F.concat_ws(" - ", blank_to_null(F.trim(grade)), blank_to_null(F.trim(note)))


def file_url(path: Column) -> Column:
    """``file://localhost/...`` with everything but ``/ : _ . - ~`` percent-encoded."""

    slashed = F.translate(F.coalesce(path, F.lit("")), "\\", "/")
    rooted = F.when(F.substring(slashed, 2, 1) == ":", F.concat(F.lit("/"), slashed)).otherwise(slashed)
    quoted = F.url_encode(rooted)  # a form encoding; a path spells these otherwise
    for form, plain in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%3A", ":")):
        quoted = F.replace(quoted, F.lit(form), F.lit(plain))
    return F.concat(F.lit("file://localhost"), quoted)


def native_path(path: Column) -> Column:
    """``/mnt/c/x`` as ``C:\\x``; any other path unchanged."""
    drive = F.upper(F.regexp_extract(path, r"^/mnt/([A-Za-z])(?:/|$)", 1))
    rest = F.translate(F.regexp_replace(path, r"^/mnt/[A-Za-z]/?", ""), "/", "\\")
    return F.when(drive != "", F.concat(drive, F.lit(":\\"), rest)).otherwise(path)


def tech_format(container: Column, codec: Column) -> Column:
    """Container (first of a list) or codec, short names upper-cased."""
    label = F.coalesce(blank_to_null(F.substring_index(container, ",", 1)), blank_to_null(codec))
    return F.when(F.length(label) <= 4, F.upper(label)).otherwise(label)


def bitrate_text(bit_rate: Column) -> Column:
    rate = bit_rate.try_cast("long")
    return F.when(rate != 0, F.concat(F.bround(rate / 1000).cast("long").cast("string"), F.lit(" kbps")))


def sample_rate_text(rate: Column) -> Column:
    return F.concat(blank_to_null(rate), F.lit(" Hz"))


def best_prose(excerpt: Column, description: Column) -> Column:
    """Excerpt, else a description that says something."""
    desc = blank_to_null(F.trim(description))
    return F.coalesce(blank_to_null(F.trim(excerpt)), F.when(~F.lower(desc).isin(GENERIC_PROSE), desc))


def unescape(s: Column) -> Column:
    """HTML entities decoded, Arrow-batched."""

    @F.arrow_udf("string")
    def _decode(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html.unescape(x) for x in v.to_pylist()])

    return _decode(s)


def strip_html(s: Column) -> Column:
    """Tags out, entities decoded, whitespace collapsed."""
    return squeeze(unescape(F.regexp_replace(F.coalesce(s, F.lit("")), "<[^>]+>", "")))
