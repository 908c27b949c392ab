"""Keys, Camelot codes and tempo predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import map_column

# Pitch-class names in order, and the flat/sharp spellings folded onto them.
KEY_NAMES = ["C", "C#", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
SPELLING = {"Db": "C#", "D#": "Eb", "Gb": "F#", "G#": "Ab", "A#": "Bb"}
MODES = ["major", "minor"]
BPM_TOLERANCE = 0.06


def spell(key: Column) -> Column:
    """Fold an enharmonic spelling onto the canonical name."""
    return F.coalesce(F.try_element_at(map_column(SPELLING), key), key)


def tonic(key: Column) -> Column:
    """Pitch class 0..11 of a key name in any spelling, null when unknown."""
    return F.try_element_at(map_column({k: i for i, k in enumerate(KEY_NAMES)}, "int"), spell(key))


def camelot(key: Column, scale: Column) -> Column:
    """Wheel position of a key: fifths apart are neighbours, C major is 8B, A minor 8A."""
    pc = tonic(key)
    # A relative minor sits a minor third below its major and shares its number.
    major_pc = F.when(scale == "major", pc).when(scale == "minor", F.pmod(pc + 3, F.lit(12)))
    number = F.pmod(major_pc * 7 + 7, F.lit(12)) + 1
    return F.concat(number.cast("string"), F.when(scale == "major", "B").otherwise("A"))


def wheel_number(code: Column) -> Column:
    return F.regexp_extract(F.upper(F.trim(code)), r"^(\d{1,2})([AB])$", 1).try_cast("int")


def wheel_letter(code: Column) -> Column:
    return F.nullif(F.regexp_extract(F.upper(F.trim(code)), r"^(\d{1,2})([AB])$", 2), F.lit(""))


def keys_compatible(a: Column, b: Column) -> Column:
    """Same number, or same letter one step apart around the wheel; unknown keys never match."""
    na, nb = wheel_number(a), wheel_number(b)
    gap = F.abs(na - nb)
    same = (na == nb) | ((wheel_letter(a) == wheel_letter(b)) & gap.isin(1, 11))
    return F.coalesce(same, F.lit(False))


def bpms_compatible(a: Column, b: Column) -> Column:
    """Within 6 % directly or at half or double time; an unknown tempo never excludes."""
    ratio = F.try_divide(F.greatest(a, b), F.least(a, b))
    near = lambda x: F.abs(x - 1) <= BPM_TOLERANCE
    return a.isNull() | b.isNull() | F.coalesce(near(ratio) | near(ratio / 2) | near(ratio * 2), F.lit(False))


def compatible_codes(code: Column) -> Column:
    """The four wheel codes a track in ``code`` mixes with, itself included."""
    n, letter = wheel_number(code), wheel_letter(code)
    at = lambda k: F.concat(k.cast("string"), letter)
    other = F.when(letter == "A", "B").otherwise("A")
    return F.array(
        at(n), F.concat(n.cast("string"), other),
        at(F.pmod(n, F.lit(12)) + 1), at(F.pmod(n - 2, F.lit(12)) + 1),
    )


def key_category(pred_key: Column, pred_scale: Column, ref_key: Column, ref_scale: Column) -> Column:
    """exact / fifth / parallel / relative / other."""
    p, r = tonic(pred_key), tonic(ref_key)
    gap = F.pmod(p - r, F.lit(12))
    same_mode = pred_scale == ref_scale
    return (
        F.when((p == r) & same_mode, "exact")
        .when(same_mode & gap.isin(5, 7), "fifth")
        .when(~same_mode & (p == r), "parallel")
        .when(~same_mode & (((ref_scale == "major") & (gap == 9)) | ((ref_scale == "minor") & (gap == 3))), "relative")
        .otherwise("other")
    )


def key_text(key: Column, scale: Column) -> Column:
    """``Am`` / ``C``."""
    return F.when(key.isNull(), "").otherwise(F.concat(key, F.when(scale == "minor", "m").otherwise("")))


def length_text(seconds: Column) -> Column:
    """``m:ss`` of a length in seconds."""
    s = F.floor(seconds + 0.5)
    return F.when(seconds.isNull(), "").otherwise(
        F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad(F.pmod(s, F.lit(60)).cast("string"), 2, "0"))
    )


def date_text(epoch: Column) -> Column:
    """ISO date of epoch seconds, blank when unset."""
    # Whole days since the epoch, so the answer does not depend on the session's time zone.
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))
    return F.when(F.coalesce(epoch, F.lit(0)) == 0, "").otherwise(day.cast("string"))
