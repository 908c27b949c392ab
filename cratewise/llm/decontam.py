"""Benchmark decontamination: notes that repeat passages of held-out evaluation items.

Only DataFrame expressions: item n-grams are one hashed table, every token window of
every note is looked up in it, and the join's equality on the window's words is the
check of each hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage, fetch_bounded
from .blocks import BROADCAST_ROWS, bounded_side

UPPER, LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Item windows, with the items of each, that are shipped whole to every executor; more are joined by a shuffle.
MAX_BROADCAST_WINDOWS = 500_000


def words_of(text: Column) -> Column:
    """The words of a text: letters and digits, A-Z lower-cased; null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWERED)
    return F.regexp_extract_all(lowered, F.lit(WORDS), F.lit(0))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows(words: Column, size: int) -> Column:
    """(pos, size, window) of every ``size`` consecutive words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(
        at, lambda i: F.struct((i - 1).alias("pos"), F.lit(size).alias("size"), F.array_join(F.slice(words, i, size), " ").alias("window"))
    )


def item_windows(items: DataFrame, size: int = 10) -> DataFrame:
    """(window, size, items): each distinct n-gram with the keys of the items holding it.

    ``items`` is (item, text). An item of fewer than ``size`` words is one window of all
    its words; one without words has none.
    """
    held = items.select("item", words_of(F.col("text")).alias("w")).where(F.size("w") > 0)
    short = held.where(F.size("w") < size).select("item", F.size("w").alias("size"), F.array_join("w", " ").alias("window"))
    full = held.where(F.size("w") >= size).select("item", F.explode(_windows(F.col("w"), size)).alias("x")).select("item", "x.size", "x.window")
    return full.unionByName(short).groupBy("window", "size").agg(F.collect_set("item").alias("items"))


def contamination(notes: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(hash, print, copies, n_words, hits, items) of every note against evaluation ``items``.

    ``notes`` is (hash, note): texts kept with tracks, up for training. ``items`` is
    (item, text), the held-out set; further columns of both are ignored. ``hits`` lists
    (pos, size) of every word window that is an item's, ``items`` the sorted keys of those
    items as strings. One row stands for ``copies`` rows equal in hash and note, told from
    others of that hash by ``print``.

    * Null or wordless notes have no words and no hits; they are returned.
    * Without items nothing is hit. Null item keys are left out of ``items``.
    * The windows of an item set of more than MAX_BROADCAST_WINDOWS are joined by a
      shuffle instead of a broadcast.

    Windows are looked up as they are made; only hits and one marker per note are
    shuffled, so a window that many notes share costs as many small rows.
    """
    grams = cut_lineage(item_windows(items, size))
    sizes = sorted(r["size"] for r in fetch_bounded(grams.select("size").distinct(), size) or [])
    kind = "array<struct<pos:int,size:int,window:string>>"

    def looked_at(words: Column) -> Column:
        marker = F.array(F.struct(F.size(words).alias("pos"), F.lit(0).alias("size"), F.lit(None).cast("string").alias("window"))).cast(kind)
        return F.concat(marker, *[_windows(words, n).cast(kind) for n in sizes])

    each = notes.select(
        "hash", F.xxhash64(F.coalesce("note", F.lit(""))).alias("print"), F.explode(_let(words_of(F.col("note")), looked_at)).alias("x")
    ).select("hash", "print", "x.*")
    found = each.join(bounded_side(grams.drop("size"), MAX_BROADCAST_WINDOWS, F.size("items")), "window", "left").where("size = 0 OR items IS NOT NULL")
    mark = F.col("size") == 0
    return found.groupBy("hash", "print").agg(
        F.count(F.when(mark, 1)).alias("copies"), F.max(F.when(mark, F.col("pos"))).alias("n_words"),
        F.sort_array(F.collect_set(F.when(~mark, F.struct("pos", "size")))).alias("hits"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("items")), lambda i: i.cast("string")))).alias("items"),
    )


def words_hit(hits: Column) -> Column:
    """How many words lie inside any of the sorted (pos, size) windows."""
    def step(acc: Column, h: Column) -> Column:
        end = h["pos"] + h["size"]
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(h["pos"], acc["end"]), F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end")
        )

    return F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"].cast("long"))


def contaminated_notes(notes: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """(hash, n_words, n_hit, items) of every row of ``notes``; see :func:`contamination`.

    Rows equal in hash and note are each returned.
    """
    found = contamination(notes, items, size).withColumn("n_hit", words_hit(F.col("hits")))
    each = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")
    return found.select("hash", F.col("n_words").cast("long").alias("n_words"), "n_hit", "items", each).drop("_copy")


def clean_notes(notes: DataFrame, items: DataFrame, size: int = 10, action: str = "document") -> DataFrame:
    """``notes`` without evaluation passages, with the columns it came with (but any ``_item_...``).

    ``action`` "document" leaves out notes with a hit; "span" cuts the words that are hit,
    and what parts them, out of the note.
    """
    notes = notes.drop("_item_hash", "_item_print", "_item_hits")
    dirty = cut_lineage(contamination(notes, items, size).where(F.size("hits") > 0).select(
        F.col("hash").alias("_item_hash"), F.col("print").alias("_item_print"), F.col("hits").alias("_item_hits")
    ))
    same = F.col("hash").eqNullSafe(F.col("_item_hash")) & (F.xxhash64(F.coalesce("note", F.lit(""))) == F.col("_item_print"))
    if action == "document":
        return notes.join(bounded_side(dirty.drop("_item_hits")), same, "left_anti")
    if action != "span":
        raise ValueError("action must be document or span")
    joined = notes.join(bounded_side(dirty, BROADCAST_ROWS, F.size("_item_hits")), same, "left")
    cut = F.when(F.col("_item_hits").isNull(), F.col("note")).otherwise(_cut(F.col("note"), F.col("_item_hits")))
    return joined.withColumn("note", cut).drop("_item_hash", "_item_print", "_item_hits")


def _cut(text: Column, hits: Column) -> Column:
    """The text without its hit words: breaks and words alternate, so words keep their places."""
    breaks = F.split(F.translate(text, UPPER, LOWERED), r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def build(b: Column) -> Column:
        # start of word i: the lengths of breaks up to i and of the words before it
        words = words_of(text)
        spans = _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.struct(
            i.alias("i"), F.char_length(F.element_at(b, i)).alias("gap"), F.char_length(F.element_at(w, i)).alias("len"))))
        state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            hit = F.exists(hits, lambda h: (s["i"] > h["pos"]) & (s["i"] <= h["pos"] + h["size"]))
            taken = F.when(hit, F.lit("")).otherwise(F.substring(text, acc["at"] + 1, s["gap"] + s["len"]))
            return F.struct((acc["at"] + s["gap"] + s["len"]).alias("at"), F.concat(acc["out"], taken).alias("out"))

        return F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.char_length(text))))

    return _let(breaks, build)
