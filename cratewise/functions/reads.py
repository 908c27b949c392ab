"""Ranked style reads as array expressions (F10-F15, P9-P11): precedence, steps, drops.

A read is ``array<struct<style:string, score:double>>``, best first. Reads are short
(at most a few dozen styles), so every rule is one expression over the row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean_drops

# Fixed values of the adjustment curve, the read lengths and the candidate floor.
STEP_SCALE = 1.9
MAX_STEP = 3
ENTRY_FRACTION = 0.09
READ_LENGTH = 8
CANDIDATE_FLOOR = 0.03
CANDIDATE_LIMIT = 5
FLAT_FLOOR = 0.02
FLAT_LIMIT = 5
READ_TYPE = "array<struct<style:string,score:double>>"


def _empty() -> Column:
    return F.from_json(F.lit("[]"), READ_TYPE)


def _entry(style: Column, score: Column) -> Column:
    return F.struct(style.alias("style"), score.cast("double").alias("score"))


def clamp_step(v: Column) -> Column:
    """Step in -3..3; junk is 0."""
    return F.greatest(F.lit(-MAX_STEP), F.least(F.lit(MAX_STEP), F.coalesce(v.try_cast("int"), F.lit(0))))


def multiplier(step: Column) -> Column:
    return F.pow(F.lit(STEP_SCALE), clamp_step(step))


def surviving_drops(read: Column, drops: Column) -> Column:
    """Drops in order, without the one that would empty the read."""
    names = F.array_distinct(F.filter(F.transform(read, lambda e: e["style"]), lambda s: s.isNotNull()))
    start = F.struct(names.alias("left"), F.array().cast("array<string>").alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        refused = F.array_contains(acc["left"], d) & (F.size(acc["left"]) == 1)
        return F.when(refused, acc).otherwise(
            F.struct(
                F.array_remove(acc["left"], d).alias("left"),
                F.concat(acc["kept"], F.array(d)).alias("kept"),
            )
        )

    cleaned = clean_drops(F.coalesce(drops, F.array().cast("array<string>")))
    return F.aggregate(cleaned, start, step, lambda acc: acc["kept"])


def top_entries(read: Column, k: int) -> Column:
    """The k best entries: score descending, then original position."""
    tagged = F.transform(
        read, lambda e, i: F.struct((-e["score"]).alias("k"), i.alias("i"), e["style"].alias("style"), e["score"].alias("score"))
    )
    return F.transform(F.slice(F.array_sort(tagged), 1, k), lambda e: _entry(e["style"], e["score"]))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _mass(read: Column) -> Column:
    return F.aggregate(read, F.lit(0.0), lambda a, e: a + e["score"])


def adjust(read: Column, steps: Column, drops: Column, k: int = READ_LENGTH) -> Column:
    """The read after its hand adjustments, renormalised over the kept entries.

    Drops leave first; a raised style below the entry share of the remaining mass
    enters at that share; scores scale by their step; the k best are renormalised.
    """
    scored = F.transform(
        F.filter(read, lambda e: F.coalesce(e["style"], F.lit("")) != ""),
        lambda e: _entry(e["style"], F.greatest(F.lit(0.0), F.coalesce(e["score"], F.lit(0.0)))),
    )
    wanted = F.transform_values(
        F.coalesce(steps, F.create_map().cast("map<string,int>")), lambda s, v: clamp_step(v)
    )

    def kept(gone: Column) -> Column:
        return F.struct(
            F.filter(scored, lambda e: ~F.array_contains(gone, e["style"])).alias("read"),
            F.map_filter(wanted, lambda s, v: (v != 0) & ~F.array_contains(gone, s)).alias("steps"),
        )

    def scale(p: Column, entry: Column) -> Column:
        step_of = lambda s: F.coalesce(F.try_element_at(p["steps"], s), F.lit(0))
        names = F.transform(p["read"], lambda e: e["style"])
        heard = F.transform(p["read"], lambda e: let(step_of(e["style"]), lambda n: _entry(
            e["style"], F.when((n > 0) & (e["score"] < entry), entry).otherwise(e["score"]) * F.pow(F.lit(STEP_SCALE), n))))
        fresh = F.filter(F.map_entries(p["steps"]), lambda kv: (kv["value"] > 0) & ~F.array_contains(names, kv["key"]))
        return F.concat(heard, F.transform(fresh, lambda kv: _entry(kv["key"], entry * F.pow(F.lit(STEP_SCALE), kv["value"]))))

    def finish(scaled: Column) -> Column:
        best = lambda b: let(_mass(b), lambda m: F.transform(b, lambda e: _entry(e["style"], F.bround(e["score"] / m, 4))))
        return F.when(_mass(scaled) > 0, let(top_entries(scaled, k), best)).otherwise(_empty())

    return let(surviving_drops(read, drops), lambda gone: let(
        kept(gone), lambda p: let(_mass(p["read"]) * ENTRY_FRACTION, lambda entry: let(scale(p, entry), finish))))


def filled(read: Column) -> Column:
    """The read, or null when it is null or empty."""
    return F.when(F.size(F.coalesce(read, _empty())) > 0, read)


def base_read(relabel: Column, salience: Column, styles: Column) -> Column:
    """Re-label, else salience, else flat styles, else empty."""
    return F.coalesce(filled(relabel), filled(salience), filled(styles), _empty())


def adjusted_read(relabel: Column, salience: Column, styles: Column, steps: Column, drops: Column) -> Column:
    """The hand-adjusted blend, or null without adjustments."""
    touched = (F.coalesce(F.size(steps), F.lit(0)) > 0) | (F.coalesce(F.size(drops), F.lit(0)) > 0)
    blend = let(base_read(relabel, salience, styles), lambda base: let(adjust(base, steps, drops), filled))
    return F.when(touched, blend)


def identity(override: Column, relabel: Column, salience: Column, styles: Column, steps: Column, drops: Column) -> Column:
    """``struct(style, score, source, read)``: override, weights, relabel, salience, styles."""

    def answer(blend: Column) -> Column:
        forced = F.when(F.coalesce(override, F.lit("")) != "", F.array(_entry(override, F.lit(1.0))))
        read = F.coalesce(forced, blend, base_read(relabel, salience, styles))
        source = (
            F.when(forced.isNotNull(), "override").when(blend.isNotNull(), "weights")
            .when(filled(relabel).isNotNull(), "relabel").when(filled(salience).isNotNull(), "salience")
            .when(filled(styles).isNotNull(), "styles")
        )
        return let(read, lambda r: F.struct(
            F.try_element_at(r, F.lit(1))["style"].alias("style"),
            F.coalesce(F.bround(F.try_element_at(r, F.lit(1))["score"], 4), F.lit(0.0)).alias("score"),
            source.alias("source"),
            r.alias("read"),
        ))

    return let(adjusted_read(relabel, salience, styles, steps, drops), answer)


def identity_fields(ident: Column, base: Column, tag_text: Column, tag_key: Column, shown_key: Column, top: int = READ_LENGTH) -> Column:
    """What a view shows beside the identity: its read, the model's own read under an override, the tag's opinion."""
    agrees = F.when(tag_key.isNotNull() & shown_key.isNotNull(), tag_key == shown_key)
    return F.struct(
        ident["style"].alias("dominant_style"), ident["score"].alias("dominant_score"), ident["source"].alias("dominant_source"),
        F.slice(ident["read"], 1, top).alias("dominant_read"),
        F.when(ident["source"] == "override", F.slice(base, 1, top)).alias("model_read"),
        F.when(F.coalesce(F.trim(tag_text), F.lit("")) != "", F.struct(tag_text.alias("text"), tag_key.alias("keystone"), agrees.alias("agrees"))).alias("file_tag"),
    )


def candidates(read: Column, top_style: Column) -> Column:
    """Up to five runners-up worth offering, strongest first."""
    rounded = F.transform(read, lambda e: _entry(e["style"], F.bround(e["score"], 4)))
    return F.slice(
        F.filter(rounded, lambda e: (e["style"] != top_style) & (e["score"] >= CANDIDATE_FLOOR)), 1, CANDIDATE_LIMIT
    )


def second_style(read: Column, top_style: Column, top_score: Column, override: Column) -> Column:
    """``struct(style, weight)`` of the runner-up, weight ``s / (top + s)``; null under an override (P10)."""
    other = F.try_element_at(F.filter(read, lambda e: (e["style"] != top_style) & (e["score"] > 0)), F.lit(1))
    pair = F.struct(other["style"].alias("style"), F.bround(other["score"] / (top_score + other["score"]), 3).alias("weight"))
    return F.when((F.coalesce(override, F.lit("")) == "") & other.isNotNull(), pair)


def trim_flat(styles: Column) -> Column:
    """Entries at or above the floor, five at most, else just the first."""
    strong = F.filter(styles, lambda e: e["score"] >= FLAT_FLOOR)
    return F.when(F.size(strong) > 0, F.slice(strong, 1, FLAT_LIMIT)).otherwise(F.slice(styles, 1, 1))
