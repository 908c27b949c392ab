"""Style to keystone resolution and track classification.

Names are few against rows, so a name is resolved once: the distinct names become a
small ``(style, keystone)`` table that the reads then join.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import fold_and, squeeze
from ..plans.guards import cut_lineage

GRAPH_DEPTH = 5


@dataclass(frozen=True)
class Overlay:
    """A user's departures from the built-in tables (T5, T7); every map may be empty."""

    aliases: dict[str, str] = field(default_factory=dict)
    archgenre: dict[str, str] = field(default_factory=dict)
    family: dict[str, str] = field(default_factory=dict)
    order: list[str] = field(default_factory=list)


def _table(entries: dict[str, str]) -> Column:
    return dims.map_column(entries)


def _get(entries: dict[str, str], key: Column) -> Column:
    return F.try_element_at(_table(entries), key)


def _looks_metal(style: Column) -> Column:
    return style.contains("metal") | style.contains("grind") | style.isin(dims.METAL_EXTRA)


def _looks_punk(style: Column) -> Column:
    return style.contains("punk") | style.isin(dims.PUNK_EXTRA)


def _rock(style: Column) -> Column:
    return F.when(_looks_metal(style), "Metal").when(_looks_punk(style), "Punk").otherwise("Rock")


def head_noun(style: Column) -> Column:
    """Keystone of the rightmost, then longest, known phrase inside a compound name."""
    known = {**dims.OVERRIDES, **dims.TYPED_NAMES, **dims.style_table()}
    words = F.filter(F.split(style, r"\s+"), lambda w: w != "")
    ends = F.when(F.size(words) > 0, F.sequence(F.size(words), F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    phrases = F.flatten(F.transform(ends, lambda e: F.transform(
        F.sequence(F.lit(1), e), lambda b: F.array_join(F.slice(words, b, e - b + 1), " "))))
    hits = F.filter(
        F.transform(F.filter(phrases, lambda p: p != style), lambda p: F.try_element_at(_table(known), p)), lambda k: k.isNotNull()
    )
    return F.try_element_at(hits, F.lit(1))


def _parts(label: Column) -> tuple[Column, Column]:
    tail = F.lower(F.trim(F.regexp_extract(label, r"(?s)^(?:.*---)?(.*)$", 1)))
    parent = F.regexp_extract(label, r"(?s)^(.*)---", 1)
    return parent, tail


def _by_parent(parent: Column, style: Column) -> Column:
    return (
        F.when(parent == "Rock", _rock(style))
        .when(parent == "Electronic", _get(dims.style_table(), style))
        .when(parent.isin(dims.PARENT_KEYSTONES), parent)
    )


def _bare(style: Column) -> Column:
    """Tables and the rock look for a style without a parent."""
    return F.coalesce(
        _get(dims.style_table(), style), _get(dims.TYPED_NAMES, style),
        F.when(_looks_metal(style) | _looks_punk(style), _rock(style)),
    )


def keystone(label: Column, overlay: Overlay = Overlay(), lexicon: Column | None = None) -> Column:
    """Keystone of one label, ``Parent---Style`` or a bare style.

    ``lexicon`` is what the genre graph says about the bare name (see
    :func:`graph_keystones`); it stands before the head-noun guess.
    """
    parent, style = _parts(label)
    alias = F.when(parent.isin("", "Electronic"), _get({k.lower(): v for k, v in overlay.aliases.items()}, style))
    bare = F.coalesce(_bare(style), *([lexicon] if lexicon is not None else []), head_noun(style))
    chain = F.coalesce(
        alias, _get(dims.OVERRIDES, style), F.when(parent != "", _by_parent(parent, style)).otherwise(bare)
    )
    return F.when(F.coalesce(style, F.lit("")) != "", chain)


def style_dim(names: DataFrame, name: str, overlay: Overlay = Overlay(), graph: DataFrame | None = None) -> DataFrame:
    """Distinct names with their keystones, unresolved names kept with null.

    ``graph`` is the ``(name, keystone)`` table of :func:`graph_keystones`.
    """
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    if graph is None:
        return distinct.withColumn("keystone", keystone(F.col(name), overlay))
    hits = graph.select(F.col("name").alias("_n"), F.col("keystone").alias("_lex"))
    return (
        distinct.join(hits, F.lower(F.trim(name)) == F.col("_n"), "left")
        .withColumn("keystone", keystone(F.col(name), overlay, F.col("_lex"))).select(name, "keystone")
    )


def graph_keystones(genres: DataFrame, overlay: Overlay = Overlay(), depth: int = GRAPH_DEPTH) -> DataFrame:
    """(name, keystone) for every name and alias the genre graph can place.

    ``genres`` is (pos, name, aliases array, parents array), ``pos`` the place of the
    record. A spelling belongs to the first record that has it as name or alias. It takes
    the answer of that record's own name, then the nearest ancestor with one, five levels
    at most; among equally near ancestors the earlier listed parent wins; last comes the
    own name with ``&`` / ``and`` folded. Names already visited are not walked again, so
    cycles end.
    """
    low = lambda c: F.lower(F.trim(c))
    base = genres.select("pos", F.trim("name").alias("own"), "aliases", "parents").where(F.coalesce("own", F.lit("")) != "")
    spelled = F.concat(F.array("own"), F.coalesce("aliases", F.array().cast("array<string>")))
    index = (
        base.select(F.col("pos").alias("node"), F.posexplode(spelled).alias("slot", "raw")).withColumn("name", low("raw"))
        .where(F.coalesce("name", F.lit("")) != "").groupBy("name").agg(F.min(F.struct("node", "slot")).alias("m")).select("name", "m.node")
    )
    edges = base.select(F.col("pos").alias("node"), F.posexplode("parents").alias("pos", "p")).select(
        "node", "pos", F.trim("p").alias("p"), low("p").alias("pn")
    )
    # Parents and own names are resolved once each, not once per path that meets them.
    wanted = edges.select("p").union(base.select("own")).union(base.select(fold_and(F.col("own")))).distinct()
    answers = cut_lineage(wanted.withColumn("keystone", keystone(F.col("p"), overlay)))
    edges = cut_lineage(edges.join(answers, "p").select("node", "pos", "pn", "keystone"))
    names = cut_lineage(index.join(base.select(F.col("pos").alias("node"), "own"), "node").withColumn("canon", F.lower("own")))
    of = answers.where("keystone is not null").select(F.col("p").alias("own"), "keystone")
    done = names.where(F.col("name") != F.col("canon")).join(of, "own").select("name", "keystone")
    frontier = names.join(done.select("name"), "name", "left_anti").select("name", "node", F.array().cast("array<int>").alias("path"))
    seen = names.select("name", F.col("name").alias("pn")).union(names.select("name", "canon")).distinct()
    links = names.select(F.col("name").alias("pn"), F.col("node").alias("next"))
    for _ in range(depth):
        steps = frontier.join(edges, "node").join(seen, ["name", "pn"], "left_anti")
        steps = cut_lineage(
            steps.withColumn("path", F.concat("path", F.array("pos"))).groupBy("name", "pn")
            .agg(F.min("path").alias("path"), F.max("keystone").alias("keystone"))
        )
        if steps.isEmpty():
            break
        hits = steps.where(F.col("keystone").isNotNull()).groupBy("name").agg(F.min_by("keystone", "path").alias("keystone"))
        done = done.unionByName(hits)
        seen = seen.unionByName(steps.select("name", "pn"))
        frontier = steps.join(hits.select("name"), "name", "left_anti").join(links, "pn").select("name", F.col("next").alias("node"), "path")
    left = names.join(done.select("name"), "name", "left_anti").withColumn("own", fold_and(F.col("own")))
    return done.unionByName(left.join(of, "own").select("name", "keystone"))


def placed_names(names: DataFrame, name: str, overlay: Overlay = Overlay(), graph: DataFrame | None = None) -> DataFrame:
    """(name, keystone) of typed or tagged names: the tables, the genre graph, then the head noun, as written and folded (F16).

    ``graph`` is the table of :func:`graph_keystones`; without it only the tables answer.
    """
    tidy = names.select(name).distinct().withColumn("_t", squeeze(F.col(name))).withColumn("_f", fold_and(F.col("_t")))
    if graph is None:
        return tidy.select(name, name_keystone(F.col(name), overlay).alias("keystone"))
    for spelling, out in (("_t", "_gt"), ("_f", "_gf")):
        hits = graph.select(F.col("name").alias("_n"), F.col("keystone").alias(out))
        tidy = tidy.join(hits, F.lower(spelling) == F.col("_n"), "left").drop("_n")
    answer = F.coalesce(keystone(F.col("_t"), overlay, F.col("_gt")), keystone(F.col("_f"), overlay, F.col("_gf")))
    return tidy.select(name, answer.alias("keystone"))


def name_keystone(name: Column, overlay: Overlay = Overlay()) -> Column:
    """Keystone of a typed or tagged name, as written and with ``&`` / ``and`` folded (F16)."""
    tidy = squeeze(name)
    return F.coalesce(keystone(tidy, overlay), keystone(fold_and(tidy), overlay))


def family(key: Column, overlay: Overlay = Overlay()) -> Column:
    """Family of a keystone; the user's entry wins, unknown is Other (T5)."""
    return F.coalesce(F.nullif(_get(overlay.family, key), F.lit("")), _get(dims.family_table(), key), F.lit(dims.OTHER))


def archgenre(key: Column, overlay: Overlay = Overlay()) -> Column:
    """Archgenre of a keystone; a user's blank entry means it stands alone (T5)."""
    chosen = _get(overlay.archgenre, key)
    return (
        F.when(key.isNull() | (family(key, overlay) == dims.OTHER), dims.OTHER)
        .when(chosen.isNotNull(), F.coalesce(F.nullif(chosen, F.lit("")), key))
        .otherwise(F.coalesce(_get(dims.ARCHGENRE_OF, key), key))
    )


def group_key(keystones: Column) -> Column:
    """Order-independent key of a keystone set."""
    return F.array_join(F.array_sort(keystones), " + ")


def blend_label(keystones: Column) -> Column:
    """One keystone as it stands, a named blend, else a slash."""
    named = F.coalesce(
        *[F.when(group_key(keystones) == " + ".join(sorted((a, b))), F.lit(n)) for a, b, n in dims.FUSION_NAMES], F.lit(None)
    )
    return F.when(F.size(keystones) == 1, keystones[0]).otherwise(F.coalesce(named, F.array_join(keystones, " / ")))


def tally(reads: DataFrame, key: str, styles: DataFrame, tiers: bool = False) -> DataFrame:
    """(key, [tier], keystone, weight, share) of tall reads (key, [tier], pos, style, score).

    ``styles`` is a (style, keystone) table. Scores at or below zero and styles
    without a keystone do not count; shares are of the covered weight.
    """
    by = [key, "tier"] if tiers else [key]
    covered = reads.where(F.col("score") > 0).join(styles.where(F.col("keystone").isNotNull()), "style")
    weights = covered.groupBy(*by, "keystone").agg(F.sum("score").alias("weight"), F.min("pos").alias("pos"))
    total = F.sum("weight").over(Window.partitionBy(*by))  # at most one row per keystone
    return weights.withColumn("share", F.col("weight") / total)


def classify(reads: DataFrame, key: str, styles: DataFrame, overrides: DataFrame | None = None, overlay: Overlay = Overlay()) -> DataFrame:
    """Keystone identity per track from tall reads (key, tier, pos, style, score).

    The lowest tier with any keystone weight decides; a second keystone stays at a
    share of 0.35 or more. ``overrides`` (key, override) short-circuit the read.
    Rows: key, keystones, share, label, group, family, archgenre, cross_family, fusion.
    """
    weights = tally(reads, key, styles, tiers=True)
    # Few rows per key: one per tier and keystone.
    tier = F.min("tier").over(Window.partitionBy(key))
    order = Window.partitionBy(key).orderBy(F.desc("weight"), "pos", "keystone")
    ranked = (
        weights.withColumn("_t", tier).where(F.col("tier") == F.col("_t"))
        .withColumn("_n", F.row_number().over(order))
        .where((F.col("_n") == 1) | ((F.col("_n") == 2) & (F.col("share") >= dims.FUSION_THRESHOLD)))
    )
    picked = ranked.groupBy(key).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_n", "keystone"))), lambda e: e["keystone"]).alias("keystones"),
        F.bround(F.max(F.when(F.col("_n") == 1, F.col("share"))), 4).alias("share"),
    )
    if overrides is not None:
        forced = overrides.where(F.coalesce("override", F.lit("")) != "").select(
            key, F.array(F.coalesce(keystone(F.col("override"), overlay), "override")).alias("keystones"), F.lit(1.0).alias("share")
        )
        picked = picked.join(forced.select(key), key, "left_anti").unionByName(forced)
    families = F.array_distinct(F.transform("keystones", lambda k: family(k, overlay)))
    return picked.select(
        key, "keystones", "share",
        blend_label(F.col("keystones")).alias("label"),
        group_key(F.col("keystones")).alias("group"),
        family(F.col("keystones")[0], overlay).alias("family"),
        archgenre(F.col("keystones")[0], overlay).alias("archgenre"),
        (F.size(families) > 1).alias("cross_family"),
        (F.size("keystones") > 1).alias("fusion"),
    )


def classification_records(
    reads: DataFrame, key: str, styles: DataFrame, overrides: DataFrame | None = None, overlay: Overlay = Overlay()
) -> DataFrame:
    """The whole identity of a track from tall reads (key, tier, pos, style, score).

    Rows: key, keystones, shares (keystone -> share of the covered weight), label, group,
    family, families, archgenre, archgenres, cross_family, subgenres (style, score,
    keystone; keystones by weight, styles by score), fusion, override. The lowest tier
    with any keystone weight decides. ``overrides`` (key, override) stand alone with
    their own name as subgenre, covered or not. Tracks without a keystone have no row.
    """
    covered = reads.where(F.col("score") > 0).join(styles.where(F.col("keystone").isNotNull()), "style")
    per_keystone = covered.groupBy(key, "tier", "keystone").agg(
        (-F.sum("score")).alias("w"), F.min("pos").alias("pos"),
        # a track's styles of one keystone
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "style"))).alias("subs"),
    )
    ranked = per_keystone.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("tier", "w", "pos", "keystone", "subs"))).alias("ks"))
    ranked = ranked.withColumn("ks", F.filter("ks", lambda k: k["tier"] == F.col("ks")[0]["tier"]))
    total = F.aggregate("ks", F.lit(0.0), lambda t, k: t + k["w"])
    read = ranked.withColumn("total", total).select(
        key,
        F.transform(
            F.filter("ks", lambda k, i: (i == 0) | ((i == 1) & (k["w"] / F.col("total") >= dims.FUSION_THRESHOLD))), lambda k: k["keystone"]
        ).alias("keystones"),
        F.map_from_arrays(F.transform("ks", lambda k: k["keystone"]), F.transform("ks", lambda k: F.bround(k["w"] / F.col("total"), 4))).alias("shares"),
        F.flatten(F.transform("ks", lambda k: F.transform(
            k["subs"], lambda s: F.struct(s["style"].alias("style"), (-s["s"]).cast("double").alias("score"), k["keystone"].alias("keystone"))
        ))).alias("subgenres"),
        F.lit(False).alias("override"),
    )
    if overrides is not None:
        typed = overrides.where(F.coalesce("override", F.lit("")) != "").withColumn("_k", F.coalesce(keystone(F.col("override"), overlay), "override"))
        forced = typed.select(
            key, F.array("_k").alias("keystones"), F.create_map("_k", F.lit(1.0)).alias("shares"),
            F.array(F.struct(F.col("override").alias("style"), F.lit(1.0).alias("score"), F.col("_k").alias("keystone"))).alias("subgenres"),
            F.lit(True).alias("override"),
        )
        read = read.join(forced.select(key), key, "left_anti").unionByName(forced)
    families = F.array_distinct(F.transform("keystones", lambda k: family(k, overlay)))
    arches = F.array_distinct(F.transform("keystones", lambda k: archgenre(k, overlay)))
    return read.withColumns({"families": families, "archgenres": arches}).select(
        key, "keystones", "shares", blend_label(F.col("keystones")).alias("label"), group_key(F.col("keystones")).alias("group"),
        F.col("families")[0].alias("family"), "families", F.col("archgenres")[0].alias("archgenre"), "archgenres",
        (F.size("families") > 1).alias("cross_family"), "subgenres", (F.size("keystones") > 1).alias("fusion"), "override",
    )


def dominant_subgenre(reads: DataFrame, key: str, styles: DataFrame) -> DataFrame:
    """The strongest style within each keystone of a track (T4); tall reads (key, pos, style, score)."""
    covered = reads.where(F.col("score") > 0).join(styles.where(F.col("keystone").isNotNull()), "style")
    return covered.groupBy(key, "keystone").agg(
        F.max_by(F.struct("style", "score"), F.struct("score", -F.col("pos"))).alias("s")
    ).select(key, "keystone", F.col("s.style").alias("subgenre"), F.col("s.score").alias("score"))


def clean_overlay(entries: DataFrame) -> DataFrame:
    """Well-formed overlay entries (section, name, value): trimmed, aliases lower-cased.

    A blank value stays only for an archgenre, where it means "stands alone".
    """
    tidy = entries.select(
        "section", F.when(F.col("section") == "aliases", F.lower(F.trim("name"))).otherwise(F.trim("name")).alias("name"),
        F.trim("value").alias("value"), *[c for c in entries.columns if c not in ("section", "name", "value")],
    )
    sections = ["aliases", "archgenre", "family", "colors", "hidden", "order", "palette"]
    return tidy.where(
        F.col("section").isin(sections) & (F.col("name") != "")
        & ((F.coalesce("value", F.lit("")) != "") | (F.col("section") == "archgenre"))
    )


def patch_overlay(events: DataFrame) -> DataFrame:
    """Current entries from patch events (section, name, value, updated): a null value removes."""
    name = F.when(F.col("section") == "aliases", F.lower(F.trim("name"))).otherwise(F.trim("name"))
    latest = events.withColumn("name", name).where(F.col("name") != "").groupBy("section", "name").agg(
        F.max_by(F.struct("value"), "updated").alias("v")
    ).select("section", "name", F.col("v.value").alias("value"))
    return clean_overlay(latest.where(F.col("value").isNotNull()))


def genre_tracks(tracks: DataFrame, key: str, genre: str, labels: DataFrame, rejects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks of a genre best first with in_training, counts of labels and rejects) (T11, E6 matching).

    ``tracks`` is (key, style, keystone, score). A track belongs when its style or
    its keystone equals the genre in any case.
    """
    want = F.lower(F.trim(F.lit(genre)))
    mine = labels.where(F.lower("genre") == want)
    members = mine.select(key).distinct().withColumn("in_training", F.lit(True))
    hits = tracks.where((F.lower("style") == want) | (F.lower("keystone") == want)).join(members, key, "left")
    listing = hits.select(key, "style", F.bround("score", 4).alias("score"), F.coalesce("in_training", F.lit(False)).alias("in_training"))
    counts = mine.select(key, F.lit("labelled").alias("what")).unionByName(
        rejects.where(F.lower("genre") == want).select(key, F.lit("rejected").alias("what"))
    ).groupBy("what").agg(F.count_distinct(key).alias("n"))
    return listing.orderBy(F.desc("score"), key), counts
