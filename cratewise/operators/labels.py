"""Label engineering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.ranks import group_rank
from . import taxonomy

# Label sources by priority, boundary count, readiness thresholds.
SOURCES = ["override", "weight", "id3-genre", "blind", "blind-contested"]
CONTESTED_BOUNDARIES = 3
READY, THIN = 20, 5


def genre_dims(labels: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(style spellings, parent spellings): folded key to canonical name, from ``Parent---Style`` labels."""
    parts = labels.select(
        F.regexp_extract(label, r"(?s)^(.*)---", 1).alias("parent"), F.regexp_extract(label, r"(?s)^(?:.*---)?(.*)$", 1).alias("style")
    )

    def spell(c: str) -> DataFrame:
        low = F.lower(T.squeeze(F.col(c)))
        keys = F.array_distinct(F.array(low, T.fold_and(low, hyphens=True)))
        rows = parts.where(F.col(c) != "").select(F.explode(keys).alias("k"), F.col(c).alias("genre"))
        return rows.groupBy("k").agg(F.min("genre").alias("genre"))

    return spell("style"), spell("parent")


def normalise_genres(names: DataFrame, name: str, styles: DataFrame, parents: DataFrame, order: str) -> DataFrame:
    """(name, genre, kind) of each distinct name.

    kind is style, parent, other, umbrella or null. Spellings tried: as written,
    without a parenthesis, then slash halves; styles win over parents over the
    first-seen spelling by ``order``.
    """
    raw = T.squeeze(F.coalesce(F.col(name), F.lit("")))
    distinct = names.groupBy(name).agg(F.min(order).alias("_o")).withColumn("_raw", raw)
    bare = F.trim(F.regexp_replace("_raw", r"\s*\([^)]*\)\s*", " "))
    whole = F.array_distinct(F.filter(F.array(F.col("_raw"), bare), lambda t: t != ""))
    halves = F.flatten(F.transform(F.filter(whole, lambda t: t.contains("/")), lambda t: F.transform(F.split(t, "/"), lambda h: F.trim(h))))
    low = F.transform(F.filter(F.concat(whole, halves), lambda t: t != ""), lambda t: F.lower(t))
    tries = distinct.select(name, F.posexplode(low).alias("p", "t")).select(
        name, "p", F.posexplode(F.array_distinct(F.array(F.col("t"), T.fold_and(F.col("t"), hyphens=True)))).alias("v", "k")
    )
    best = lambda dim, out: tries.join(dim, "k").groupBy(name).agg(F.min_by("genre", F.struct("p", "v")).alias(out))
    spelled = distinct.join(best(styles, "_s"), name, "left").join(best(parents, "_p"), name, "left")
    other = spelled.groupBy(F.lower("_raw").alias("_low")).agg(F.min_by("_raw", "_o").alias("_first"))
    empty = (F.col("_raw") == "") | F.col("_raw").rlike(r"^\(?\d+\)?$")
    return spelled.join(other, F.lower("_raw") == F.col("_low"), "left").select(
        name,
        F.when(empty | T.is_umbrella(F.col("_raw")), None).otherwise(F.coalesce("_s", "_p", "_first")).alias("genre"),
        F.when(empty, None).when(T.is_umbrella(F.col("_raw")), "umbrella").when(F.col("_s").isNotNull(), "style")
        .when(F.col("_p").isNotNull(), "parent").otherwise("other").alias("kind"),
    )


def normalise_tags(tags: DataFrame, tag: str, styles: DataFrame, parents: DataFrame, order: str) -> DataFrame:
    """(tag, genre, kind) of whole tag values, which may name several genres."""
    distinct = tags.groupBy(tag).agg(F.min(order).alias("_o"))
    parts = F.filter(F.split(tag, T.LABEL_SPLIT), lambda p: F.trim(p) != "")
    split = distinct.withColumn("parts", parts).withColumn("n", F.size("parts"))
    tall = split.select(tag, "n", "_o", F.posexplode(F.when(F.col("n") <= 1, F.array(F.col(tag))).otherwise(F.col("parts"))).alias("pos", "part"))
    named = normalise_genres(tall, "part", styles, parents, "_o")
    joined = tall.join(named, "part").withColumn("vague", T.is_vague(F.col("part")))
    live = F.when(~F.col("vague"), F.col("genre"))
    agg = joined.groupBy(tag).agg(
        F.max("n").alias("n"), F.count_distinct(live).alias("found"), F.min_by(F.struct("genre", "kind"), F.when(live.isNotNull(), F.col("pos"))).alias("g"),
        F.bool_or("vague").alias("vague"), F.bool_or(~F.col("vague") & (F.coalesce("kind", F.lit("")) == "umbrella")).alias("umbrella"),
        F.first("kind").alias("only"),
    )
    return agg.select(
        tag, F.when(F.col("found") == 1, F.col("g.genre")).alias("genre"),
        F.when((F.col("found") > 1) | ((F.col("found") == 0) & F.col("vague")), "ambiguous")
        .when(F.col("found") == 1, F.col("g.kind")).when(F.col("umbrella"), "umbrella").alias("kind"),
    )


def tag_keystones(tags: DataFrame, tag: str, overlay: taxonomy.Overlay = taxonomy.Overlay(), graph: DataFrame | None = None) -> DataFrame:
    """(tag, keystone) per distinct tag: the one keystone its specific parts agree on, else null (F16).

    ``graph`` is the genre graph's (name, keystone), asked after the tables.
    """
    distinct = tags.select(tag).where(F.col(tag).isNotNull()).distinct()
    parts = distinct.select(tag, F.explode(T.tag_parts(F.col(tag))).alias("part"))
    names = taxonomy.placed_names(parts, "part", overlay, graph).withColumnRenamed("keystone", "k")
    found = parts.join(names, "part").groupBy(tag).agg(F.count_distinct("k").alias("n"), F.max("k").alias("k"))
    return distinct.join(found, tag, "left").select(tag, F.when(F.col("n") == 1, F.col("k")).alias("keystone"))


def agreement(tag_keystone: Column, shown_keystone: Column) -> Column:
    """True, False, or null when either side has no keystone (F16)."""
    return F.when(tag_keystone.isNotNull() & shown_keystone.isNotNull(), tag_keystone == shown_keystone)


def contested_order(rows: DataFrame, key: str, a: str = "tag_keystone", b: str = "read_keystone", seed: int = 0) -> DataFrame:
    """(key, boundary, tier, turn): tracks whose two keystones differ, in labelling order.

    The three largest boundaries take turns first, then the rest take turns. Inside
    a boundary the order is a seeded hash. Sort by (tier, turn, place).
    """
    pairs = rows.where(F.col(a) != F.col(b)).select(
        key, F.concat_ws(" + ", F.least(a, b), F.greatest(a, b)).alias("boundary")
    )
    sizes = pairs.groupBy("boundary").agg(F.count(F.lit(1)).alias("size"))
    # One row per pair of keystones.
    place = F.row_number().over(Window.orderBy(F.desc("size"), "boundary"))
    placed = sizes.withColumn("place", place).withColumn("tier", F.when(F.col("place") <= CONTESTED_BOUNDARIES, 0).otherwise(1))
    turns = group_rank(pairs, ["boundary"], [F.xxhash64(F.lit(seed), F.col(key)), F.col(key)], out="turn")
    return turns.join(placed.drop("size"), "boundary").select(key, "boundary", "tier", "turn", "place")


def unlabelled(tracks: DataFrame, labels: DataFrame, skip: DataFrame, key: str, path: str | None = None) -> DataFrame:
    """Tracks with a path that are neither labelled nor in ``skip``: the pool of the queue."""
    pool = tracks if path is None else tracks.where(F.coalesce(path, F.lit("")) != "")
    return pool.join(labels.select(key), key, "left_anti").join(skip.select(key), key, "left_anti")


def next_unlabelled(tracks: DataFrame, labels: DataFrame, skip: DataFrame, key: str, path: str | None = None, seed: int = 0, limit: int = 1) -> DataFrame:
    """Unlabelled tracks with a path and not in ``skip``, in seeded random order."""
    left = unlabelled(tracks, labels, skip, key, path)
    return left.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(limit)


def label_union(sources: dict[str, DataFrame], tracks: DataFrame, key: str) -> DataFrame:
    """(key, genre, source) of every source, one row per (track, source), orphans dropped."""
    union = None
    for name, df in sources.items():
        part = df.groupBy(key).agg(F.min("genre").alias("genre")).where(F.col("genre").isNotNull()).withColumn("source", F.lit(name))
        union = part if union is None else union.unionByName(part)
    return union.join(tracks.select(key), key, "left_semi")


def resolve_priority(labels: DataFrame, key: str, priority: list[str]) -> DataFrame:
    """One label per track, the first of ``priority`` that labels it."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("source"))
    rest = [c for c in labels.columns if c != key]
    return labels.where(rank > 0).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(rank, *rest)).alias("_r")).select(key, "_r.*")


def complete_rows(embedded: DataFrame, key: str, candidates: int, classes: DataFrame, label: str, folds: int) -> DataFrame:
    """(key, label) embedded by every candidate, in classes of at least ``folds`` tracks."""
    whole = embedded.groupBy(key).agg(F.count_distinct("candidate").alias("n")).where(F.col("n") == candidates)
    kept = classes.join(whole.select(key), key, "left_semi")
    large = kept.groupBy(label).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= folds).select(label)
    return kept.join(large, label, "left_semi").select(key, label)


def exclusion_reason(keystone: Column, path: Column, mounted: Column, present: Column) -> Column:
    """Why a labelled track cannot be used, first rule that applies; null when it can."""
    return (
        F.when(F.coalesce(keystone, F.lit("")) == "", "no keystone")
        .when(F.coalesce(path, F.lit("")) == "", "no path")
        .when(~mounted, "unavailable").when(~present, "missing")
    )


def exclusion_report(labels: DataFrame, key: str, folds: int) -> DataFrame:
    """(reason, n) over (key, keystone, reason); classes below ``folds`` are counted as dropped."""
    sizes = labels.where(F.col("reason").isNull()).groupBy("keystone").agg(F.count(F.lit(1)).alias("n"))
    kept = sizes.select(F.when(F.col("n") < folds, "dropped class").otherwise("used").alias("reason"), "n")
    out = labels.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(kept).groupBy("reason").agg(F.sum("n").alias("n"))


def label_report(labels: DataFrame) -> DataFrame:
    """(source, kind, n, genres, respelled) of a label set with the raw spelling."""
    return labels.groupBy("source", "kind").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("genre").alias("genres"),
        F.count_if(F.col("genre") != F.col("raw")).alias("respelled"),
    )


def readiness(examples: DataFrame, genre: str = "genre") -> DataFrame:
    """(genre, n, state, needs): ready from 20 examples, thin from 5, else sparse."""
    n = F.col("n")
    return examples.groupBy(genre).agg(F.count(F.lit(1)).alias("n")).select(
        genre, "n", F.when(n >= READY, "ready").when(n >= THIN, "thin").otherwise("sparse").alias("state"),
        F.greatest(F.lit(0).cast("long"), F.lit(READY) - n).alias("needs"),
    )


def relabel_status(tracks: DataFrame, head: str, current: str) -> DataFrame:
    """One row: total, relabelled, distinct heads, stale."""
    return tracks.agg(
        F.count(F.lit(1)).alias("total"), F.count(head).alias("relabelled"), F.count_distinct(head).alias("heads"),
        F.coalesce(F.bool_or(F.col(head) != current), F.lit(False)).alias("stale"),
    )


def head_counts(tracks: DataFrame, head: str) -> DataFrame:
    """(head, n) over re-labelled tracks."""
    return tracks.where(F.col(head).isNotNull()).groupBy(head).agg(F.count(F.lit(1)).alias("n"))


def manifest(folder: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(key, source): folder hashes first, then label rows, each hash once."""
    union = folder.select(key, F.lit("folder").alias("source"), F.lit(0).alias("p")).unionByName(
        labels.select(key, F.coalesce("source", F.lit("label")).alias("source"), F.lit(1).alias("p"))
    )
    return union.groupBy(key).agg(F.min_by("source", F.struct("p", "source")).alias("source"))


def import_manifest(wanted: DataFrame, tracks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(found, missing) manifest entries, position kept."""
    return wanted.join(tracks.select(key), key, "left_semi"), wanted.join(tracks.select(key), key, "left_anti")


def vocabulary(*names: DataFrame) -> DataFrame:
    """(genre): distinct union of name tables, in order without case (U4)."""
    union = names[0].select(F.col(names[0].columns[0]).alias("genre"))
    for other in names[1:]:
        union = union.union(other.select(other.columns[0]))
    return union.where(F.col("genre").isNotNull()).distinct().orderBy(F.lower("genre"), "genre")
