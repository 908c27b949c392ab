"""Genre reference data: merging sources, coverage and graph depth."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.guards import cut_lineage

RESOURCE = "http://dbpedia.org/resource/"
DEPTH_LIMIT = 64


def pretty_value(value: Column) -> Column:
    """A resource address as its article title, anything else as plain text."""
    v = F.trim(F.coalesce(value, F.lit("")))
    title = F.translate(F.try_url_decode(F.regexp_replace(v, "^" + re.escape(RESOURCE), "")), "_", " ")
    return T.strip_html(F.when(v.startswith(RESOURCE), title).otherwise(v))


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """(keys, values): values of each subject in first-seen order, blanks out.

    A subject's own list: bounded by what one article names.
    """
    first = rows.where(F.coalesce(value, F.lit("")) != "").groupBy(*keys, value).agg(F.min(pos).alias("_p"))
    packed = first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_p", value))).alias("_l"))
    return packed.select(*keys, F.transform("_l", lambda e: e[value]).alias("values"))


def clean_relations(rows: DataFrame, value: str, own: str) -> DataFrame:
    """Relation rows without self references, list pages and blanks."""
    folded = rows.withColumn("_v", T.name_key(F.col(value))).withColumn("_o", T.name_key(F.col(own)))
    return folded.where((F.col("_v") != "") & (F.col("_v") != F.col("_o")) & ~F.col("_v").startswith("list of ")).drop("_v", "_o")


def split_names(value: Column) -> Column:
    """Names of a comma or semicolon list."""
    return F.filter(F.transform(F.split(pretty_value(value), "[,;]"), lambda p: F.trim(p)), lambda p: p != "")


def build_records(items: DataFrame, aliases: DataFrame, relations: DataFrame, infobox: DataFrame, pages: DataFrame, root: str) -> DataFrame:
    """One record per genre from five sources.

    items (id, name, description, inception, title); aliases (id, pos, alias);
    relations (id, field, pos, target) with field "parents" feeding the depth;
    infobox (title, field, pos, value); pages (title, excerpt, description, covered_by).
    The item's own values win; infobox years and page descriptions only fill gaps.
    """
    base = items.select(
        "id", "name", T.name_key(F.col("name")).alias("key"), T.blank_to_null(F.coalesce("description", F.lit(""))).alias("own_text"),
        T.year_of(F.col("inception")).alias("own_year"), "title",
    )
    labels = items.select(F.col("id").alias("target"), F.col("name").alias("_label"))
    named = relations.join(labels, "target", "left").withColumn("value", F.coalesce("_label", "target"))
    rel = ordered_distinct(named, ["id", "field"], "value", "pos").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("relations"))
    boxed = infobox.join(base.select("id", "name", "title"), "title")
    origin = boxed.where(F.col("field") == "cultural_origins").groupBy("id").agg(F.min(T.year_of(F.col("value"))).alias("box_year"))
    placed = lambda source: F.struct(F.lit(source).alias("source"), F.col("pos").alias("at"))
    others = boxed.where(F.col("field") == "other_names").select("id", placed(1).alias("pos"), F.explode(split_names(F.col("value"))).alias("alias"))
    known = aliases.select("id", T.name_key(F.col("alias")).alias("k")).unionByName(base.select("id", F.col("key").alias("k"))).distinct()
    fresh = others.withColumn("k", T.name_key(F.col("alias"))).join(known, ["id", "k"], "left_anti").drop("k")
    names = ordered_distinct(aliases.select("id", placed(0).alias("pos"), "alias").unionByName(fresh.select("id", "pos", "alias")), ["id"], "alias", "pos")
    fields = boxed.where(~F.col("field").isin("cultural_origins", "other_names")).withColumn("value", pretty_value(F.col("value")))
    box = ordered_distinct(clean_relations(fields, "value", "name"), ["id", "field"], "value", "pos").groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("field", "values"))).alias("infobox")
    )
    in_box = boxed.select("id").distinct().withColumn("_box", F.lit("dbpedia"))
    page = pages.select("title", T.blank_to_null(F.col("excerpt")).alias("excerpt"), T.blank_to_null(F.col("description")).alias("page_text"), "covered_by", F.lit("wikipedia").alias("_page"))
    edges = relations.where(F.col("field") == "parents").select(F.col("id").alias("child"), F.col("target").alias("parent"))
    depth = graph_depth(edges, root).select(F.col("node").alias("id"), "depth")
    joined = base
    for part in (rel, box, origin, names.withColumnRenamed("values", "aliases"), in_box, depth):
        joined = joined.join(part, "id", "left")
    joined = joined.join(page, "title", "left")
    return joined.select(
        "id", "name", "key", F.coalesce("own_text", "page_text", F.lit("")).alias("description"),
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
        F.col("depth").alias("electronic_depth"), F.coalesce("own_year", "box_year").alias("origin_year"),
        "relations", "infobox", "title", "excerpt", "covered_by",
        F.array_compact(F.array(F.lit("wikidata"), F.col("_box"), F.col("_page"))).alias("sources"),
    )


def cross_reference(records: DataFrame, vocabulary: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(matched names, unmatched names) against record names, aliases and ids.

    ``records`` is (key, aliases array, external_id).
    """
    known = records.select(F.col("key").alias("k")).unionByName(
        records.select(F.explode("aliases").alias("a")).select(T.name_key(F.col("a")).alias("k"))
    ).unionByName(records.where(F.col("external_id").isNotNull()).select(T.name_key(F.col("external_id")).alias("k"))).distinct()
    folded = vocabulary.select(name, T.name_key(F.col(name)).alias("k"))
    return folded.join(known, "k", "left_semi").select(name), folded.join(known, "k", "left_anti").select(name)


def field_coverage(records: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(field, n): non-empty values per column; zero counts as present."""
    kinds = dict(records.dtypes)
    columns = columns or records.columns

    def present(c: str) -> Column:
        if kinds[c].startswith(("array", "map")):
            return F.coalesce(F.size(F.col(c)) > 0, F.lit(False))
        if kinds[c] == "string":
            return F.coalesce(F.col(c) != "", F.lit(False))
        return F.col(c).isNotNull()

    wide = records.agg(*[F.count_if(present(c)).alias(c) for c in columns])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in columns])).alias("e")).select("e.*")


def graph_depth(edges: DataFrame, root, max_depth: int = DEPTH_LIMIT) -> DataFrame:
    """(node, depth): shortest distance from ``root`` down (child, parent) edges; cycles end.

    One frontier join per level, each level written out, so only newly reached
    nodes enter the next join and no level is worked out twice.
    """
    kind = edges.schema["child"].dataType
    seen = edges.sparkSession.range(1).select(F.lit(root).cast(kind).alias("node"), F.lit(0).alias("depth"))
    frontier = seen
    links = edges.select("child", "parent").distinct()
    for level in range(1, max_depth + 1):
        reached = frontier.select(F.col("node").alias("parent")).join(links, "parent").select(F.col("child").alias("node")).distinct()
        fresh = cut_lineage(reached.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)))
        if fresh.isEmpty():
            break
        seen, frontier = seen.unionByName(fresh), fresh
    return seen


def dictionary_stats(genres: DataFrame) -> DataFrame:
    """One row: genres, names with aliases, genres with prose.

    ``genres`` is (name, aliases array, excerpt).
    """
    low = lambda c: F.lower(F.trim(c))
    names = genres.select(F.explode(F.array_append("aliases", F.col("name"))).alias("n")).where(low(F.col("n")) != "")
    spoken = names.agg(F.count_distinct(low(F.col("n"))).alias("x")).select("x").scalar()
    return genres.where(low(F.col("name")) != "").agg(
        F.count_distinct(low(F.col("name"))).alias("genres"),
        F.count_distinct(F.when(F.trim(F.coalesce("excerpt", F.lit(""))) != "", low(F.col("name")))).alias("with_prose"),
    ).withColumn("names_incl_aliases", spoken)


def genre_names(genres: DataFrame) -> DataFrame:
    """Canonical names, sorted."""
    return genres.select("name").where(F.coalesce("name", F.lit("")) != "").distinct().orderBy("name")
