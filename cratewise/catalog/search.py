"""Search, facet, harmonic, tag and playlist queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import music, text as T
from ..operators import search
from .registry import query, table


def _library(spark, d):
    """Suppliers as library rows."""
    s = table(spark, d, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("hash"), F.when(F.col("s_acctbal") < 1000, "").otherwise(F.concat("s_name", F.lit(" - Mix "), F.col("s_nationkey").cast("string"))).alias("title"),
        F.concat(F.lit("crate/"), F.col("s_name"), F.lit(" - take.v2.mp3")).alias("filename"), F.when(F.col("s_nationkey") == 3, F.lit(" ")).otherwise(F.concat(F.lit("/m/"), F.col("s_name"))).alias("filepath"),
        F.when(F.col("s_nationkey") < 5, "Solo").otherwise("").alias("tag_artist"), F.lit("House").alias("style"), F.round(F.col("s_acctbal") / 50, 1).alias("bpm"),
        F.lit("C").alias("key"), F.lit("minor").alias("scale"), F.lit("5A").alias("camelot"), F.lit(61.5).alias("duration"), F.col("s_acctbal").alias("created"),
    )


LIBRARY = """lib AS (SELECT s_suppkey::VARCHAR AS hash, CASE WHEN s_acctbal < 1000 THEN '' ELSE s_name || ' - Mix ' || s_nationkey END AS title, s_name, s_nationkey, s_acctbal FROM supplier)"""


@query(f"""WITH {LIBRARY} SELECT hash, CASE WHEN title = '' THEN 'crate/' || s_name || ' - take.v2.mp3' ELSE title END AS title,
 CASE WHEN s_nationkey < 5 THEN 'Solo' ELSE s_name END AS artist, s_nationkey <> 3 AS has_file FROM lib""")
def library_listing(spark, d):
    """Display title, artist fallback and file flag of each row."""
    return search.library_listing(_library(spark, d)).select("hash", "title", "artist", "has_file")


@query(f"""WITH {LIBRARY} SELECT hash, CASE WHEN s_nationkey < 5 THEN 'Solo' ELSE s_name END AS artist, CASE WHEN title = '' THEN 'take.v2' ELSE 'Mix ' || s_nationkey END AS track FROM lib""")
def search_fields(spark, d):
    """Artist and title to look a track up by."""
    out = _library(spark, d).select("hash", T.search_fields(F.col("tag_artist"), F.lit(""), F.col("title"), F.col("filename")).alias("s"))
    return out.select("hash", "s.artist", F.col("s.title").alias("track"))


@query("""SELECT p_partkey, split_part(p_name, ' ', 2) AS title, split_part(p_name, ' ', 1) || ' VIP mix' AS remix FROM part""")
def remix_fields(spark, d):
    """Remix bracket captured and taken off the title."""
    title = F.concat(F.substring_index("p_name", " ", -1), F.lit(" ["), F.substring_index("p_name", " ", 1), F.lit(" VIP mix] -"))
    out = table(spark, d, "part").select("p_partkey", T.search_fields(F.lit("x"), title, F.lit(""), F.lit("")).alias("s"))
    return out.select("p_partkey", "s.title", "s.remix")


@query("SELECT s_suppkey::VARCHAR AS hash, s_name AS title, s_nationkey::VARCHAR AS filepath FROM supplier")
def label_card(spark, d):
    """Identity columns of a blind-label card."""
    rows = _library(spark, d).join(table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("hash"), "s_name", "s_nationkey"), "hash")
    card = search.label_card(rows.withColumn("title", F.col("s_name")).withColumn("filepath", F.col("s_nationkey").cast("string")))
    return card.select("hash", "title", "filepath")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring') OR contains(lower(p_brand), 'ring') OR contains(lower(p_type), 'ring')")
def text_search(spark, d):
    """Case-insensitive substring over several columns."""
    return search.text_search(table(spark, d, "part"), " RING ", ["p_name", "p_brand", "p_type"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring brand#1') ORDER BY p_partkey LIMIT 8")
def quick_search(spark, d):
    """The first eight hits over joined columns."""
    return search.quick_search(table(spark, d, "part"), "ring brand#1", ["p_name", "p_brand"], [F.col("p_partkey")]).select("p_partkey", "p_name")


def _nodes(spark, d):
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("hash"), F.split("p_name", " ").alias("artists"), F.concat((F.col("p_size") / 5).cast("int") + 1, F.lit("A")).alias("camelot"),
        F.col("p_brand").alias("style"), F.array("p_type", F.concat("p_type", F.lit(" Mix"))).alias("styles"), F.array("p_type").alias("keystones"), F.substring("p_type", 1, 1).alias("archgenre"),
        F.split("p_name", " ").alias("tags"), (F.col("p_retailprice") > 950).alias("playable"), (F.col("p_size") > 10).alias("flag"),
        F.when(F.col("p_size") > 5, F.col("p_size") * 4.0).alias("bpm"), F.col("p_retailprice").alias("duration"),
    )


@query("""SELECT p_partkey AS hash FROM part WHERE contains(lower(p_name), 'r') AND p_type <> 'PROMO' AND p_retailprice > 950 AND p_size > 10 AND p_size * 4.0 BETWEEN 60 AND 160
 AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)""")
def facet_search(spark, d):
    """Facets combined: artist, hidden, playable, flagged, tempo range, playlist."""
    facets = search.Facets(artist="R", hidden=["PROMO"], playable=True, flagged=True, bpm=(60, 160))
    playlist = table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("hash"))
    return search.facet_filter(_nodes(spark, d), facets, playlist).select("hash")


@query("""SELECT p_partkey AS hash FROM part WHERE p_type = 'SMALL' AND p_name LIKE '%ring%' AND (p_size > 5 AND p_size * 4.0 <= 120)
UNION ALL SELECT -p_partkey - 1 FROM part WHERE p_brand = 'Brand#2' AND (p_size / 5)::INT >= 0 AND floor(p_size / 5) + 1 = 3""")
def facet_styles(spark, d):
    """Style by any top read, keystone, tags all, open-ended range, key equality."""
    nodes = _nodes(spark, d)
    a = search.facet_filter(nodes, search.Facets(style="SMALL Mix", keystone="SMALL", archgenre="S", tags=["ring"], bpm=(None, 120)))
    b = search.facet_filter(nodes, search.Facets(style="Brand#2", camelot="3A"))
    return a.select("hash").union(b.select(-F.col("hash") - 1))


@query("""WITH l AS (SELECT list_sort(list(p_retailprice)) AS p, list_sort(list(p_size::DOUBLE)) AS s, count(*) AS n FROM part)
SELECT 'p_retailprice' AS facet, floor(p[(floor(0.01 * (n - 1)) + 1)::INT])::BIGINT AS lo, ceil(p[(floor(0.99 * (n - 1)) + 1)::INT])::BIGINT AS hi FROM l
UNION ALL SELECT 'p_size', floor(s[(floor(0.01 * (n - 1)) + 1)::INT])::BIGINT, ceil(s[(floor(0.99 * (n - 1)) + 1)::INT])::BIGINT FROM l""")
def facet_bounds(spark, d):
    """Slider bounds at the 1st and 99th percentile."""
    return search.facet_bounds(table(spark, d, "part"), ["p_retailprice", "p_size"])


@query("""SELECT DISTINCT 'camelot' AS facet, (floor(p_size / 5) + 1)::INT || 'A' AS value FROM part UNION SELECT 'style', p_brand FROM part UNION SELECT 'style', p_type FROM part
UNION SELECT 'style', p_type || ' Mix' FROM part UNION SELECT 'tag', unnest(string_split(p_name, ' ')) FROM part""")
def facet_values(spark, d):
    """Distinct choices of every picker."""
    return search.facet_values(_nodes(spark, d)).select("facet", "value")


@query("SELECT p_brand AS genre FROM part UNION SELECT p_type FROM part UNION SELECT p_type || ' Mix' FROM part")
def known_genres(spark, d):
    """Every genre name in the library."""
    return search.known_genres(_nodes(spark, d), ["style"], ["styles", "keystones"])


@query("SELECT min(p_type) AS genre FROM part WHERE lower(p_type) LIKE 'st%'")
def complete_genre(spark, d):
    """What a typed prefix completes to."""
    return search.complete_genre(search.known_genres(_nodes(spark, d), [], ["keystones"]), "St")


@query("SELECT DISTINCT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AS found FROM orders")
def membership_lookup(spark, d):
    """Which of many keys exist."""
    held = table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return search.point_lookup(held, "o_orderkey", table(spark, d, "orders"))


KEYED = """k AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE (o_custkey // 8 % 12) + 1 || CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END END AS camelot,
 CASE WHEN o_orderpriority LIKE '4%' THEN NULL ELSE 60 + floor(o_totalprice / 4000) END AS bpm FROM orders)"""


def _keyed(spark, d):
    o = table(spark, d, "orders")
    code = F.concat((F.floor(F.col("o_custkey") / 8) % 12 + 1).cast("string"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("B"))
    return o.select(
        "o_orderkey", F.when(~F.col("o_orderpriority").startswith("5"), code).alias("camelot"),
        F.when(~F.col("o_orderpriority").startswith("4"), F.lit(60.0) + F.floor(F.col("o_totalprice") / 4000)).alias("bpm"),
    )


BPM_OK = "({a}.bpm IS NULL OR {b}.bpm IS NULL OR abs(greatest({a}.bpm, {b}.bpm) / least({a}.bpm, {b}.bpm) - 1) <= 0.06 OR abs(greatest({a}.bpm, {b}.bpm) / least({a}.bpm, {b}.bpm) / 2 - 1) <= 0.06)"
KEY_OK = "({a}.n = {b}.n OR ({a}.l = {b}.l AND abs({a}.n - {b}.n) IN (1, 11)))"
CELLS = f"""{KEYED}, c AS (SELECT camelot, bpm, left(camelot, -1)::INT AS n, right(camelot, 1) AS l, count(*) AS c FROM k WHERE camelot IS NOT NULL GROUP BY ALL),
h AS (SELECT a.camelot, a.bpm, sum(b.c)::BIGINT - 1 AS partners FROM c a JOIN c b ON {KEY_OK.format(a='a', b='b')} AND {BPM_OK.format(a='a', b='b')} GROUP BY ALL)"""


@query(f"WITH {CELLS} SELECT o_orderkey, coalesce(partners, 0) AS partners FROM k LEFT JOIN h ON k.camelot = h.camelot AND k.bpm IS NOT DISTINCT FROM h.bpm")
def harmonic_counts(spark, d):
    """How many other tracks each track mixes with."""
    return search.harmonic_counts(_keyed(spark, d), "o_orderkey")


@query(f"WITH {KEYED}, x AS (SELECT *, left(camelot, -1)::INT AS n, right(camelot, 1) AS l FROM k), s AS (SELECT 8 AS n, 'A' AS l, 90.0 AS bpm) SELECT o_orderkey FROM x, s WHERE {KEY_OK.format(a='x', b='s')} AND {BPM_OK.format(a='x', b='s')}")
def harmonic_matches(spark, d):
    """Tracks that mix with one selected key and tempo."""
    return search.harmonic_matches(_keyed(spark, d), "o_orderkey", "8A", 90.0).select("o_orderkey")


@query("""WITH t AS (SELECT l_orderkey, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS tags FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT o_orderkey AS hash, coalesce(tags, '') AS tags FROM orders LEFT JOIN t ON l_orderkey = o_orderkey""")
def tag_names(spark, d):
    """Sorted tag names of every asked track, tagged or not."""
    tags = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("name"))
    links = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("tag_id"))
    out = search.tag_names(table(spark, d, "orders").select(F.col("o_orderkey").alias("hash")), links, tags)
    return out.select("hash", F.array_join("tags", ",").alias("tags"))


@query("SELECT p_partkey AS id, p_name AS name, count(l_orderkey) AS count FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL")
def member_counts(spark, d):
    """Members per group, empty groups kept."""
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return search.member_counts(groups, table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("hash")), "l_partkey")


@query("SELECT doc_id AS hash, quality AS weight, CASE WHEN lang = 'en' THEN source END AS title FROM labels LEFT JOIN documents USING (doc_id)")
def vibe_listing(spark, d):
    """Members with titles; one without a title stays."""
    tracks = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("hash"), F.col("source").alias("title"))
    return search.vibe_listing(table(spark, d, "labels").select(F.col("doc_id").alias("hash"), F.col("quality").alias("weight")), tracks)


@query("SELECT n_nationkey AS id, n_name AS name, s_suppkey AS hash FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def vibe_membership(spark, d):
    """Every group with its members, an empty one once."""
    members = table(spark, d, "supplier").select(F.col("s_nationkey").alias("vibe_id"), F.col("s_suppkey").alias("hash"))
    return search.membership(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), members)


def _playlists(spark, d):
    """Orders as playlists: the stored JSON mixes bare hashes and objects, in line order."""
    entry = F.when(F.col("l_returnflag") == "A", F.to_json(F.struct(F.col("l_partkey").cast("string").alias("hash")))).otherwise(F.concat(F.lit('"'), F.col("l_partkey").cast("string"), F.lit('"')))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", entry.alias("e")).alias("l"))
    lists = lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l")).alias("ls"))  # an order's own lines
    return lists.select(F.col("l_orderkey").alias("id"), F.concat(F.lit("["), F.array_join(F.transform("ls", lambda x: x["e"]), ","), F.lit("]")).alias("tracks"))


LINES = "li AS (SELECT l_orderkey AS id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem)"


@query(f"WITH {LINES} SELECT id, pos::INT AS pos, l_partkey::VARCHAR AS hash, p_name AS title FROM li JOIN part ON p_partkey = l_partkey WHERE p_size > 10")
def playlist_order(spark, d):
    """Playlist entries in order, repeats kept, unknown tracks skipped."""
    tracks = table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("hash"), F.col("p_name").alias("title"))
    return search.playlist_rows(_playlists(spark, d), tracks)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE coalesce(c, 0) END::INT AS count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def playlist_index(spark, d):
    """Playlists with their length; an unreadable list counts zero (L4)."""
    lists = table(spark, d, "orders").join(_playlists(spark, d), F.col("o_orderkey") == F.col("id"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderstatus") == "P", "{broken").otherwise(F.col("tracks")).alias("tracks"), F.col("o_totalprice").alias("updated"))
    return search.playlist_index(lists).select("id", "count")


@query("SELECT o_orderkey AS hash, o_totalprice AS created, c_name AS title FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY created DESC, hash LIMIT 20")
def recent_labels(spark, d):
    """The twenty newest labels with identity."""
    orders = table(spark, d, "orders")
    tracks = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("hash"), F.col("c_name").alias("title"))
    return search.recent_labels(orders.select(F.col("o_orderkey").alias("hash"), F.col("o_totalprice").alias("created")), tracks)


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN 'C' ELSE 'Am' END AS key_text, floor(floor(s_acctbal + 0.5) / 60)::BIGINT || ':' || lpad((((floor(s_acctbal + 0.5)::BIGINT % 60) + 60) % 60)::VARCHAR, 2, '0') AS length,
strftime(make_timestamp((s_suppkey * 86400 * 1000000 + 86400000000)::BIGINT), '%Y-%m-%d') AS day FROM supplier""")
def display_fields(spark, d):
    """Key, length and date as display text."""
    s = table(spark, d, "supplier")
    minor = F.col("s_nationkey") >= 12
    return s.select(
        "s_suppkey", music.key_text(F.when(minor, "A").otherwise("C"), F.when(minor, "minor").otherwise("major")).alias("key_text"),
        music.length_text(F.col("s_acctbal")).alias("length"), music.date_text((F.col("s_suppkey") + 1) * 86400).alias("day"),
    )
