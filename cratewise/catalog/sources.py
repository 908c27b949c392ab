"""Source, sink and reference-data queries over ``documents``, ``pages``, ``events`` and ``orders``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T, vectors as V
from ..operators import edits, reference as R, taxonomy
from ..plans.guards import scratch_folder
from ..sources import files, pages, sinks, tracks
from .registry import query, table


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT % 10 <> 0")
def json_extract_cols(spark, d):
    """Typed columns parsed out of JSON; rows that do not parse are left out."""
    k = F.get_json_object("props", "$.k").cast("int")
    broken = table(spark, d, "events").withColumn("props", F.when(k % 10 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props")))
    broken = broken.withColumn("props", F.when(k % 10 == 0, F.expr("substring(props, 2)")).otherwise(F.col("props")))
    return tracks.parse_json(broken, "props", "k int", "p").select("event_id", "p.k")


@query("""SELECT event_id, event_type AS style, CASE WHEN value > 10 THEN value END AS bpm, CASE WHEN event_type = 'view' THEN 'solo' WHEN event_type = 'click' THEN 'va' ELSE '' END AS tag_artist FROM events""")
def listing_columns(spark, d):
    """Listing columns lifted out of a stored payload."""
    e = F.col("event_type")
    payload = F.to_json(F.struct(
        F.array(F.struct(F.lit("Electronic").alias("parent"), e.alias("style"), F.lit(0.5).alias("score"))).alias("styles"), F.when(F.col("value") > 10, F.col("value")).alias("bpm"),
        F.struct(F.create_map(F.lit("artist"), F.when(e == "view", " solo ").otherwise(""), F.lit("albumartist"), F.when(e == "click", "va").otherwise("")).alias("tag")).alias("tags"),
    ))
    parsed = tracks.parse_payload(table(spark, d, "events").select("event_id", payload.alias("payload")), schema=schemas.LISTING)
    return tracks.listing_columns(parsed).select("event_id", "style", "bpm", "tag_artist")


@query("SELECT vec_id, len(embedding)::INT AS dim, round(embedding[1]::DOUBLE, 6) AS first, round(embedding[64]::DOUBLE, 6) AS last FROM embeddings")
def blob_vectors(spark, d):
    """Stored float32 bytes decoded to vectors."""
    stored = table(spark, d, "embeddings").select("vec_id", V.encode_blob("embedding").alias("embedding"))
    e = tracks.decode_vectors(stored)
    at = lambda i: F.round(F.col("embedding")[i].cast("double"), 6)
    return e.select("vec_id", F.size("embedding").alias("dim"), at(0).alias("first"), at(63).alias("last"))


@query("SELECT doc_id, quality, toxic FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def snapshot_restore(spark, d):
    """A snapshot of learned state read back; rows of vanished tracks are left out."""
    folder = f"{scratch_folder(spark)}/snapshots-{uuid.uuid4().hex}"
    edits.take_snapshot({"labels": table(spark, d, "labels")}, folder, "one", "before", 1.0)
    edits.take_snapshot({"labels": table(spark, d, "labels").limit(0)}, folder, "two", "after a clear", 2.0)
    return edits.restore_snapshot(spark, folder, "one", "labels", table(spark, d, "documents").where("lang = 'en'"), "doc_id")


@query("SELECT sha1(text) AS hash, lpad(min(doc_id)::VARCHAR, 9, '0') AS path, count(*) AS copies FROM documents GROUP BY 1")
def dedupe_by_hash(spark, d):
    """One row per content, first path wins."""
    docs = table(spark, d, "documents").select(F.encode("text", "utf-8").alias("content"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("path"), F.col("n_chars").alias("length"))
    return files.first_paths(files.content_hash(docs))


@query("SELECT doc_id, sha1(text) AS hash FROM documents WHERE sha1(text) NOT IN (SELECT sha1(text) FROM documents JOIN labels USING (doc_id))")
def incremental_anti(spark, d):
    """Content the store does not hold yet."""
    docs = table(spark, d, "documents").select("doc_id", F.sha1("text").alias("hash"))
    return files.unseen(docs, docs.join(table(spark, d, "labels"), "doc_id"))


@query("SELECT count(*) FILTER (event_type <> 'error' AND value < 10) AS short, count(*) AS processed, count(*) FILTER (event_type = 'error' OR value >= 10) AS kept FROM events")
def duration_gate(spark, d):
    """Short rows counted, unknown lengths kept."""
    rows = table(spark, d, "events").withColumn("duration", F.when(F.col("event_type") != "error", F.col("value")))
    kept, totals = files.duration_gate(rows, 10.0)
    n = kept.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return totals.withColumn("kept", n)


@query("""SELECT page_id, NOT (page_id < 50) AND split_part(url, '/', 5) <> '' AS audio FROM pages""")
def audio_paths(spark, d):
    """Suffix, sidecar and system-folder rules."""
    p = table(spark, d, "pages")
    part = F.split_part("url", F.lit("/"), F.lit(5))
    path = (
        F.when(F.col("page_id") < 20, F.concat(F.lit("a/._"), part, F.lit(".mp3"))).when(F.col("page_id") < 40, F.concat(F.lit("a/Windows/"), part, F.lit(".mp3")))
        .when(F.col("page_id") < 50, F.concat(F.lit("a/"), part, F.lit(".txt"))).when(part == "", "a/none").otherwise(F.concat(F.lit("a/"), F.translate(part, "?=&#.", "_____"), F.lit(".FLAC")))
    )
    return p.select("page_id", files.is_audio_path(path).alias("audio"))


def _paths(spark, d):
    """Orders as tracks with paths, part-names on disk."""
    o = table(spark, d, "orders")
    path = F.when(F.col("o_orderstatus") == "P", " ").otherwise(F.concat(F.lit("/m/"), F.col("o_custkey").cast("string")))
    lib = o.select(F.col("o_orderkey").alias("hash"), path.alias("filepath"), F.col("o_orderpriority").alias("title"))
    disk = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("/m/"), F.col("c_custkey").cast("string")).alias("path"))
    return lib, disk


STATE = """st AS (SELECT o_orderkey AS hash, o_custkey, CASE WHEN o_orderstatus = 'P' THEN 'missing' WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'ok' ELSE 'broken' END AS state FROM orders)"""


@query(f"WITH {STATE} SELECT state, count(*) AS n FROM st GROUP BY 1")
def path_report(spark, d):
    """Recorded paths ok, broken or missing."""
    return files.path_report(files.path_states(*_paths(spark, d)))


@query(f"WITH {STATE} SELECT hash, state FROM st WHERE state <> 'ok' QUALIFY row_number() OVER (PARTITION BY state ORDER BY hash) <= 25")
def path_examples(spark, d):
    """The first 25 broken and missing tracks."""
    return files.path_examples(files.path_states(*_paths(spark, d))).select("hash", "state")


@query(f"WITH {STATE}, f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25) SELECT hash, CASE state WHEN 'missing' THEN 'filled' WHEN 'broken' THEN 'repointed' ELSE 'kept' END AS action, CASE state WHEN 'ok' THEN '/m/' || o_custkey ELSE '/new/' || hash END AS filepath FROM st JOIN f ON l_orderkey = hash")
def path_repair(spark, d):
    """Blank paths filled and broken ones re-pointed from a scan; healthy ones stay."""
    lib, disk = _paths(spark, d)
    return files.repair_paths(lib, _scanned(spark, d), disk).select("hash", "action", "filepath")


def _scanned(spark, d):
    found = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("hash")).distinct()
    return found.select("hash", F.concat(F.lit("/new/"), F.col("hash").cast("string")).alias("path"))


@query(f"WITH {STATE}, f AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25), r AS (SELECT state FROM st JOIN f ON l_orderkey = hash) SELECT count(*) AS matched, count(*) FILTER (state = 'missing') AS filled, count(*) FILTER (state = 'broken') AS repointed, count(*) FILTER (state = 'ok') AS kept, (SELECT count(*) FROM f) - count(*) AS unanalysed FROM r")
def repair_report(spark, d):
    """Totals of a path repair."""
    lib, disk = _paths(spark, d)
    scanned = _scanned(spark, d)
    return files.repair_report(files.repair_paths(lib, scanned, disk), scanned)


@query("""SELECT conv_id, turn, CASE WHEN length(trim(text)) <= 300 THEN trim(text) END AS genre, role AS artist FROM conversations""")
def tag_fields(spark, d):
    """Container tags onto known fields: aliases, any case, at most 300 characters."""
    c = table(spark, d, "conversations")
    raw = F.map_from_arrays(F.array(F.lit("GENRE"), F.lit("Artist"), F.lit("junk")), F.array(F.col("text"), F.concat(F.lit(" "), F.col("role")), F.lit("x")))
    tags = tracks.normalise_tags(raw)
    out = c.select("conv_id", "turn", tags.alias("t"))
    return out.select("conv_id", "turn", F.try_element_at("t", F.lit("genre")).alias("genre"), F.try_element_at("t", F.lit("artist")).alias("artist"))


@query("""SELECT event_id, 0::INT AS pos, CASE event_type WHEN 'view' THEN 'House' WHEN 'click' THEN 'techno' ELSE 'Dub' END AS name, CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN 9 ELSE 5 END::INT AS count FROM events WHERE event_type <> 'signup'
UNION ALL SELECT event_id, 1, CASE event_type WHEN 'view' THEN 'Electronic' ELSE 'House' END, CASE event_type WHEN 'view' THEN NULL ELSE 4 END FROM events WHERE event_type IN ('view', 'click')""")
def lookup_names(spark, d):
    """Normalised names from stored lookup responses of three sources."""
    e = F.col("event_type")
    body = (
        F.when(e == "view", '{"results":[{"style":["House"," house "],"genre":["Electronic","HOUSE"]},{"style":["Other"]}]}')
        .when(e == "click", '{"recordings":[{"genres":[{"name":"House","count":4},{"name":"Techno","count":2}],"tags":[{"name":"techno","count":9},{"name":" ","count":50}]}]}')
        .when(e == "signup", '{"results":[]}').otherwise('{"toptags":{"tag":{"name":"Dub","count":5}}}')
    )
    source = F.when(e.isin("view", "signup"), "discogs").when(e == "click", "musicbrainz").otherwise("lastfm")
    cache = table(spark, d, "events").select(F.col("event_id").alias("hash"), source.alias("source"), body.alias("response_json"))
    return tracks.lookup_names(cache).select(F.col("hash").alias("event_id"), "pos", "name", "count")


@query("SELECT count(*) FILTER (event_type NOT IN ('error', 'signup')) AS processed, count(*) AS total, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'signup') AS short FROM events")
def batch_totals(spark, d):
    """Totals of a batch."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "short").otherwise("ok")
    return sinks.batch_totals(table(spark, d, "events").withColumn("status", status))


@query("SELECT doc_id::VARCHAR AS hash, '/m/' || doc_id AS filepath, lang AS genre, CASE WHEN source = 'src1' THEN 'override' ELSE 'blind' END AS source FROM documents")
def label_csv_rows(spark, d):
    """Label rows in export order."""
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("hash"), F.concat(F.lit("/m/"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("genre"),
        F.when(F.col("source") == "src1", "override").otherwise("blind").alias("source"))
    return sinks.label_csv_rows(rows)


@query("SELECT o_orderkey::VARCHAR AS hash, CASE WHEN o_orderstatus = 'P' THEN '—' ELSE o_orderpriority END AS title, floor(floor(o_totalprice / 100 + 0.5) / 60)::BIGINT || ':' || lpad((floor(o_totalprice / 100 + 0.5)::BIGINT % 60)::VARCHAR, 2, '0') AS duration, CASE WHEN o_orderstatus = 'F' THEN 'Am' ELSE '—' END AS key FROM orders")
def listing_text(spark, d):
    """Visible listing columns as text."""
    rows = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("hash"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("title"), (F.col("o_totalprice") / 100).alias("duration"),
        F.when(F.col("o_orderstatus") == "F", "A").alias("key"), F.lit("minor").alias("scale"))
    return sinks.listing_text(rows, ["hash", "title", "duration", "key"])


ENTRY = """en AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS pos, l_partkey, p_name, p_brand, p_size, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _entries(spark, d):
    from ..operators.sequences import with_frame_index

    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice")
    placed = with_frame_index(lines, "l_orderkey", [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_shipdate"), F.col("l_extendedprice")], "pos")
    return placed.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("id"), "pos", F.col("l_partkey").cast("string").alias("hash"), F.concat(F.col("p_name"), F.lit(" & Co")).alias("title"),
        F.when(F.col("p_size") > 25, F.col("p_brand")).alias("artist"), F.when(F.col("p_size") > 5, F.concat(F.lit("C:\\m x\\"), F.col("p_brand"), F.lit("é.mp3"))).alias("filepath"),
        F.when(F.col("p_size") > 10, F.col("p_retailprice") / 10).alias("bpm"), F.when(F.col("p_size") > 15, "Am").alias("key"), F.col("p_retailprice").alias("duration"),
    )


@query(f"WITH {ENTRY}, b AS (SELECT id, pos * 2 + 1 AS pos, '#EXTINF:-1,' || CASE WHEN p_size > 25 THEN p_brand || ' - ' ELSE '' END || p_name || ' & Co' AS line FROM en UNION ALL SELECT id, pos * 2 + 2, 'http://x/' || l_partkey FROM en UNION ALL SELECT DISTINCT id, 0, '#EXTM3U' FROM en) SELECT id, pos, line FROM b")
def m3u_lines(spark, d):
    """Playlist file lines in order."""
    return sinks.m3u_lines(_entries(spark, d), "http://x/")


XML = f"""{ENTRY}, nb AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS track_id FROM en WHERE p_size > 5),
tx AS (SELECT id, track_id, '<TRACK TrackID="' || track_id || '" Name="' || p_name || ' &amp; Co" Artist="' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END || '" Location="file://localhost/C:/m%20x/' || replace(p_brand, '#', '%23') || '%C3%A9.mp3" Rating="'
 || CASE WHEN p_size % 5 = 0 THEN 204 ELSE 0 END || '"' || CASE WHEN p_size % 5 = 0 THEN ' Comments="A - n&lt;1&gt;"' ELSE '' END || CASE WHEN p_size > 10 THEN ' AverageBpm="' || round_even(p_retailprice / 10, 2) || '"' ELSE '' END
 || CASE WHEN p_size > 15 THEN ' Tonality="Am"' ELSE '' END || ' TotalTime="' || floor(p_retailprice)::BIGINT || '"/>' AS line FROM nb)"""


@query(f"WITH {XML} SELECT id, track_id, line FROM tx")
def collection_tracks(spark, d):
    """TRACK elements: contiguous ids, star steps, comment, encoded location, optional attributes."""
    return sinks.collection_tracks(_entries(spark, d), _stars(spark, d), sizes_from=table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")))


def _stars(spark, d):
    return table(spark, d, "part").where("p_size % 5 = 0").select(F.col("p_partkey").cast("string").alias("hash"), F.lit("4").alias("stars"), F.lit("A").alias("grade"), F.lit("n<1>").alias("note"))


@query(f"WITH {XML}, c AS (SELECT o_orderkey AS id, count(*) FILTER (p_size > 5) AS n, count(*) FILTER (p_size <= 5) AS skipped FROM orders LEFT JOIN en ON id = o_orderkey GROUP BY 1) SELECT id, 5 + 2 * n + 8 + CASE WHEN skipped > 0 THEN 1 ELSE 0 END - 1 AS lines, n AS tracks, skipped > 0 AS noted FROM c")
def collection_document(spark, d):
    """Whole collection documents, line by line in order; tracks without a path are noted."""
    lists = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"))
    lines = sinks.collection_xml(_entries(spark, d), _stars(spark, d), lists)
    return lines.groupBy("id").agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(F.col("line").startswith("<TRACK TrackID")).alias("tracks"), F.bool_or(F.col("line").startswith("<!--")).alias("noted"))


@query("SELECT n_name AS name, s_suppkey AS hash, CASE WHEN s_suppkey IS NULL THEN NULL WHEN s_acctbal < 6000 THEN 1.0 ELSE s_acctbal / 10000 END AS weight FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def vibe_export(spark, d):
    """Member lines of every vibe, null weights as one."""
    s = table(spark, d, "supplier")
    members = s.select(F.col("s_nationkey").alias("vibe_id"), F.col("s_suppkey").alias("hash"), F.when(F.col("s_acctbal") >= 6000, F.col("s_acctbal") / 10000).alias("weight"))
    return sinks.vibe_rows(table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), members)


# --- pages ------------------------------------------------------------------------------

@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1), 1) - 1 AS pos FROM pages)
SELECT page_id, pos::INT AS pos, href, label FROM m""")
def html_extract(spark, d):
    """Repeated elements of a page as rows."""
    return pages.extract_elements(table(spark, d, "pages"), "page_id", "html", '<a href="([^"]*)">([^<]*)</a>', {"href": 1, "label": 2})


@query("""WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 AS pos FROM pages) SELECT page_id, href, min(pos)::INT AS pos FROM m GROUP BY ALL""")
def first_elements(spark, d):
    """Repeated elements with the first duplicate kept."""
    rows = pages.extract_elements(table(spark, d, "pages"), "page_id", "html", '<a href="([^"]*)">([^<]*)</a>', {"href": 1, "label": 2})
    return pages.first_by(rows, ["page_id", "href"], F.col("pos")).select("page_id", "href", "pos")


ENTITIES = {"&copy;?": "©", "&middot;?": "·", "&nbsp;?": "\u00a0", "&lt;?": "<", "&gt;?": ">", "&quot;?": '"', "&#39;?": "''", "&amp;?": "&"}


def _plain(sql: str) -> str:
    """Tags out, entities decoded (a missing semicolon is allowed), spaces collapsed."""
    sql = f"regexp_replace({sql}, '<[^>]+>', '', 'g')"
    for pattern, text in ENTITIES.items():
        sql = f"regexp_replace({sql}, '{pattern}', '{text}', 'g')"
    return f"trim(regexp_replace({sql}, '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_plain('html')} AS text FROM pages")
def strip_html(spark, d):
    """Whole pages as plain text: tags out, entities decoded, spaces collapsed."""
    return table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"))


@query("""SELECT page_id, 'g' || page_id AS name, length(url)::INT AS x, length(html)::INT AS y, '#0f0f0a' AS color, 120::INT AS size, CASE WHEN page_id > 100 THEN 'id' || page_id END AS track_id, 'A & B' AS artist, 'T' || page_id AS title FROM pages""")
def genre_nodes(spark, d):
    """Nodes of a saved genre map, entities decoded, first duplicate wins."""
    pid = F.col("page_id").cast("string")
    node = lambda extra: F.concat(
        F.lit('<div id="item1" title="e.g. A &amp; B &quot;T'), pid, F.lit('&quot;" style="color: #0F0F0A; top: '), (F.length("html") + extra).cast("string"), F.lit("px; left: "), F.length("url").cast("string"),
        F.lit('px; font-size: 120%" onclick="playx(&quot;'), F.when(F.col("page_id") > 100, F.concat(F.lit("id"), pid)).otherwise(""), F.lit("&quot;, &quot;g"), pid, F.lit("&quot;, this);\">g</div>"))
    rows = table(spark, d, "pages").select("page_id", F.concat(F.lit("<p>x</p>"), node(0), F.lit("<div class=q></div>"), node(5)).alias("html"))
    return pages.genre_nodes(rows, "page_id", "html").drop("pos")


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'C#' WHEN 'click' THEN 'A' END AS key, CASE event_type WHEN 'view' THEN 'minor' WHEN 'click' THEN 'major' END AS scale FROM events""")
def key_annotations(spark, d):
    """Key labels: one tonic and mode only, spelling folded."""
    e = F.col("event_type")
    raw = F.when(e == "view", " Db  minor\n").when(e == "click", "A major").when(e == "purchase", "F minor phrygian").when(e == "signup", "C# minor | E major").otherwise("X")
    out = table(spark, d, "events").select("event_id", pages.parse_annotation(raw).alias("k"))
    return out.select("event_id", "k.key", "k.scale")


# --- reference data ----------------------------------------------------------------------

GRAPH = "ed AS (SELECT p_partkey AS child, p_partkey // 3 AS parent FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey + 7 FROM part WHERE p_size > 30)"


@query(f"""WITH RECURSIVE {GRAPH}, r AS (SELECT 0::BIGINT AS node, 0 AS depth UNION SELECT child, depth + 1 FROM r JOIN ed ON parent = node WHERE depth < 64) SELECT node, min(depth)::INT AS depth FROM r GROUP BY 1""")
def graph_depth(spark, d):
    """Shortest distance from the root down a graph with cycles."""
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).alias("parent")).union(part.where("p_size > 30").select("p_partkey", F.col("p_partkey") + 7))
    return R.graph_depth(edges, 0)


@query("SELECT 'lang' AS field, count(*) FILTER (lang <> '') AS n FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'quality', count(quality) FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'words', count(*) FILTER (contains(text, ' ')) FROM documents")
def field_coverage(spark, d):
    """Non-empty values per field; zero counts as present."""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    words = F.when(F.col("text").contains(" "), F.array("lang")).otherwise(F.array().cast("array<string>"))
    return R.field_coverage(docs.select("lang", "quality", words.alias("words")))


@query("SELECT p_partkey, p_name IN (SELECT p_name FROM part WHERE p_size > 45) OR p_partkey IN (SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20) AS matched FROM part")
def cross_reference(spark, d):
    """Names known by key, alias or id, and the rest."""
    part = table(spark, d, "part")
    records = part.where("p_size > 45").select(T.name_key(F.upper("p_name")).alias("key"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("external_id")).unionByName(
        part.where("p_size between 10 and 20").select(F.lit("").alias("key"), F.array(F.concat(F.lit("PÁRT-"), F.col("p_partkey").cast("string"))).alias("aliases"), F.lit(None).cast("string").alias("external_id")))
    names = part.select("p_partkey", F.explode(F.array("p_name", F.concat(F.lit("part & "), F.col("p_partkey").cast("string")))).alias("n"))
    names = names.withColumn("name", F.regexp_replace("n", "part & ", "Part "))
    matched, _ = R.cross_reference(records, names.select("name").distinct(), "name")
    hits = names.join(matched, "name", "left_semi").select("p_partkey").distinct().withColumn("m", F.lit(True))
    return part.select("p_partkey").join(hits, "p_partkey", "left").select("p_partkey", F.coalesce("m", F.lit(False)).alias("matched"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN -year(o_orderdate) % 1000 WHEN o_orderstatus = 'F' THEN year(o_orderdate) ELSE year(o_orderdate) END::INT AS year, 'c ' || o_custkey || ' and e' AS key FROM orders""")
def year_and_key(spark, d):
    """Years with the sign rule, and accent-free name keys."""
    year = F.year("o_orderdate")
    raw = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("-"), (year % 1000).cast("string"), F.lit("-01-01"))).when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("-"), year.cast("string"), F.lit(".0"))).otherwise(F.concat(F.lit(" "), year.cast("string"), F.lit("-01-01T00:00:00Z")))
    return table(spark, d, "orders").select("o_orderkey", T.year_of(raw).alias("year"), T.name_key(F.concat(F.lit("Ç-"), F.col("o_custkey").cast("string"), F.lit(" & É!"))).alias("key"))


@query("SELECT count(DISTINCT lower(p_brand)) AS genres, count(DISTINCT lower(p_brand)) FILTER (p_size > 25) AS with_prose, (SELECT count(*) FROM (SELECT lower(p_brand) FROM part UNION SELECT lower(p_name) FROM part)) AS names_incl_aliases FROM part")
def dictionary_stats(spark, d):
    """Genres, names with aliases, genres with prose."""
    return R.dictionary_stats(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.array("p_name").alias("aliases"), F.when(F.col("p_size") > 25, "prose").otherwise(" ").alias("excerpt")))


@query("""WITH a AS (SELECT p_brand, p_name, min(p_partkey) AS p FROM part GROUP BY ALL) SELECT p_brand AS subject, string_agg(p_name, '|' ORDER BY p) AS names FROM a WHERE lower(p_name) <> 'red ring' GROUP BY 1""")
def ordered_relations(spark, d):
    """Tall rows regrouped by subject: first-seen order, repeats, self and list pages out."""
    part = table(spark, d, "part")
    rows = part.select("p_brand", "p_name", F.col("p_partkey").alias("pos"), F.lit("Red-Ring").alias("own")).unionByName(
        part.select("p_brand", F.lit("List of parts").alias("p_name"), F.col("p_partkey").alias("pos"), F.lit("x").alias("own")))
    out = R.ordered_distinct(R.clean_relations(rows, "p_name", "own"), ["p_brand"], "p_name", "pos")
    return out.select(F.col("p_brand").alias("subject"), F.array_join("values", "|").alias("names"))


@query("""SELECT n_nationkey::VARCHAR AS id, lower(replace(n_name, '_', ' ')) AS key, CASE WHEN n_nationkey < 5 THEN 'own' WHEN n_nationkey < 15 THEN 'page' ELSE '' END AS description, CASE WHEN n_nationkey < 10 THEN 1990 WHEN n_nationkey < 20 THEN 1980 END::INT AS origin_year,
CASE WHEN n_nationkey = 0 THEN 0 WHEN n_nationkey < 5 THEN 1 ELSE 2 END::INT AS electronic_depth, CASE WHEN n_nationkey < 15 THEN 'wikidata,dbpedia,wikipedia' WHEN n_nationkey < 20 THEN 'wikidata,dbpedia' ELSE 'wikidata' END AS sources,
'a' || n_nationkey || CASE WHEN n_nationkey < 20 THEN '|x' || n_nationkey ELSE '' END AS aliases FROM nation""")
def genre_records(spark, d):
    """Genre records merged from five sources by id, derived title and precedence."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    items = n.select(
        "id", "name", F.when(F.col("k") < 5, "own").otherwise("").alias("description"), F.when(F.col("k") < 10, "1990-01-01T00:00:00Z").alias("inception"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    aliases = n.select("id", F.explode(F.array(F.struct(F.lit(0).alias("pos"), F.concat(F.lit("a"), F.col("id")).alias("alias")), F.struct(F.lit(1).alias("pos"), F.concat(F.lit("a"), F.col("id")).alias("alias")))).alias("x")).select("id", "x.*")
    up = F.when(F.col("k") < 5, F.lit("0")).otherwise((F.col("k") % 4 + 1).cast("string"))
    relations = n.where("k > 0").select("id", F.lit("parents").alias("field"), F.lit(0).alias("pos"), up.alias("target"))
    box = n.where("k < 20").select(F.concat(F.lit("t"), F.col("id")).alias("title"), F.explode(F.array(
        F.struct(F.lit("cultural_origins").alias("field"), F.lit(0).alias("pos"), F.lit("-1980.0").alias("value")),
        F.struct(F.lit("other_names").alias("field"), F.lit(0).alias("pos"), F.concat(F.lit("x"), F.col("id"), F.lit("; A"), F.col("id")).alias("value")),
        F.struct(F.lit("subgenres").alias("field"), F.lit(0).alias("pos"), F.lit("http://dbpedia.org/resource/Grime_music").alias("value")))).alias("e")).select("title", "e.*")
    wiki = n.where("k < 15").select(F.concat(F.lit("t"), F.col("id")).alias("title"), F.lit("text").alias("excerpt"), F.lit("page").alias("description"), F.lit(None).cast("string").alias("covered_by"))
    out = R.build_records(items, aliases, relations, box, wiki, "0")
    return out.select("id", "key", "description", "origin_year", "electronic_depth", F.array_join("sources", ",").alias("sources"), F.array_join("aliases", "|").alias("aliases"))


@query("""WITH hubs AS (SELECT 'hub' || r_regionkey AS name, CASE r_regionkey WHEN 0 THEN 'House' WHEN 1 THEN 'Drum n Bass' WHEN 2 THEN 'Ambient' WHEN 3 THEN 'Techno' END AS keystone FROM region),
rec AS (SELECT p_partkey AS pos, lower(trim(p_brand)) AS brand, lower(trim(p_name)) AS alias, CASE p_size % 4 WHEN 0 THEN 'House' WHEN 1 THEN 'Techno' WHEN 2 THEN 'Dubstep' ELSE h.keystone END AS keystone
  FROM part LEFT JOIN hubs h ON h.name = 'hub' || p_partkey % 5),
spelled AS (SELECT brand AS name, pos, keystone FROM rec UNION ALL SELECT alias, pos, keystone FROM rec)
SELECT name, arg_min(coalesce(keystone, ''), pos) AS keystone FROM spelled GROUP BY name HAVING arg_min(coalesce(keystone, ''), pos) <> '' UNION ALL SELECT name, keystone FROM hubs WHERE keystone IS NOT NULL""")
def graph_keystones(spark, d):
    """Names placed by walking a genre graph: the first record of a spelling, its parents, their hubs."""
    part, e = table(spark, d, "part"), F.lit
    parent = F.when(F.col("p_size") % 4 == 0, "Deep House").when(F.col("p_size") % 4 == 1, "Techno").when(F.col("p_size") % 4 == 2, "Dubstep").otherwise(
        F.concat(e("Hub"), (F.col("p_partkey") % 5).cast("string"))
    )
    records = part.select(F.col("p_partkey").cast("long").alias("pos"), F.col("p_brand").alias("name"), F.array("p_name").alias("aliases"), F.array(parent).alias("parents"))
    up = F.element_at(F.array(e("Deep House"), e("Drum n Bass"), e("Dark Ambient"), e("Techno"), e("nowhere")), F.col("r_regionkey").cast("int") + 1)
    hubs = table(spark, d, "region").select(
        (-1 - F.col("r_regionkey")).cast("long").alias("pos"), F.concat(e("hub"), F.col("r_regionkey").cast("string")).alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(up).alias("parents")
    )
    return taxonomy.graph_keystones(records.unionByName(hubs))


@query("""SELECT s_suppkey, CASE WHEN s_nationkey < 5 THEN s_name WHEN s_nationkey < 10 THEN NULL ELSE 'd' || s_nationkey END AS prose, 'a n b n c' AS folded, 's ' || s_suppkey AS artist, 'AC_DC #_' AS safe, '1,b' AS listed,
'C:\\Music\\' || s_suppkey AS native, 320 || ' kbps' AS bitrate, 'MP3' AS container FROM supplier""")
def text_functions(spark, d):
    """Prose choice, and-folding, artist key, safe name, list parameter, native path, tech fields."""
    s, nk = table(spark, d, "supplier"), F.col("s_nationkey")
    return s.select(
        "s_suppkey", T.best_prose(F.when(nk < 5, F.col("s_name")).otherwise(" "), F.when(nk < 10, "Music Genre").otherwise(F.concat(F.lit("d"), nk.cast("string")))).alias("prose"),
        T.fold_and(F.lit("a &  b and c")).alias("folded"), T.artist_key(F.concat(F.lit("  S \t"), F.col("s_suppkey").cast("string"), F.lit(" "))).alias("artist"),
        F.regexp_replace(T.safe_name(F.lit(" AC/DC \u00e9? ")), "\u00e9", "#").alias("safe"), F.array_join(T.list_param(F.lit(" 1, b,,1 ")), ",").alias("listed"),
        T.native_path(F.concat(F.lit("/mnt/c/Music/"), F.col("s_suppkey").cast("string"))).alias("native"), T.bitrate_text(F.lit("320400")).alias("bitrate"), T.tech_format(F.lit("mp3,x"), F.lit("")).alias("container"),
    )
