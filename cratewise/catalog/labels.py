"""Label, credit and training-set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import credits, labels as L, taxonomy
from .reads import LABEL_SQL, part_labels
from .registry import query, style_of, table

UNION = """u AS (SELECT doc_id AS hash, lang AS genre, 'override' AS source FROM documents WHERE n_chars > 3000
UNION ALL SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, 'weight' FROM labels UNION ALL SELECT item_id, 'bench', 'blind' FROM benchmark UNION ALL SELECT doc_id + 100000000, 'x', 'blind' FROM labels),
lu AS (SELECT * FROM u WHERE hash IN (SELECT doc_id FROM documents))"""


def _union(spark, d):
    docs, marks = table(spark, d, "documents"), table(spark, d, "labels")
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("hash"), F.lit("bench").alias("genre"))
    orphan = marks.select((F.col("doc_id") + 100000000).alias("hash"), F.lit("x").alias("genre"))
    sources = {
        "override": docs.where("n_chars > 3000").select(F.col("doc_id").alias("hash"), F.col("lang").alias("genre")),
        "weight": marks.select(F.col("doc_id").alias("hash"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("genre")),
        "blind": bench.unionByName(orphan),
    }
    return L.label_union(sources, docs.select(F.col("doc_id").alias("hash")), "hash")


@query(f"WITH {UNION} SELECT hash, genre, source FROM lu")
def label_union(spark, d):
    """One row per (track, source) of every label source; labels without a track are dropped."""
    return _union(spark, d)


@query(f"WITH {UNION} SELECT hash, arg_min(genre, CASE source WHEN 'override' THEN 0 WHEN 'weight' THEN 1 ELSE 2 END) AS genre, arg_min(source, CASE source WHEN 'override' THEN 0 WHEN 'weight' THEN 1 ELSE 2 END) AS source FROM lu GROUP BY 1")
def label_priority(spark, d):
    """One label per track by source priority."""
    return L.resolve_priority(_union(spark, d), "hash", L.SOURCES)


@query("SELECT count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) AND source <> ''")
def unlabelled_queue(spark, d):
    """How many tracks the labelling queue still holds."""
    docs = table(spark, d, "documents")
    out = L.unlabelled(docs, table(spark, d, "labels"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "source")
    return out.agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) AND source <> ''
ORDER BY md5('0:' || doc_id), doc_id LIMIT 1""")
def next_unlabelled(spark, d):
    """The next track to label: unlabelled, not skipped, in seeded hash order."""
    skip = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return L.next_unlabelled(table(spark, d, "documents"), table(spark, d, "labels"), skip, "doc_id", "source").select("doc_id", "lang", "source")


@query("""WITH p AS (SELECT c_custkey, least(n_name, c_mktsegment) || ' + ' || greatest(n_name, c_mktsegment) AS boundary FROM customer JOIN nation ON c_nationkey = n_nationkey),
z AS (SELECT boundary, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, boundary) AS place FROM p GROUP BY 1)
SELECT boundary, CASE WHEN place <= 3 THEN 0 ELSE 1 END::INT AS tier, place::INT AS place, unnest(range(1, size + 1)) AS turn FROM z""")
def contested_order(spark, d):
    """Turns of the contested queue: three largest boundaries first, one track of each in turn."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = L.contested_order(rows, "c_custkey", "n_name", "c_mktsegment")
    return out.select("boundary", "tier", "place", "turn")


@query("SELECT source, lang AS kind, count(*) AS n, count(DISTINCT lower(lang)) AS genres, count(*) FILTER (lower(lang) <> CASE WHEN n_chars > 500 THEN upper(lang) ELSE lang END) AS respelled FROM documents GROUP BY ALL")
def label_report(spark, d):
    """Labels per source and kind with distinct genres and respellings."""
    rows = table(spark, d, "documents").select("source", F.col("lang").alias("kind"), F.lower("lang").alias("genre"), F.when(F.col("n_chars") > 500, F.upper("lang")).otherwise(F.col("lang")).alias("raw"))
    return L.label_report(rows)


@query("SELECT source AS genre, count(*) AS n, CASE WHEN count(*) >= 20 THEN 'ready' WHEN count(*) >= 5 THEN 'thin' ELSE 'sparse' END AS state, greatest(0, 20 - count(*)) AS needs FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def training_readiness(spark, d):
    """Examples per genre and what is still needed."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("source").alias("genre"))
    return L.readiness(rows)


@query("SELECT count(*) AS total, count(h) AS relabelled, count(DISTINCT h) AS heads, coalesce(bool_or(h <> 'q1'), false) AS stale FROM (SELECT 'q' || quality AS h FROM documents LEFT JOIN labels USING (doc_id))")
def relabel_status(spark, d):
    """Coverage and staleness of re-labels."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("h"))
    return L.relabel_status(rows, "h", "q1")


@query("SELECT 'q' || quality AS h, count(*) AS n FROM labels GROUP BY 1")
def head_counts(spark, d):
    """Tracks per head."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("h"))
    return L.head_counts(rows, "h")


@query("SELECT doc_id AS hash, CASE WHEN bool_or(f) THEN 'folder' ELSE min(s) END AS source FROM (SELECT doc_id, true AS f, NULL AS s FROM documents WHERE n_chars > 1000 UNION ALL SELECT doc_id, false, CASE WHEN toxic = 1 THEN 'label' ELSE 'q' || quality END FROM labels) GROUP BY 1")
def training_manifest(spark, d):
    """Manifest entries: folder content first, then label rows, each once."""
    folder = table(spark, d, "documents").where("n_chars > 1000").select(F.col("doc_id").alias("hash"))
    marks = table(spark, d, "labels").select(F.col("doc_id").alias("hash"), F.when(F.col("toxic") == 0, F.concat(F.lit("q"), F.col("quality").cast("string"))).alias("source"))
    return L.manifest(folder, marks, "hash")


@query("SELECT doc_id + (CASE WHEN toxic = 1 THEN 100000000 ELSE 0 END) AS doc_id, toxic = 0 AS found FROM labels")
def manifest_import(spark, d):
    """Which manifest entries the library holds."""
    wanted = table(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 100000000).otherwise(0)).alias("doc_id"))
    found, missing = L.import_manifest(wanted, table(spark, d, "documents"), "doc_id")
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query("SELECT p_type AS genre FROM part UNION SELECT p_brand FROM part UNION SELECT r_name FROM region")
def vocabulary(spark, d):
    """Distinct union of name tables (U4)."""
    part = table(spark, d, "part")
    return L.vocabulary(part.select("p_type"), part.select("p_brand"), table(spark, d, "region").select("r_name"))


RAW_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'tech  HOUSE' WHEN 'LARGE' THEN 'Rock / ' || p_brand WHEN 'MEDIUM' THEN 'Drum & Bass (' || p_name || ')' WHEN 'STANDARD' THEN '(' || p_size || ')'
 WHEN 'SMALL' THEN 'Electronic Music' ELSE p_name END"""


def _raw(spark, d):
    t = F.col("p_type")
    raw = (
        F.when(t == "ECONOMY", "tech  HOUSE").when(t == "LARGE", F.concat(F.lit("Rock / "), F.col("p_brand")))
        .when(t == "MEDIUM", F.concat(F.lit("Drum & Bass ("), F.col("p_name"), F.lit(")"))).when(t == "STANDARD", F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")))
        .when(t == "SMALL", "Electronic Music").otherwise(F.col("p_name"))
    )
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


def _dims(spark, d):
    spelled = part_labels(spark, d).where("label like 'Electronic---%' or label like 'Rock---%'").select("label").distinct()
    named = part_labels(spark, d).where("label like '%Drum n Bass'").select(F.lit("Electronic---Drum n Bass").alias("label")).distinct()
    return L.genre_dims(spelled.union(named))


@query(f"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Tech House' WHEN 'LARGE' THEN 'Rock' WHEN 'MEDIUM' THEN 'Drum n Bass' WHEN 'PROMO' THEN p_name END AS genre,
 CASE p_type WHEN 'ECONOMY' THEN 'style' WHEN 'LARGE' THEN 'parent' WHEN 'MEDIUM' THEN 'style' WHEN 'SMALL' THEN 'umbrella' WHEN 'PROMO' THEN 'other' END AS kind FROM part""")
def genre_normaliser(spark, d):
    """Raw genre names onto styles, parents or their own spelling."""
    raw = _raw(spark, d)
    named = L.normalise_genres(raw, "raw", *_dims(spark, d), "p_partkey")
    return raw.join(named, "raw").select("p_partkey", "genre", "kind")


@query("""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Tech House' WHEN 'MEDIUM' THEN 'Drum n Bass' WHEN 'SMALL' THEN 'Rock' END AS genre,
 CASE p_type WHEN 'ECONOMY' THEN 'style' WHEN 'LARGE' THEN 'ambiguous' WHEN 'MEDIUM' THEN 'style' WHEN 'STANDARD' THEN 'ambiguous' WHEN 'SMALL' THEN 'parent' ELSE 'umbrella' END AS kind FROM part""")
def tag_normaliser(spark, d):
    """Whole tag values: one specific genre wins, several are ambiguous, a shelf is none."""
    t = F.col("p_type")
    tag = (
        F.when(t == "ECONOMY", "Tech House; Electronic").when(t == "LARGE", "Tech House, Rock").when(t == "MEDIUM", "Electro|drum and bass")
        .when(t == "STANDARD", "Electro").when(t == "SMALL", "Dance;rock;1995").otherwise("Club; EDM")
    )
    rows = table(spark, d, "part").select("p_partkey", tag.alias("tag"))
    named = L.normalise_tags(rows, "tag", *_dims(spark, d), "p_partkey")
    return rows.join(named, "tag").select("p_partkey", "genre", "kind")


@query("""WITH e AS (SELECT event_id, event_type, value FROM events)
SELECT event_id, CASE event_type WHEN 'view' THEN 'House' WHEN 'click' THEN NULL WHEN 'purchase' THEN 'Drum n Bass' WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'Hard Dance' END
  ELSE CASE WHEN event_id % 2 = 0 THEN 'Ambient' ELSE 'Trance' END END AS tag_keystone,
 CASE event_type WHEN 'view' THEN true WHEN 'purchase' THEN true WHEN 'error' THEN event_id % 2 = 0 WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN false END END AS agrees FROM e""")
def tag_agreement(spark, d):
    """The file tag's keystone against the shown style's; the genre graph is asked before the head noun."""
    graph = spark.createDataFrame([("hard wave", "Hard Dance"), ("sad house", "Ambient"), ("techno", "Ambient")], "name string, keystone string")
    odd = F.col("event_id") % 2 != 0
    e = F.col("event_type")
    tag = (
        F.when(e == "view", "Tech House; Electro").when(e == "click", "Techno / House").when(e == "purchase", "drum & bass")
        .when(e == "signup", F.when(odd, "Electronic").otherwise("Electronic; Hard  Wave")).otherwise(F.when(odd, "Trance|Dance").otherwise("Sad House"))
    )
    rows = table(spark, d, "events").select("event_id", style_of().alias("style"), tag.alias("tag"))
    tags = L.tag_keystones(rows, "tag", graph=graph).withColumnRenamed("keystone", "tag_keystone")
    shown = taxonomy.style_dim(rows, "style").withColumnRenamed("keystone", "shown")
    out = rows.join(tags, "tag").join(shown, "style")
    return out.select("event_id", "tag_keystone", L.agreement(F.col("tag_keystone"), F.col("shown")).alias("agrees"))


@query("""WITH w AS (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)),
k AS (SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM w)) SELECT p_partkey, p_name FROM k WHERE p_name IN (SELECT p_name FROM k GROUP BY 1 HAVING count(*) >= 30)""")
def complete_rows(spark, d):
    """Tracks every candidate has embedded, in classes large enough for the folds."""
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_returnflag").alias("candidate"))
    flags = lines.select("candidate").distinct().count()
    return L.complete_rows(lines, "p_partkey", flags, table(spark, d, "part").select("p_partkey", "p_name"), "p_name", 30)


@query(f"""WITH r AS (SELECT p_partkey, {LABEL_SQL} AS label, CASE p_type WHEN 'SMALL' THEN 'no keystone' ELSE CASE WHEN p_size < 5 THEN 'no path' WHEN p_size < 10 THEN 'unavailable' WHEN p_retailprice > 1090 THEN 'missing' END END AS reason, p_name FROM part),
k AS (SELECT p_name, count(*) AS n FROM r WHERE reason IS NULL GROUP BY 1)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY 1 UNION ALL SELECT CASE WHEN n < 15 THEN 'dropped class' ELSE 'used' END, sum(n)::BIGINT FROM k GROUP BY 1""")
def exclusion_report(spark, d):
    """Why labelled tracks are left out of a training set."""
    p = table(spark, d, "part")
    reason = L.exclusion_reason(F.when(F.col("p_type") != "SMALL", F.col("p_type")), F.when(F.col("p_size") >= 5, "x"), F.col("p_size") >= 10, F.col("p_retailprice") <= 1090)
    return L.exclusion_report(p.select("p_partkey", F.col("p_name").alias("keystone"), reason.alias("reason")), "p_partkey", 15)


CREDIT_SQL = """CASE l_returnflag WHEN 'A' THEN split_part(p_name, ' ', 1) || ' feat. ' || split_part(p_name, ' ', 2) WHEN 'N' THEN split_part(p_name, ' ', 1) || ' & ' || p_type ELSE p_brand || '/' || p_type END"""


def _credits(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    first, second, flag = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1), F.col("l_returnflag")
    credit = (
        F.when(flag == "A", F.concat(first, F.lit(" feat. "), second)).when(flag == "N", F.concat(first, F.lit(" & "), F.col("p_type")))
        .otherwise(F.concat("p_brand", F.lit("/"), F.col("p_type")))
    )
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", credit.alias("credit"))


INDEX = f"""c AS (SELECT l_returnflag, p_name, p_type, p_brand, {CREDIT_SQL} AS credit FROM lineitem JOIN part ON l_partkey = p_partkey),
names AS (SELECT split_part(p_name, ' ', 1) AS name FROM c WHERE l_returnflag = 'A' UNION ALL SELECT split_part(p_name, ' ', 2) FROM c WHERE l_returnflag = 'A' UNION ALL SELECT credit FROM c WHERE l_returnflag <> 'A'
 UNION ALL SELECT p_brand FROM c WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT p_type FROM c WHERE l_returnflag NOT IN ('A', 'N')),
idx AS (SELECT name, count(*) AS seen FROM names GROUP BY 1)"""


@query(f"WITH {INDEX} SELECT name, seen FROM idx")
def credit_index(spark, d):
    """Occurrences of whole pieces and their parts over all credits."""
    return credits.evidence_index(_credits(spark, d), "credit")


@query(f"""WITH {INDEX}, dc AS (SELECT DISTINCT l_returnflag, p_name, p_type, p_brand, credit FROM c),
f AS (SELECT credit, 0 AS pos, split_part(p_name, ' ', 1) AS artist FROM dc WHERE l_returnflag = 'A' UNION SELECT credit, 1, split_part(p_name, ' ', 2) FROM dc WHERE l_returnflag = 'A'),
n AS (SELECT DISTINCT credit, split_part(p_name, ' ', 1) AS a, p_type AS b FROM dc WHERE l_returnflag = 'N'),
nk AS (SELECT n.*, greatest(coalesce(x.seen, 0), coalesce(y.seen, 0)) AS known, z.seen AS pairing FROM n LEFT JOIN idx x ON x.name = a LEFT JOIN idx y ON y.name = b LEFT JOIN idx z ON z.name = credit),
r AS (SELECT DISTINCT credit, p_brand AS a, p_type AS b FROM dc WHERE l_returnflag NOT IN ('A', 'N')),
rk AS (SELECT r.*, z.seen > 2 AND x.seen = z.seen AND y.seen = z.seen AS act FROM r JOIN idx x ON x.name = a JOIN idx y ON y.name = b JOIN idx z ON z.name = credit)
SELECT credit, pos, artist FROM f
UNION ALL SELECT credit, 0, CASE WHEN known > 0 AND pairing <= known AND pairing <= 2 THEN a ELSE credit END FROM nk UNION ALL SELECT credit, 1, b FROM nk WHERE known > 0 AND pairing <= known AND pairing <= 2
UNION ALL SELECT credit, 0, CASE WHEN act THEN credit ELSE a END FROM rk UNION ALL SELECT credit, 1, b FROM rk WHERE NOT act""")
def credit_split(spark, d):
    """Every credit split into artists on library-wide evidence."""
    return credits.split_credits(_credits(spark, d), "credit")


@query("""WITH ar AS (SELECT lower(split_part(p_name, ' ', 2)) AS k, max(p_size // 10)::INT AS stars FROM part GROUP BY 1),
t AS (SELECT p_partkey, split_part(p_name, ' ', 1) || ' vs ' || upper(split_part(p_name, ' ', 2)) AS credit, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) AS b, CASE WHEN p_size > 40 THEN p_size % 6 END AS own FROM part)
SELECT p_partkey, greatest(coalesce(own, 0), coalesce((SELECT max(stars) FROM ar WHERE k IN (a, b) AND k <> 'ring'), 0))::INT AS stars FROM t""")
def artist_stars(spark, d):
    """Effective stars: the track's own or those of any of its artists."""
    part = table(spark, d, "part")
    last = F.substring_index("p_name", " ", -1)
    rated = part.groupBy(T.artist_key(last).alias("artist_key")).agg(F.max(F.floor(F.col("p_size") / 10)).cast("int").alias("stars")).where("artist_key <> 'ring'")
    tracks = part.select("p_partkey", F.concat(F.substring_index("p_name", " ", 1), F.lit(" vs "), F.upper(last)).alias("credit"))
    own = part.where("p_size > 40").select("p_partkey", (F.col("p_size") % 6).alias("stars"))
    return credits.artist_stars(tracks, "p_partkey", "credit", own, rated)
