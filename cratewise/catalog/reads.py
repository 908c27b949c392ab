"""Read, identity and taxonomy queries: users of ``events`` as tracks, ``part`` names as labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reads as R
from ..operators import profiles, taxonomy
from .registry import KEYSTONE_SQL, READS_SQL, packed_reads, query, table, user_reads

TALLY = f"""{READS_SQL}, t AS (SELECT user_id, {KEYSTONE_SQL} AS keystone, sum(score) AS weight FROM reads WHERE score > 0 GROUP BY ALL),
w AS (SELECT *, weight / sum(weight) OVER (PARTITION BY user_id) AS share, row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, keystone) AS n FROM t)"""


def _tall(spark, d):
    return user_reads(spark, d).withColumn("pos", F.hash("style")).withColumn("tier", F.lit(0))


def _dim(tall, **options):
    return taxonomy.style_dim(tall, "style", **options)


@query(f"WITH {TALLY} SELECT user_id, keystone, round(weight, 4) AS weight, round(share, 6) AS share FROM w")
def style_tally(spark, d):
    """Style scores summed onto keystones with normalised shares."""
    tall = _tall(spark, d)
    out = taxonomy.tally(tall, "user_id", _dim(tall))
    return out.select("user_id", "keystone", F.round("weight", 4).alias("weight"), F.round("share", 6).alias("share"))


CLASSES = f"""{TALLY}, top AS (SELECT user_id, max(CASE WHEN n = 1 THEN keystone END) AS k1, max(CASE WHEN n = 1 THEN share END) AS s1,
 max(CASE WHEN n = 2 AND share >= 0.35 THEN keystone END) AS k2 FROM w GROUP BY user_id),
ov AS (SELECT user_id FROM events WHERE value > 200 GROUP BY 1),
cls AS (SELECT t.user_id, CASE WHEN o.user_id IS NOT NULL THEN 'Trance' ELSE k1 END AS k1, CASE WHEN o.user_id IS NULL THEN k2 END AS k2,
 CASE WHEN o.user_id IS NOT NULL THEN 1.0 ELSE s1 END AS s1 FROM top t LEFT JOIN ov o USING (user_id))"""
FAMILY = "CASE WHEN {k} IN ('House', 'Techno', 'Trance') THEN 'Dance' WHEN {k} IN ('Drum n Bass', 'Dubstep') THEN 'Bass' ELSE 'Chill' END"


def _classes(spark, d):
    tall = _tall(spark, d)
    overrides = table(spark, d, "events").where("value > 200").select("user_id").distinct().withColumn("override", F.lit("Uplifting Trance"))
    return taxonomy.classify(tall, "user_id", _dim(tall), overrides)


@query(f"""WITH {CLASSES} SELECT user_id, round_even(s1, 4) AS share,
 CASE WHEN k2 IS NULL THEN k1 WHEN least(k1, k2) = 'Drum n Bass' AND greatest(k1, k2) = 'Dubstep' THEN 'Drumstep' ELSE k1 || ' / ' || k2 END AS label,
 CASE WHEN k2 IS NULL THEN k1 ELSE least(k1, k2) || ' + ' || greatest(k1, k2) END AS "group", {FAMILY.format(k='k1')} AS family,
 CASE WHEN k1 IN ('House', 'Techno', 'Trance') THEN k1 WHEN k1 IN ('Drum n Bass', 'Dubstep') THEN 'Bass' ELSE 'Chill' END AS archgenre,
 coalesce({FAMILY.format(k='k1')} <> CASE WHEN k2 IS NULL THEN NULL ELSE {FAMILY.format(k='k2')} END, false) AS cross_family, k2 IS NOT NULL AS fusion FROM cls""")
def track_classes(spark, d):
    """Keystones, fusion label, group, family and archgenre of each track; overrides win."""
    return _classes(spark, d).drop("keystones")


ARCH = "CASE WHEN {k} IN ('House', 'Techno', 'Trance') THEN {k} WHEN {k} IN ('Drum n Bass', 'Dubstep') THEN 'Bass' ELSE 'Chill' END"


@query(f"""WITH {CLASSES}, sh AS (SELECT user_id, string_agg(keystone || ' ' || printf('%.4f', round_even(share, 4)), ', ' ORDER BY weight DESC) AS shares FROM w GROUP BY 1),
sb AS (SELECT r.user_id, string_agg(style || ' ' || printf('%.2f', score) || ' ' || keystone, ', ' ORDER BY weight DESC, score DESC) AS subgenres
 FROM (SELECT *, {KEYSTONE_SQL} AS keystone FROM reads WHERE score > 0) r JOIN w USING (user_id, keystone) GROUP BY 1)
SELECT user_id, CASE WHEN o.user_id IS NULL THEN shares ELSE 'Trance 1.0000' END AS shares, CASE WHEN o.user_id IS NULL THEN subgenres ELSE 'Uplifting Trance 1.00 Trance' END AS subgenres,
 CASE WHEN k2 IS NULL OR {FAMILY.format(k='k1')} = {FAMILY.format(k='k2')} THEN {FAMILY.format(k='k1')} ELSE {FAMILY.format(k='k1')} || ', ' || {FAMILY.format(k='k2')} END AS families,
 CASE WHEN k2 IS NULL OR {ARCH.format(k='k1')} = {ARCH.format(k='k2')} THEN {ARCH.format(k='k1')} ELSE {ARCH.format(k='k1')} || ', ' || {ARCH.format(k='k2')} END AS archgenres,
 o.user_id IS NOT NULL AS override FROM cls LEFT JOIN sh USING (user_id) LEFT JOIN sb USING (user_id) LEFT JOIN ov o USING (user_id)""")
def track_records(spark, d):
    """The whole classification record: shares, ordered subgenres, families, archgenres, the override's entry."""
    tall = _tall(spark, d)
    overrides = table(spark, d, "events").where("value > 200").select("user_id").distinct().withColumn("override", F.lit("Uplifting Trance"))
    found = taxonomy.classification_records(tall, "user_id", _dim(tall), overrides)
    share = F.transform(F.map_keys("shares"), lambda k: F.concat(k, F.lit(" "), F.format_string("%.4f", F.element_at("shares", k))))
    sub = F.transform("subgenres", lambda s: F.concat(s["style"], F.lit(" "), F.format_string("%.2f", s["score"]), F.lit(" "), s["keystone"]))
    return found.select(
        "user_id", F.array_join(share, ", ").alias("shares"), F.array_join(sub, ", ").alias("subgenres"),
        F.array_join("families", ", ").alias("families"), F.array_join("archgenres", ", ").alias("archgenres"), "override",
    )


@query(f"""WITH {CLASSES}, u AS (SELECT k1 AS keystone FROM cls UNION ALL SELECT k2 FROM cls WHERE k2 IS NOT NULL) SELECT keystone, count(*) AS count FROM u GROUP BY 1""")
def keystone_membership(spark, d):
    """Tracks per keystone, a fusion under each of its two."""
    return profiles.membership_counts(_classes(spark, d), "keystones")


@query(f"""WITH {READS_SQL}, k AS (SELECT *, {KEYSTONE_SQL} AS keystone FROM reads WHERE score > 0)
SELECT user_id, keystone, max_by(style, score) AS subgenre, max(score) AS score FROM k GROUP BY ALL""")
def dominant_subgenres(spark, d):
    """The strongest style of a track inside each keystone (T4)."""
    tall = _tall(spark, d)
    return taxonomy.dominant_subgenre(tall, "user_id", _dim(tall))


LABEL_SQL = """CASE p_type WHEN 'ECONOMY' THEN 'Electronic---Tech House' WHEN 'LARGE' THEN 'Rock---Death Metal' WHEN 'MEDIUM' THEN split_part(p_name, ' ', 1) || ' Drum n Bass'
 WHEN 'STANDARD' THEN 'Jazz---Bop' WHEN 'SMALL' THEN 'Non-Music---Spoken Word' ELSE split_part(p_name, ' ', 1) || ' Trap Wave' END"""


def part_labels(spark, d):
    word = F.substring_index("p_name", " ", 1)
    kind = lambda t, v: (F.col("p_type") == t, v if not isinstance(v, str) else F.lit(v))
    label = F.concat(word, F.lit(" Trap Wave"))
    for cond, value in (kind("ECONOMY", "Electronic---Tech House"), kind("LARGE", "Rock---Death Metal"), kind("MEDIUM", F.concat(word, F.lit(" Drum n Bass"))),
                        kind("STANDARD", "Jazz---Bop"), kind("SMALL", "Non-Music---Spoken Word")):
        label = F.when(cond, value).otherwise(label)
    return table(spark, d, "part").select("p_partkey", label.alias("label"))


@query(f"""SELECT p_partkey, {LABEL_SQL} AS label, CASE p_type WHEN 'ECONOMY' THEN 'House' WHEN 'LARGE' THEN 'Metal' WHEN 'MEDIUM' THEN 'Drum n Bass' WHEN 'STANDARD' THEN 'Jazz'
 WHEN 'SMALL' THEN NULL ELSE 'Dubstep' END AS keystone FROM part""")
def style_keystones(spark, d):
    """Labels resolved by parent, table, rock look and head noun, once per distinct name."""
    labels = part_labels(spark, d)
    return labels.join(taxonomy.style_dim(labels, "label"), "label").select("p_partkey", "label", "keystone")


@query(f"""SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'Club' WHEN 'LARGE' THEN 'Metal' WHEN 'MEDIUM' THEN 'Drum n Bass' WHEN 'STANDARD' THEN 'Jazz' WHEN 'SMALL' THEN NULL ELSE 'Dubstep' END AS keystone,
 CASE p_type WHEN 'ECONOMY' THEN 'Rooms' WHEN 'MEDIUM' THEN 'Bass' WHEN 'PROMO' THEN 'Bass' ELSE 'Other' END AS family,
 CASE p_type WHEN 'ECONOMY' THEN 'Club' WHEN 'MEDIUM' THEN 'Drum n Bass' WHEN 'PROMO' THEN 'Low End' ELSE 'Other' END AS archgenre FROM part""")
def overlay_tiers(spark, d):
    """Family and archgenre under a user's overlay: alias, family, moved and stand-alone archgenre."""
    overlay = taxonomy.Overlay(aliases={"Tech House": "Club"}, family={"Club": "Rooms"}, archgenre={"Drum n Bass": "", "Dubstep": "Low End"})
    labels = part_labels(spark, d)
    dim = taxonomy.style_dim(labels, "label", overlay).select(
        "label", "keystone", taxonomy.family(F.col("keystone"), overlay).alias("family"), taxonomy.archgenre(F.col("keystone"), overlay).alias("archgenre")
    )
    return labels.join(dim, "label").select("p_partkey", "keystone", "family", "archgenre")


STEP = "greatest(-3, least(3, n_err - 12))"


def _edited(spark, d):
    """(user_id, read, n, n_err, peak, steps, drops) with adjustments worked out from the user's own events."""
    stats = table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_err"), F.max("value").alias("peak")
    )
    steps = F.create_map(F.lit("Deep House"), (F.col("n_err") - 12).cast("int"), F.lit("Trance"), F.lit(2))
    return packed_reads(user_reads(spark, d)).join(stats, "user_id").withColumn("steps", steps).withColumn("drops", F.array(F.lit("Dark Ambient "), F.lit("")))


BLEND = f"""{READS_SQL}, st AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_err, max(value) AS peak FROM events GROUP BY 1),
cnt AS (SELECT user_id, count(*) AS styles FROM reads GROUP BY 1),
kept AS (SELECT r.* FROM reads r JOIN cnt c USING (user_id) WHERE NOT (style = 'Dark Ambient' AND styles > 1)),
mass AS (SELECT user_id, sum(score) * 0.09 AS entry FROM kept GROUP BY 1),
lifted AS (SELECT k.user_id, style, CASE WHEN style = 'Deep House' THEN CASE WHEN n_err - 12 > 0 AND score < entry THEN entry ELSE score END * pow(1.9, {STEP}) ELSE score END AS s
 FROM kept k JOIN mass USING (user_id) JOIN st USING (user_id)
 UNION ALL SELECT user_id, 'Trance', entry * pow(1.9, 2) FROM mass
 UNION ALL SELECT m.user_id, 'Deep House', entry * pow(1.9, {STEP}) FROM mass m JOIN st USING (user_id) WHERE n_err - 12 > 0 AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.user_id = m.user_id AND k.style = 'Deep House')),
blend AS (SELECT user_id, style, s / sum(s) OVER (PARTITION BY user_id) AS score FROM lifted)"""


@query(f"WITH {BLEND} SELECT user_id, style, round_even(score, 4) AS score FROM blend")
def blend_adjust(spark, d):
    """Reads after hand steps and drops: raised, entered, dropped, renormalised."""
    out = _edited(spark, d).select("user_id", F.explode(R.adjust(F.col("read"), F.col("steps"), F.col("drops"))).alias("e"))
    return out.select("user_id", "e.style", "e.score")


@query(f"""WITH {BLEND}, flat AS (SELECT user_id, max_by(style, score) AS style, max(score) AS score FROM reads GROUP BY 1),
b AS (SELECT user_id, max_by(style, score) AS style, max(score) AS score FROM blend GROUP BY 1)
SELECT user_id, CASE WHEN peak > 200 THEN 'Uplifting' WHEN n_err > 12 THEN b.style WHEN n > 70 THEN 'Breaks' ELSE f.style END AS style,
 CASE WHEN peak > 200 THEN 1.0 WHEN n_err > 12 THEN round_even(b.score, 4) WHEN n > 70 THEN 0.5 ELSE round_even(f.score, 4) END AS score,
 CASE WHEN peak > 200 THEN 'override' WHEN n_err > 12 THEN 'weights' WHEN n > 70 THEN 'relabel' WHEN n > 60 THEN 'salience' ELSE 'styles' END AS source
FROM st JOIN flat f USING (user_id) JOIN b USING (user_id)""")
def identity_chain(spark, d):
    """One style per track by precedence override, weights, relabel, salience, styles."""
    rows = _edited(spark, d)
    on = lambda cond, c: F.when(cond, c)
    relabel = F.array(F.struct(F.lit("Breaks").alias("style"), F.lit(0.5).alias("score")))
    touched = F.col("n_err") > 12
    # A touched track keeps its plain read below the blend; an untouched one may carry a re-label.
    who = R.identity(
        on(F.col("peak") > 200, F.lit("Uplifting")), on(~touched & (F.col("n") > 70), relabel), on(F.col("n") > 60, F.col("read")), F.col("read"),
        on(touched, F.col("steps")), on(touched, F.col("drops")),
    )
    return rows.select("user_id", who.alias("i")).select("user_id", "i.style", "i.score", "i.source")


SHARES = f"""{READS_SQL}, sh AS (SELECT user_id, style, score / sum(score) OVER (PARTITION BY user_id) AS score,
 row_number() OVER (PARTITION BY user_id ORDER BY score DESC, style) AS n FROM reads)"""


def _shares(spark, d):
    total = F.aggregate("read", F.lit(0.0), lambda a, e: a + e["score"])
    return packed_reads(user_reads(spark, d)).withColumn(
        "read", F.transform("read", lambda e: F.struct(e["style"].alias("style"), (e["score"] / total).alias("score")))
    )


@query(f"WITH {SHARES} SELECT user_id, style, round_even(score, 4) AS score FROM sh WHERE n > 1 AND n <= 6 AND round_even(score, 4) >= 0.03")
def override_candidates(spark, d):
    """Runners-up worth offering as a correction."""
    out = _shares(spark, d).select("user_id", F.explode(R.candidates(F.col("read"), F.col("read")[0]["style"])).alias("e"))
    return out.select("user_id", "e.style", "e.score")


@query(f"""WITH {SHARES} SELECT a.user_id, b.style, round_even(b.score / (a.score + b.score), 3) AS weight FROM sh a JOIN sh b ON a.user_id = b.user_id AND a.n = 1 AND b.n = 2""")
def second_style(spark, d):
    """The runner-up style and its blend weight (P10)."""
    top = F.col("read")[0]
    out = _shares(spark, d).select("user_id", R.second_style(F.col("read"), top["style"], top["score"], F.lit(None).cast("string")).alias("s"))
    return out.where("s is not null").select("user_id", "s.style", "s.weight")


@query(f"""WITH {SHARES}, t AS (SELECT user_id, max(CASE WHEN score >= 0.02 THEN 1 ELSE 0 END) AS strong FROM sh GROUP BY 1)
SELECT user_id, style, round(score, 6) AS score FROM sh JOIN t USING (user_id) WHERE CASE WHEN strong = 1 THEN score >= 0.02 AND n <= 5 ELSE n = 1 END""")
def flat_trim(spark, d):
    """Flat read at the stored length: entries from 0.02 on, five at most."""
    out = _shares(spark, d).select("user_id", F.explode(R.trim_flat(F.col("read"))).alias("e"))
    return out.select("user_id", "e.style", F.round("e.score", 6).alias("score"))


@query(f"""WITH {READS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, style) AS n FROM reads), t AS (SELECT user_id, style, score FROM r WHERE n = 1),
l AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)
SELECT t.user_id, style, round_even(score, 4) AS score, l.user_id IS NOT NULL AS in_training FROM t LEFT JOIN l USING (user_id) WHERE style = 'Deep House' OR {KEYSTONE_SQL} = 'House'""")
def genre_tracks(spark, d):
    """Tracks that read as a genre or roll up to it, with a training flag."""
    tall = _tall(spark, d)
    top = packed_reads(tall.drop("pos", "tier")).select("user_id", F.col("read")[0]["style"].alias("style"), F.col("read")[0]["score"].alias("score"))
    tracks = top.join(_dim(tall), "style")
    labels = table(spark, d, "events").where("event_type = 'purchase' and value > 100").select("user_id", F.lit("HOUSE").alias("genre"))
    return taxonomy.genre_tracks(tracks, "user_id", " house", labels, labels)[0]


@query("""WITH e AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'aliases' WHEN 'assistant' THEN 'archgenre' ELSE 'nope' END AS section, CASE WHEN length(text) % 3 = 0 THEN NULL WHEN length(text) % 3 = 1 THEN '' ELSE 'V' || conv_id END AS value FROM conversations),
l AS (SELECT section, 'k' || conv_id AS name, arg_max(coalesce(value, '~'), turn) AS value FROM e GROUP BY ALL) SELECT section, name, value FROM l WHERE value <> '~' AND section <> 'nope' AND (value <> '' OR section = 'archgenre')""")
def overlay_patch(spark, d):
    """Taxonomy overlay after patch events: null removes, a blank only stays for an archgenre."""
    c = table(spark, d, "conversations")
    kind = F.length("text") % 3
    name = F.concat(F.lit(" K"), F.col("conv_id").cast("string"))
    events = c.select(
        F.when(F.col("role") == "user", "aliases").when(F.col("role") == "assistant", "archgenre").otherwise("nope").alias("section"),
        F.when(F.col("role") == "user", name).otherwise(F.lower(name)).alias("name"),
        F.when(kind == 1, " ").when(kind == 2, F.concat(F.lit("V"), F.col("conv_id").cast("string"))).alias("value"), F.col("turn").alias("updated"),
    )
    return taxonomy.patch_overlay(events)


@query(f"""WITH {SHARES}, st AS (SELECT user_id, max(value) AS peak FROM events GROUP BY 1), t AS (SELECT user_id, style, round_even(score, 4) AS score FROM sh WHERE n = 1)
SELECT user_id, CASE WHEN peak > 200 THEN 'Techno' ELSE style END AS style, CASE WHEN peak > 200 THEN 'override' ELSE 'salience' END AS source, CASE WHEN peak > 200 THEN style END AS model_top,
 CASE WHEN peak > 200 THEN false WHEN style = 'Deep House' THEN true ELSE false END AS agrees FROM t JOIN st USING (user_id)""")
def identity_fields(spark, d):
    """The identity with the model's own read under an override and the file tag's opinion."""
    peaks = table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("peak"))
    rows = _shares(spark, d).join(peaks, "user_id")
    none = lambda t: F.lit(None).cast(t)
    who = R.identity(F.when(F.col("peak") > 200, "Techno"), none(R.READ_TYPE), F.col("read"), none(R.READ_TYPE), none("map<string,int>"), none("array<string>"))
    named = rows.select("user_id", "read", who.alias("i"))
    shown = taxonomy.style_dim(named.select(F.col("i.style").alias("s")), "s")
    joined = named.join(shown, F.col("i.style") == F.col("s"))
    fields = R.identity_fields(F.col("i"), F.col("read"), F.lit("House Music"), F.lit("House"), F.col("keystone"))
    out = joined.select("user_id", fields.alias("f"))
    return out.select("user_id", F.col("f.dominant_style").alias("style"), F.col("f.dominant_source").alias("source"), F.try_element_at("f.model_read", F.lit(1))["style"].alias("model_top"), "f.file_tag.agrees")
