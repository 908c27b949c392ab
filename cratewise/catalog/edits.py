"""Edit-event queries: ``conversations`` and ``events`` as append-only edit logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import reuse
from ..plans.guards import scratch_folder
from ..plans.ranks import group_rank
from .registry import STYLE_SQL, query, style_of, table


def _talk(spark, d):
    """Conversations as an edit log: the conversation is the entity, the turn its version."""
    return table(spark, d, "conversations")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN length(text) // 40 - 1 END AS stars, CASE WHEN role = 'assistant' THEN substr(upper(trim(text)), 1, 4) END AS grade,
 CASE WHEN role = 'system' THEN trim(text) WHEN turn = 3 THEN text END AS note FROM conversations)
SELECT conv_id, coalesce(greatest(0, least(5, arg_max(stars, turn) FILTER (stars IS NOT NULL))), 0)::INT AS stars, coalesce(arg_max(grade, turn) FILTER (grade IS NOT NULL), '') AS grade,
 coalesce(substr(trim(arg_max(note, turn) FILTER (note IS NOT NULL)), 1, 1000), '') AS note FROM r GROUP BY 1""")
def partial_ratings(spark, d):
    """Partial updates merged field by field."""
    t = _talk(spark, d)
    # The SQL's upper maps letter by letter, Spark's makes SS of a sharp s, which shifts the four letters of a grade.
    graded = F.translate("text", "ß", "ẞ")
    events = t.select(
        "conv_id", "turn", F.when(F.col("role") == "user", (F.floor(F.length("text") / 40) - 1).cast("string")).alias("stars"),
        F.when(F.col("role") == "assistant", graded).alias("grade"), F.when((F.col("role") == "system") | (F.col("turn") == 3), F.col("text")).alias("note"),
    )
    return E.rating_state(events, "conv_id", "turn")


@query("SELECT conv_id, role, arg_max(length(text), turn) AS chars, max(turn) AS turn FROM conversations GROUP BY ALL")
def event_latest_wins(spark, d):
    """The latest row per unique key."""
    rows = _talk(spark, d).select("conv_id", "role", F.length("text").cast("long").alias("chars"), "turn")
    return E.upsert(rows, ["conv_id", "role"], "turn")


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def toggle_parity(spark, d):
    """Memberships toggled an odd number of times."""
    return E.toggled(table(spark, d, "events").select("user_id", "event_type"), ["user_id", "event_type"])


@query("""SELECT 'orders' AS tab, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def cascade_forget(spark, d):
    """Forgotten keys leave every dependent table."""
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("hash"), "c_acctbal")
    tables = {"orders": table(spark, d, "orders").select(F.col("o_custkey").alias("hash")), "customer": customer}
    left = E.forget(tables, customer.where("c_acctbal < 0"), "hash")
    counts = [df.agg(F.lit(name).alias("tab"), F.count(F.lit(1)).alias("n")) for name, df in left.items()]
    return counts[0].unionByName(counts[1])


TRAIN = """ev AS (SELECT user_id AS hash, event_type AS genre, event_id, value > 5 AS ok FROM events), p AS (SELECT hash, genre, max(event_id) FILTER (ok) AS c, max(event_id) FILTER (NOT ok) AS r FROM ev GROUP BY ALL)"""


def _train(spark, d):
    return table(spark, d, "events").select(
        F.col("user_id").alias("hash"), F.col("event_type").alias("genre"), F.col("event_id").alias("updated"),
        F.when(F.col("value") > 5, "confirm").otherwise("reject").alias("action"), F.lit("propagation").alias("source"),
    )


@query(f"WITH {TRAIN} SELECT hash, genre, 'propagation' AS source FROM p WHERE c IS NOT NULL")
def training_labels(spark, d):
    """Confirmed labels (E5)."""
    return E.label_state(_train(spark, d), "hash")[0]


@query(f"WITH {TRAIN} SELECT hash, genre FROM p WHERE r IS NOT NULL AND (c IS NULL OR r > c)")
def training_rejects(spark, d):
    """Rejects not cleared by a later confirm (E5)."""
    return E.label_state(_train(spark, d), "hash")[1]


@query(f"WITH {TRAIN} SELECT hash, genre FROM p WHERE c IS NOT NULL AND lower(genre) <> 'view'")
def clear_genre(spark, d):
    """Labels left after one genre is cleared in any case."""
    return E.clear_genre(E.label_state(_train(spark, d), "hash")[0], " VIEW").select("hash", "genre")


@query("SELECT o_custkey AS hash, true AS known FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1 UNION ALL SELECT o_custkey, false FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) GROUP BY 1")
def manual_labels(spark, d):
    """Manual additions split into known tracks and unknown keys (E5)."""
    wanted = table(spark, d, "orders").select(F.col("o_custkey").alias("hash"))
    known, unknown = E.add_manual(wanted, table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("hash")), "hash", "House")
    return known.select("hash", F.lit(True).alias("known")).unionByName(unknown.withColumn("known", F.lit(False)))


OVERRIDES = """o AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN NULL WHEN value > 20 THEN event_type ELSE '///' END AS override FROM events),
l AS (SELECT user_id, arg_max(coalesce(override, ''), event_id) AS override FROM o WHERE override IS NULL OR override <> '///' GROUP BY 1)"""


@query(f"WITH {OVERRIDES} SELECT user_id, override FROM l WHERE override <> ''")
def override_state(spark, d):
    """Standing overrides; a clear removes, an unusable name is refused."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("updated"), F.when(F.col("event_type") == "error", None).when(F.col("value") > 20, F.concat(F.lit(" "), F.col("event_type"))).otherwise("///").alias("override"))
    return E.override_state(e, "user_id")


ADJUST = """s AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS sat, arg_max(floor(value / 10)::INT - 2, event_id) FILTER (event_type = 'view') AS house FROM events GROUP BY 1),
dr AS (SELECT user_id, max(event_id) FILTER (event_type = 'click' AND value > 30) AS dat, max(event_id) FILTER (event_type = 'click') AS lastd FROM events GROUP BY 1)"""


@query(f"""WITH {ADJUST} SELECT user_id, CASE WHEN sat IS NULL OR house = 0 OR (dat IS NOT NULL AND dat >= sat) THEN NULL ELSE greatest(-3, least(3, house)) END::INT AS house, CASE WHEN sat IS NOT NULL THEN 1 END::INT AS trance,
 (dat IS NOT NULL AND dat = lastd) AS dropped FROM s JOIN dr USING (user_id)""")
def adjustment_state(spark, d):
    """Steps and drops by latest part; a drop takes the step set before it."""
    e = F.col("event_type")
    steps = F.when(e == "view", F.create_map(F.lit("House"), (F.floor(F.col("value") / 10) - 2).cast("int"), F.lit(" Trance"), F.lit(1), F.lit("Zero"), F.lit(0)))
    drops = F.when(e == "click", F.when(F.col("value") > 30, F.array(F.lit("House "), F.lit(""), F.lit("House"))).otherwise(F.array().cast("array<string>")))
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("updated"), steps.alias("steps"), drops.alias("drops"))
    out = E.adjustment_state(events, "user_id")
    return out.select("user_id", F.try_element_at("steps", F.lit("House")).alias("house"), F.try_element_at("steps", F.lit("Trance")).alias("trance"), F.array_contains("drops", "House").alias("dropped"))


KEYFIX = """k AS (SELECT user_id, event_id, CASE event_type WHEN 'view' THEN 'A' WHEN 'click' THEN 'F#' WHEN 'purchase' THEN 'H' ELSE '' END AS key FROM events),
fix AS (SELECT user_id, arg_max(key, event_id) AS key FROM k WHERE key <> 'H' GROUP BY 1)"""


def _fixes(spark, d):
    e = F.col("event_type")
    key = F.when(e == "view", "A").when(e == "click", "F#").when(e == "purchase", "H")
    events = table(spark, d, "events").select("user_id", F.col("event_id").alias("updated"), key.alias("key"), F.lit("minor").alias("scale"))
    return E.key_corrections(events, "user_id")


@query(f"WITH {KEYFIX} SELECT user_id, key, 'minor' AS scale FROM fix WHERE key <> ''")
def key_corrections(spark, d):
    """Standing valid key corrections."""
    return _fixes(spark, d)


@query(f"""WITH {KEYFIX}, u AS (SELECT DISTINCT user_id FROM events) SELECT user_id, CASE WHEN key <> '' THEN key ELSE 'C' END AS key, CASE WHEN key <> '' THEN 'minor' ELSE 'major' END AS scale,
 CASE key WHEN 'A' THEN '8A' WHEN 'F#' THEN '11A' ELSE '8B' END AS camelot, CASE WHEN key <> '' THEN 'manual' ELSE 'detector' END AS key_source FROM u LEFT JOIN fix USING (user_id)""")
def corrected_keys(spark, d):
    """Detected keys overlaid by corrections."""
    tracks = table(spark, d, "events").select("user_id").distinct().select("user_id", F.lit("C").alias("key"), F.lit("major").alias("scale"), F.lit("8B").alias("camelot"))
    return E.corrected_keys(tracks, _fixes(spark, d), "user_id")


VIBES = """v AS (SELECT event_type AS vibe, CASE WHEN value > 250 THEN NULL ELSE user_id END AS hash, event_id, CASE WHEN value > 300 THEN 'clear' WHEN value > 250 THEN 'reset' WHEN value < 3 THEN 'remove' ELSE 'set' END AS action, round(value / 100 - 1, 4) AS weight FROM events),
w AS (SELECT vibe, max(event_id) FILTER (action = 'clear') AS c, max(event_id) FILTER (action = 'reset') AS r FROM v WHERE hash IS NULL GROUP BY 1),
m AS (SELECT vibe, hash, max(event_id) AS at_id, arg_max(action, event_id) AS action, arg_max(weight, event_id) AS weight FROM v WHERE hash IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {VIBES} SELECT m.vibe, hash, CASE WHEN r > at_id THEN 1.0 ELSE weight END AS weight FROM m LEFT JOIN w ON w.vibe = m.vibe WHERE action = 'set' AND (c IS NULL OR at_id > c)")
def vibe_members(spark, d):
    """Members and weights after set, remove, reset and clear."""
    v = F.col("value")
    events = table(spark, d, "events").select(
        F.col("event_type").alias("vibe"), F.when(v <= 250, F.col("user_id")).alias("hash"), F.col("event_id").alias("updated"),
        F.when(v > 300, "clear").when(v > 250, "reset").when(v < 3, "remove").otherwise("set").alias("action"), F.round(v / 100 - 1, 4).alias("weight"),
    )
    return E.vibe_members(events)


IMPORT = """inc AS (SELECT trim(p_type) AS name, l_orderkey AS hash, l_discount * 30 - 1 AS w, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_extendedprice) AS pos FROM lineitem JOIN part ON l_partkey = p_partkey),
l AS (SELECT name, hash, arg_max(greatest(-1, least(1, w)), pos) AS weight FROM inc GROUP BY ALL),
old AS (SELECT 'PROMO' AS name, o_orderkey AS hash, 0.5 AS weight FROM orders)"""


@query(f"WITH {IMPORT} SELECT name, hash, round(weight, 6) AS weight FROM l UNION ALL SELECT name, hash, weight FROM old WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.name = old.name AND l.hash = old.hash)")
def vibe_import(spark, d):
    """Imported vibes merged by name; weights clamped, later links win."""
    parts = table(spark, d, "part").select("p_partkey", "p_type")
    lines = table(spark, d, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    pos = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    incoming = lines.select(F.concat(F.lit(" "), F.col("p_type")).alias("name"), pos.alias("pos"), F.col("l_orderkey").alias("hash"), (F.col("l_discount") * 30 - 1).cast("string").alias("weight"))
    existing = table(spark, d, "orders").select(F.lit("PROMO").alias("name"), F.col("o_orderkey").alias("hash"), F.lit(0.5).alias("weight"))
    merged, _ = E.import_vibes(existing, incoming)
    return merged.withColumn("weight", F.round("weight", 6))


@query("SELECT sha256(string_agg(k || ':' || v, '|' ORDER BY k || ':' || v) || 'dark') AS stamp FROM (SELECT event_type AS k, max(event_id) AS v FROM events GROUP BY 1)")
def input_stamp(spark, d):
    """Digest of the newest version of every input."""
    return E.stamp_table(table(spark, d, "events"), "event_type", "event_id", "dark")


@query("SELECT row_number() OVER (ORDER BY stars DESC, artist) AS place, artist, stars FROM (SELECT lower(split_part(p_name, ' ', 1)) AS artist, max(p_size) // 10 AS stars FROM part GROUP BY 1)")
def artist_leaderboard(spark, d):
    """Rated artists by stars, then name (L3); the place by ranges, not in one task."""
    rows = table(spark, d, "part").groupBy(F.lower(F.substring_index("p_name", " ", 1)).alias("artist")).agg(F.floor(F.max("p_size") / 10).alias("stars"))
    placed = group_rank(rows, [], [-F.col("stars"), F.lower("artist")], out="place")
    return placed.select(F.col("place").cast("long").alias("place"), "artist", "stars").orderBy("place")


@query(f"""WITH e AS (SELECT user_id, {STYLE_SQL} AS style, value, ts::DATE = (SELECT max(ts)::DATE FROM events) AS newest FROM events),
u AS (SELECT user_id, bool_or(newest) AS recomputed FROM e GROUP BY 1)
SELECT user_id, style, round(sum(value), 2) AS score, any_value(recomputed) AS recomputed FROM e JOIN u USING (user_id) GROUP BY 1, 2""")
def reused_reads(spark, d):
    """Style scores per user kept from before the last day; that day's users are worked out again, then nothing is."""
    home = f"{scratch_folder(spark)}/reuse-{uuid.uuid4().hex}"
    events = table(spark, d, "events").select("user_id", style_of().alias("style"), "value", F.to_date("ts").alias("day"))
    last = events.agg(F.max("day")).first()[0]

    def reads(rows):
        return rows.groupBy("user_id", "style").agg(F.round(F.sum("value"), 2).alias("score"))

    for days in (F.col("day") < F.lit(last), F.col("day") == F.lit(last), None):
        if days is not None:
            events.where(days).write.mode("append").parquet(f"{home}/source")
        kept = reuse.reused(spark.read.schema(events.schema).parquet(f"{home}/source"), "user_id", reads, f"{home}/store")
    return kept.rows.select("user_id", "style", "score", (F.col("gen") > 0).alias("recomputed"))
