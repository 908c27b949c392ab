"""Key and learning queries over ``embeddings`` and ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import music, vectors as V
from ..operators import keys as K, learn as M, vectors
from .registry import query, table

SPELL = ["C", "Db", "D", "D#", "E", "F", "Gb", "G", "G#", "A", "A#", "B"]
NAMES = ", ".join(f"'{n}'" for n in music.KEY_NAMES)
SPELLED = ", ".join(f"'{n}'" for n in SPELL)
CAMELOT_B = "['8B', '3B', '10B', '5B', '12B', '7B', '2B', '9B', '4B', '11B', '6B', '1B']"
CAMELOT_A = "['5A', '12A', '7A', '2A', '9A', '4A', '11A', '6A', '1A', '8A', '3A', '10A']"


def _pick(names: list[str], index):
    return F.element_at(F.array(*[F.lit(n) for n in names]), index.cast("int") + 1)


@query(f"""SELECT o_orderkey, [{NAMES}][(o_custkey % 12 + 1)::INT] AS key, CASE WHEN o_orderstatus = 'F' THEN {CAMELOT_A}[(o_custkey % 12 + 1)::INT] ELSE {CAMELOT_B}[(o_custkey % 12 + 1)::INT] END AS camelot FROM orders""")
def camelot_codes(spark, d):
    """Wheel code of every key in any spelling."""
    o = table(spark, d, "orders")
    key, scale = _pick(SPELL, F.col("o_custkey") % 12), F.when(F.col("o_orderstatus") == "F", "minor").otherwise("major")
    return o.select("o_orderkey", music.spell(key).alias("key"), music.camelot(key, scale).alias("camelot"))


ERR = f"""q AS (SELECT o_orderpriority, o_custkey % 12 AS r, (o_custkey // 12 + o_orderkey) % 12 AS p, o_orderstatus = 'F' AS rm, o_totalprice > 200000 AS pm FROM orders),
c AS (SELECT o_orderpriority, CASE WHEN p = r AND rm = pm THEN 'exact' WHEN rm = pm AND (p - r + 12) % 12 IN (5, 7) THEN 'fifth' WHEN rm <> pm AND p = r THEN 'parallel'
 WHEN rm <> pm AND ((NOT rm AND (p - r + 12) % 12 = 9) OR (rm AND (p - r + 12) % 12 = 3)) THEN 'relative' ELSE 'other' END AS c FROM q)"""


@query(f"""WITH {ERR} SELECT o_orderpriority, count(*) AS n, count(*) FILTER (c = 'exact') AS exact, count(*) FILTER (c = 'fifth') AS fifth, count(*) FILTER (c = 'relative') AS relative,
 count(*) FILTER (c = 'parallel') AS parallel, count(*) FILTER (c = 'other') AS other, round(avg(CASE c WHEN 'exact' THEN 1.0 WHEN 'fifth' THEN 0.5 WHEN 'relative' THEN 0.3 WHEN 'parallel' THEN 0.2 ELSE 0.0 END), 6) AS mirex FROM c GROUP BY 1""")
def mirex(spark, d):
    """Key error categories and their weighted score."""
    o = table(spark, d, "orders")
    minor = lambda cond: F.when(cond, "minor").otherwise("major")
    rows = o.select(
        "o_orderpriority", _pick(music.KEY_NAMES, F.col("o_custkey") % 12).alias("key"), minor(F.col("o_orderstatus") == "F").alias("scale"),
        _pick(SPELL, (F.floor(F.col("o_custkey") / 12) + F.col("o_orderkey")) % 12).alias("pred_key"), minor(F.col("o_totalprice") > 200000).alias("pred_scale"),
    )
    return K.mirex_report(rows, "o_orderpriority")


def _folded(n: int):
    """All dimensions of a vector folded into ``n``, as octaves fold into pitch classes."""
    def one(i: int):
        return F.aggregate(F.filter("embedding", lambda v, k: k % n == i), F.lit(0.0), lambda s, v: s + v.cast("double"))

    return F.array(*[one(i) for i in range(n)])


def _fold_sql(n: int) -> str:
    return f"list_transform(range({n}), lambda i: list_sum(list_filter(embedding::DOUBLE[], lambda v, k: (k - 1) % {n} = i)))"


def _pcps(spark, d):
    """The whole vector folded into a pitch profile, the key read off the label and the first class's sign."""
    e = table(spark, d, "embeddings").withColumn("pcp", _folded(12))
    return e.select(
        "vec_id", _pick(music.KEY_NAMES, F.col("label")).alias("key"), F.when(F.col("pcp")[0] > 0, "major").otherwise("minor").alias("scale"), "pcp",
    )


FOLDED = f"fd AS (SELECT vec_id, label, {_fold_sql(12)} AS pcp FROM embeddings)"
ROLLED = f"""{FOLDED}, x AS (SELECT vec_id, label, CASE WHEN pcp[1] > 0 THEN 'major' ELSE 'minor' END AS scale, unnest(pcp) AS v, generate_subscripts(pcp, 1) - 1 AS i FROM fd),
r AS (SELECT vec_id, scale, (i - label + 12) % 12 AS pos, v FROM x)"""


@query(f"WITH {ROLLED} SELECT scale, pos::INT AS pos, round(median(v), 6) AS median FROM r GROUP BY ALL")
def key_profile_fit(spark, d):
    """Median of tonic-rotated profiles per mode and position."""
    return K.fit_profiles(_pcps(spark, d), "vec_id", "pcp").withColumn("median", F.round("median", 6))


@query(f"WITH {ROLLED}, o AS (SELECT a.vec_id, a.scale, a.pos, b.v FROM r a JOIN r b ON a.scale = b.scale AND a.pos = b.pos AND a.vec_id <> b.vec_id) SELECT vec_id, scale, pos::INT AS pos, round(median(v), 6) AS median FROM o GROUP BY ALL")
def leave_one_out_profiles(spark, d):
    """Each track's profile fitted without it, from four order statistics per position."""
    return K.leave_one_out_profiles(_pcps(spark, d), "vec_id", "pcp").withColumn("median", F.round("median", 6))


def _profile_sql(name: str) -> str:
    """Correlation of every row with 24 rolled profiles; minor listed first."""
    rows = []
    for mi, mode in enumerate(("minor", "major")):
        for t in range(12):
            p = K.PROFILES[name][mode]
            rows.append(f"({mi * 12 + t}, '{music.KEY_NAMES[t]}', '{mode}', {[p[(i - t) % 12] for i in range(12)]}::DOUBLE[])")
    return f"""{FOLDED}, tpl AS (SELECT * FROM (VALUES {', '.join(rows)}) v(o, key, scale, w)),
e AS (SELECT vec_id, list_transform(pcp, lambda q: CASE WHEN q < 0.05 THEN 0 ELSE q END) AS p FROM fd),
ec AS (SELECT vec_id, list_transform(p, lambda q: q - list_avg(p)) AS c FROM e), tc AS (SELECT o, key, scale, list_transform(w, lambda q: q - list_avg(w)) AS c FROM tpl),
s AS (SELECT vec_id, o, key, scale, coalesce(round(CASE WHEN list_dot_product(ec.c, ec.c) > 0 THEN list_dot_product(ec.c, tc.c) / sqrt(list_dot_product(ec.c, ec.c) * list_dot_product(tc.c, tc.c)) ELSE 0 END, 12), 0) AS r FROM ec, tc)"""


@query(f"WITH {_profile_sql('temperley')} SELECT vec_id, key, scale, round(r, 6) AS strength FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY r DESC, o) = 1")
def profile_match(spark, d):
    """Best key by correlation with a published profile, gated input."""
    gated = _pcps(spark, d).select("vec_id", V.gate(F.col("pcp"), 0.05).alias("g"))
    rows = gated.select("vec_id", K.match_profile("g", K.PROFILES["temperley"]).alias("k"))
    return rows.select("vec_id", "k.key", "k.scale", F.round("k.strength", 6).alias("strength"))


@query(f"""WITH {_profile_sql('kk')}, z AS (SELECT vec_id, max(abs(q)) AS any_value FROM (SELECT vec_id, unnest(p) AS q FROM e) GROUP BY 1),
b AS (SELECT vec_id, key, scale, o, 3 * r + CASE scale WHEN 'major' THEN 0.25 ELSE 0 END AS l FROM s),
f AS (SELECT vec_id, arg_max(key, l) AS key, arg_max(scale, l) AS scale, max(l) AS m FROM b GROUP BY 1),
g AS (SELECT b.vec_id, f.key, f.scale, 1 / sum(exp(l - m)) AS p FROM b JOIN f USING (vec_id) GROUP BY ALL)
SELECT vec_id, CASE WHEN any_value = 0 THEN 'C' ELSE key END AS key, CASE WHEN any_value = 0 THEN 'minor' ELSE scale END AS scale, round(CASE WHEN any_value = 0 THEN 0 ELSE p END, 6) AS strength FROM g JOIN z USING (vec_id)""")
def key_score(spark, d):
    """24-key scores from templates and biases: standardise, roll, dot, pool, softmax."""
    import numpy as np

    w = 3 * K.standardise(np.array([K.PROFILES["kk"]["major"], K.PROFILES["kk"]["minor"]]))
    rows = _pcps(spark, d).select("vec_id", V.gate(F.col("pcp"), 0.05).alias("g"))
    out = rows.select("vec_id", K.score_keys("g", w[:, None, :].tolist(), [[0.25], [0.0]]).alias("k"))
    return out.select("vec_id", "k.key", "k.scale", F.round("k.strength", 6).alias("strength"))


# --- learning --------------------------------------------------------------------------

PRED = """x AS (SELECT label, unnest(embedding::DOUBLE[]) AS val, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(val) AS val FROM x GROUP BY ALL),
c AS (SELECT label, list(val ORDER BY pos) AS v FROM m GROUP BY label),
p AS (SELECT vec_id, e.label, arg_max(c.label, round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 4) - c.label * 1e-9) AS prediction FROM embeddings e, c GROUP BY ALL)"""


def _predictions(spark, d):
    """Nearest label centre as the prediction."""
    e = table(spark, d, "embeddings")
    best = vectors.match_centroids(e, "vec_id", "embedding", vectors.weighted_centroids(e, ["label"], "embedding"), "label").where("rank = 1")
    return e.select("vec_id", "label").join(best.select("vec_id", F.col("label").alias("prediction")), "vec_id")


REPORT = f"""{PRED}, t AS (SELECT label AS class, count(*) AS support, count(*) FILTER (label = prediction) AS hits FROM p GROUP BY 1), cl AS (SELECT prediction AS class, count(*) AS called FROM p GROUP BY 1),
r AS (SELECT class, support, hits, coalesce(hits / called, 0) AS pr, hits / support AS re FROM t LEFT JOIN cl USING (class)),
rep AS (SELECT class, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1, support, hits FROM r)"""


@query(f"WITH {REPORT} SELECT * FROM rep")
def eval_report(spark, d):
    """Precision, recall and F1 per class."""
    out = M.class_report(_predictions(spark, d))
    return out.select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support", "hits")


@query(f"WITH {REPORT} SELECT round(avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END), 6) AS macro_f1, round(sum(hits) / sum(support), 6) AS accuracy, sum(support)::BIGINT AS n, round(max(support) / sum(support), 6) AS largest_share FROM r")
def eval_overall(spark, d):
    """Macro-F1, accuracy and largest class share."""
    return M.overall_report(M.class_report(_predictions(spark, d)))


@query(f"WITH {PRED} SELECT label, {', '.join(f'count(*) FILTER (prediction = {i}) AS c{i}' for i in range(10))} FROM p GROUP BY 1")
def confusion_matrix(spark, d):
    """Rows truth, columns prediction."""
    out = M.confusion(_predictions(spark, d), list(range(10)))
    return out.select("label", *[F.col(str(i)).alias(f"c{i}") for i in range(10)])


@query("SELECT label, count(*) AS n, CASE WHEN count(*) > 1 THEN greatest(1, round_even(count(*) * 0.2, 0)) ELSE 0 END::BIGINT AS held FROM embeddings GROUP BY 1")
def stratified_split(spark, d):
    """Validation rows per class (M5)."""
    out = M.stratified_split(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("validation").alias("held"))


@query("WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT label, f::INT AS fold, (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END)::BIGINT AS n FROM n, range(5) t(f)")
def cv_folds(spark, d):
    """Rows per class and fold (M7)."""
    return M.assign_folds(table(spark, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT label, round((SELECT count(*) FROM embeddings) / ((SELECT count(DISTINCT label) FROM embeddings) * count(*)), 6) AS weight FROM embeddings GROUP BY 1")
def class_weights(spark, d):
    """Balanced class weights (M7)."""
    return M.class_weights(table(spark, d, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query("""WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1)
SELECT label, f::INT AS fold, (n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END)::BIGINT AS scored, true AS known FROM n, range(5) t(f)""")
def cross_validation(spark, d):
    """How many rows of each class every fold of a class-balanced logistic head scored, unseen (M7)."""
    out = M.cross_validate(table(spark, d, "embeddings"), "vec_id", "embedding", "label")
    return out.groupBy("label", "fold").agg(F.count("prediction").alias("scored"), F.bool_and(F.col("prediction").cast("int").between(0, 9)).alias("known"))


@query("SELECT label, greatest(1, round_even(count(*) * 0.2, 0))::BIGINT AS scored, true AS known FROM embeddings GROUP BY 1 HAVING count(*) > 1")
def head_training(spark, d):
    """How many held-out rows of each class a trained one-layer head scored (M6)."""
    out = M.train_head(table(spark, d, "embeddings"), "vec_id", "embedding", "label")[2]
    return out.groupBy("label").agg(F.count("prediction").alias("scored"), F.bool_and(F.col("prediction").cast("int").between(0, 9)).alias("known"))


@query(f"""WITH {FOLDED}, k AS (SELECT CASE WHEN pcp[1] > 0 THEN 'major' ELSE 'minor' END AS scale, label FROM fd)
SELECT scale, count(*) AS n, true AS named, true AS learnt FROM k GROUP BY 1""")
def key_template_training(spark, d):
    """Vectors as noise over the profile of their key: nine of ten are named right by templates trained without their fold."""
    mode = F.when(F.col("scale") == "minor", F.array(*map(F.lit, K.PROFILES["kk"]["minor"]))).otherwise(F.array(*map(F.lit, K.PROFILES["kk"]["major"])))
    heard = F.zip_with("pcp", V.roll(mode, music.tonic(F.col("key"))), lambda noise, tone: noise + tone / 2)
    rows = M.assign_folds(_pcps(spark, d).withColumn("pcp", heard), "vec_id", "scale", 5)
    out = K.cross_validate_templates(rows, "pcp", "fold", 5)
    named = F.col("pred_key").isin(*music.KEY_NAMES) & F.col("pred_scale").isin("minor", "major")
    right = (F.col("pred_key") == F.col("key")) & (F.col("pred_scale") == F.col("scale"))
    return out.groupBy("scale").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(named).alias("named"), (F.avg(right.cast("int")) >= 0.9).alias("learnt")
    )


DIM, CLASSES = 64, 10


def _head() -> M.Head:
    """A fixed linear head: two opposite rectified units per class that read every tenth dimension."""
    w1 = [[(1.0 if j // 2 == i % CLASSES else 0.0) * (1 if j % 2 == 0 else -1) for j in range(2 * CLASSES)] for i in range(DIM)]
    w2 = [[(4.0 if j // 2 == c else 0.0) * (1 if j % 2 == 0 else -1) for c in range(CLASSES)] for j in range(2 * CLASSES)]
    return M.Head([0.0] * DIM, [0.5] * DIM, w1, [0.0] * (2 * CLASSES), w2, [0.0] * CLASSES, [f"s{c}" for c in range(CLASSES)])


HEADED = f"""fh AS (SELECT vec_id, label, {_fold_sql(10)} AS e FROM embeddings), x AS (SELECT vec_id, label, unnest(e) * 8 AS l, generate_subscripts(e, 1) - 1 AS c FROM fh),
pr AS (SELECT vec_id, label, c, exp(l) / sum(exp(l)) OVER (PARTITION BY vec_id) AS p FROM x)"""


@query(f"WITH {HEADED}, m AS (SELECT label, c, avg(p) AS p FROM pr GROUP BY ALL) SELECT label, row_number() OVER (PARTITION BY label ORDER BY p DESC, c)::INT AS rank, 's' || c AS style, round(p, 4) AS score FROM m")
def head_predict(spark, d):
    """Mean class probabilities over a track's frames (M1)."""
    return M.predict_tracks(table(spark, d, "embeddings"), "label", "embedding", _head())


RELABEL = f"""{HEADED}, rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, c) AS n FROM pr), kept AS (SELECT vec_id, label, n, 's' || c AS style, p / sum(p) OVER (PARTITION BY vec_id) AS s FROM rk WHERE n <= 8 AND label <> 3)"""


def _relabels(spark, d):
    tracks = table(spark, d, "embeddings").withColumn("override", F.when(F.col("label") == 3, "House"))
    return M.relabel(tracks, "vec_id", "embedding", _head(), "head:1", 1.0)


@query(f"WITH {RELABEL} SELECT vec_id, (n - 1)::INT AS pos, style, round_even(s, 4) AS score FROM kept")
def head_relabel(spark, d):
    """Re-label reads of tracks without an override (M2)."""
    return _relabels(spark, d).select("vec_id", F.posexplode("styles").alias("pos", "e")).select("vec_id", "pos", "e.style", "e.score")


@query(f"WITH {RELABEL} SELECT (SELECT count(*) FROM embeddings) AS total, count(*) FILTER (n = 1 AND style <> 's' || label) AS changed, (SELECT count(*) FROM embeddings) - count(*) FILTER (n = 1 AND style <> 's' || label) AS unchanged FROM kept")
def relabel_preview(spark, d):
    """What a re-label would change, written nowhere (M3)."""
    now = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("style"))
    return M.relabel_preview(now, _relabels(spark, d), "vec_id")[0]


@query("SELECT vec_id FROM embeddings WHERE label NOT IN (3, 4)")
def standing_relabels(spark, d):
    """Re-labels left after some were reverted (M4)."""
    events = _relabels(spark, d).select("vec_id", "head", "at")
    gone = M.revert_relabels(table(spark, d, "embeddings").where("label = 4"), "vec_id", 2.0)
    return M.standing_relabels(events.unionByName(gone), "vec_id").select("vec_id")


@query("SELECT vec_id, candidate FROM embeddings, (VALUES ('a'), ('b')) c(candidate) WHERE NOT (candidate = 'a' AND label < 5)")
def missing_extractions(spark, d):
    """(track, candidate) pairs with nothing cached (M8)."""
    e = table(spark, d, "embeddings")
    cache = e.where("label < 5").select("vec_id", F.lit("a").alias("candidate"))
    return M.missing_extractions(e.select("vec_id"), cache, ["a", "b"], "vec_id")


@query("SELECT vec_id, candidate, CASE WHEN candidate = 'b' AND label = 9 THEN NULL ELSE round(list_sum(embedding::DOUBLE[]), 6) END AS total, candidate = 'b' AND label = 9 AS failed FROM embeddings, (VALUES ('a'), ('b')) c(candidate)")
def extraction_failures(spark, d):
    """User extractors per candidate; a failing input becomes a row."""

    def strict(v):
        if v[-1] > 8.5:
            raise ValueError("unreadable")
        return v[:-1]

    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.transform("embedding", lambda x: x.cast("double")), F.array(F.col("label").cast("double"))).alias("v"))
    todo = e.withColumn("candidate", F.explode(F.array(F.lit("a"), F.lit("b"))))
    out = M.extract(todo, "vec_id", "v", {"a": lambda v: v[:-1], "b": strict})
    return out.select("vec_id", "candidate", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.col("error").isNotNull().alias("failed"))
