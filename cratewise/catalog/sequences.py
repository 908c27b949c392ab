"""Sequence queries: users of ``events`` as tracks, half-day frames or event values as the series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import sequences as S
from .registry import SERIES_SQL, SLOTS_SQL, query, style_of, table, user_series, user_slots, user_topk, user_winners


@query(f"WITH {SLOTS_SQL} SELECT user_id, frame_idx, rank::INT AS rank, style, score FROM topk WHERE rank <= 6")
def frame_topk(spark, d):
    """Best styles of each frame."""
    return user_topk(spark, d)


@query(f"""WITH {SLOTS_SQL}, f AS (SELECT user_id, style, score, energy, count(*) OVER (PARTITION BY user_id, style) AS wins FROM winners),
v AS (SELECT user_id, style, energy / max(energy) OVER u * (0.4 + 0.6 * score / max(score) OVER u) * (0.4 + 0.6 * wins / max(wins) OVER u) AS vote FROM f WINDOW u AS (PARTITION BY user_id)),
t AS (SELECT user_id, style, sum(vote) AS vote FROM v GROUP BY ALL), s AS (SELECT user_id, style, vote / sum(vote) OVER (PARTITION BY user_id) AS score FROM t)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, style)::INT AS rank, style, round(score, 6) AS score FROM s""")
def salience(spark, d):
    """Energy, confidence and recurrence weighted read of each track."""
    frames = user_winners(spark, d).withColumnRenamed("score", "conf")
    return S.salience(frames, "user_id").withColumn("score", F.round("score", 6))


@query(f"""WITH {SLOTS_SQL} SELECT user_id, style, count(*) AS frames, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 6) AS share FROM winners GROUP BY user_id, style""")
def timeline_share(spark, d):
    """Share of a track's frames per style."""
    return S.timeline_share(user_winners(spark, d), "user_id").withColumn("share", F.round("share", 6))


@query(f"""WITH {SLOTS_SQL}, c AS (SELECT user_id, style, count(*) AS frames, min(frame_idx) AS f FROM winners GROUP BY ALL)
SELECT user_id, style, frames, CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY frames DESC, f) <= 3 THEN style ELSE 'Other' END AS band FROM c""")
def top_n_other(spark, d):
    """The three commonest styles named, the rest Other (A10)."""
    return S.name_top(user_winners(spark, d), "user_id")


GROUPS = {"Deep House": "Warm", "Dark Ambient": "Warm", "Techno": "Fast", "Drum n Bass": "Fast"}
GROUP_SQL = "CASE style WHEN 'Deep House' THEN 'Warm' WHEN 'Dark Ambient' THEN 'Warm' WHEN 'Techno' THEN 'Fast' WHEN 'Drum n Bass' THEN 'Fast' ELSE style END"
POOLED = f"""{SLOTS_SQL}, g AS (SELECT user_id, frame_idx, {GROUP_SQL} AS style, sum(score) AS s, min(rank) AS r FROM topk GROUP BY ALL),
pooled AS (SELECT user_id, frame_idx, style FROM g QUALIFY row_number() OVER (PARTITION BY user_id, frame_idx ORDER BY round(s, 9) DESC, r) = 1)"""


def _groups(spark):
    return spark.createDataFrame(sorted(GROUPS.items()), "style string, `group` string")


@query(f"WITH {POOLED} SELECT user_id, frame_idx, style FROM pooled")
def pooled_winner(spark, d):
    """Winner of each frame after its scores are pooled by group."""
    return S.pooled_winner(user_topk(spark, d), "user_id", _groups(spark))


@query(f"""WITH {SLOTS_SQL}, g AS (SELECT user_id, frame_idx, CASE style WHEN 'Deep House' THEN 'House' WHEN 'Dark Ambient' THEN 'Ambient' ELSE style END AS style, score, rank FROM topk)
SELECT user_id, frame_idx, style FROM g WHERE rank = 1""")
def sibling_winner(spark, d):
    """The same with the built-in sibling clusters."""
    return S.pooled_winner(user_topk(spark, d), "user_id")


def _held(pre: str, frames: str, scores: str) -> str:
    return f"""WITH RECURSIVE {pre}, w AS (SELECT user_id, frame_idx, style, score, row_number() OVER (PARTITION BY user_id, grp, style ORDER BY frame_idx) AS run FROM (
 SELECT *, frame_idx - row_number() OVER (PARTITION BY user_id, style ORDER BY frame_idx) AS grp FROM {frames})),
held AS (SELECT user_id, frame_idx, style FROM w WHERE frame_idx = 0 UNION ALL
 SELECT h.user_id, w.frame_idx, CASE WHEN w.style = h.style THEN h.style WHEN w.run >= 2 AND w.score - coalesce(o.score, 0) >= 0.08 THEN w.style ELSE h.style END
 FROM held h JOIN w ON w.user_id = h.user_id AND w.frame_idx = h.frame_idx + 1 LEFT JOIN {scores} o ON o.user_id = w.user_id AND o.frame_idx = w.frame_idx AND o.style = h.style)
SELECT user_id, frame_idx, style FROM held"""


@query(_held(SLOTS_SQL, "winners", "topk"))
def hysteresis(spark, d):
    """The held style of each frame: a challenger must lead twice running and by the margin."""
    return S.hysteresis(S.frames_as_rows(user_topk(spark, d), "user_id"), "user_id")


@query(_held(POOLED + ", p1 AS (SELECT *, 1.0 AS score FROM pooled)", "p1", "p1"))
def steady_siblings(spark, d):
    """Pooled winners, then the hold rule."""
    return S.steady_siblings(user_topk(spark, d), "user_id", _groups(spark))


MAJORITY = f"""{SLOTS_SQL}, n AS (SELECT a.user_id, a.frame_idx, b.style, count(*) AS c, min(b.frame_idx) AS f FROM winners a JOIN winners b
 ON a.user_id = b.user_id AND b.frame_idx BETWEEN a.frame_idx - 2 AND a.frame_idx + 2 GROUP BY ALL),
voted AS (SELECT user_id, frame_idx, style FROM n QUALIFY row_number() OVER (PARTITION BY user_id, frame_idx ORDER BY c DESC, f) = 1)"""


@query(f"WITH {MAJORITY} SELECT user_id, frame_idx, style FROM voted")
def majority_smooth(spark, d):
    """Commonest style within two frames either side."""
    return S.majority_smooth(user_winners(spark, d), "user_id", 2)


RUNS = """i AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY user_id, style ORDER BY frame_idx) AS grp FROM {src}),
runs0 AS (SELECT user_id, style, min(frame_idx) AS start, count(*) AS length FROM i GROUP BY user_id, style, grp),
runs AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS run FROM runs0)"""
# Every round in full: merge equal neighbours, let short runs take the label before them, repeat.
ABSORB = f"""{SLOTS_SQL}, {RUNS.format(src='winners')},
lg AS (SELECT *, last_value(CASE WHEN length >= 3 THEN style END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY run ROWS UNBOUNDED PRECEDING) AS held,
 max(CASE WHEN run = 1 THEN style END) OVER (PARTITION BY user_id) AS second FROM runs),
round1 AS (SELECT user_id, start, length, CASE WHEN second IS NULL THEN style WHEN held IS NOT NULL THEN held ELSE second END AS style FROM lg),
f1 AS (SELECT user_id, unnest(range(start, start + length)) AS frame_idx, style FROM round1),
i2 AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY user_id, style ORDER BY frame_idx) AS grp FROM f1),
r2 AS (SELECT user_id, style, min(frame_idx) AS start, count(*) AS length FROM i2 GROUP BY user_id, style, grp),
r3 AS (SELECT *, lead(style) OVER (PARTITION BY user_id ORDER BY start) AS nxt FROM r2),
done AS (SELECT user_id, start, length, CASE WHEN start = 0 AND length < 3 AND nxt IS NOT NULL THEN nxt ELSE style END AS style FROM r3),
absorbed AS (SELECT user_id, unnest(range(start, start + length)) AS frame_idx, style FROM done)"""


@query(f"WITH {ABSORB} SELECT user_id, frame_idx, style FROM absorbed")
def absorb_short_runs(spark, d):
    """Runs below three frames merged into their neighbours to the fixed point."""
    return S.spread_runs(S.absorb_short_runs(user_winners(spark, d), "user_id", 3), "user_id")


@query(f"WITH {SLOTS_SQL}, {RUNS.format(src='winners')} SELECT user_id, run, style, start, length FROM runs")
def style_runs(spark, d):
    """Maximal runs of one style."""
    return S.runs(user_winners(spark, d), "user_id")


@query(f"""WITH {SLOTS_SQL}, s AS (SELECT user_id, max(frame_idx) + 1 AS n FROM winners GROUP BY 1), q AS (SELECT user_id, f, greatest(0, least(floor(f * n), n - 1)) AS i FROM s, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) v(f))
SELECT q.user_id, f::DOUBLE AS f, style FROM q JOIN winners w ON w.user_id = q.user_id AND w.frame_idx = q.i""")
def value_at(spark, d):
    """Style at fractional positions of a track."""
    winners = user_winners(spark, d)
    asked = winners.select("user_id").distinct().withColumn("f", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.75, 1.0)])))
    return S.value_at(winners, "user_id", asked)


@query(f"""WITH {SERIES_SQL}, p AS (SELECT s.user_id, frame_idx, n, greatest(1, round_even(n * 0.25, 0)::BIGINT) AS w, sum(value) OVER (PARTITION BY s.user_id ORDER BY frame_idx) AS c, value FROM series s JOIN sizes USING (user_id)),
win AS (SELECT a.user_id, a.frame_idx + 1 - a.w AS start, a.w AS length, round(a.c - coalesce(b.c, 0), 6) AS energy FROM p a LEFT JOIN p b ON a.user_id = b.user_id AND b.frame_idx = a.frame_idx - a.w WHERE a.frame_idx + 1 >= a.w)
SELECT user_id, start, length, round(energy, 4) AS energy FROM win QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY energy DESC, start) = 1""")
def densest_section(spark, d):
    """The contiguous quarter with the most energy."""
    series = user_series(spark, d).withColumnRenamed("value", "energy")
    return S.densest_section(series, "user_id").withColumn("energy", F.round("energy", 4))


@query(f"""WITH {SLOTS_SQL}, p AS (SELECT *, lag(style) OVER (PARTITION BY user_id ORDER BY frame_idx) AS previous FROM winners) SELECT user_id, frame_idx, previous, style FROM p WHERE previous <> style""")
def change_points(spark, d):
    """Frames where the style differs from the one before."""
    return S.change_points(user_winners(spark, d), "user_id")


SPANS = """spans AS (SELECT user_id, value::DOUBLE AS start_s, value + 100.0 AS end_s, event_type AS genre FROM events WHERE value > 150)"""


@query(f"""WITH {SERIES_SQL}, {SPANS}, pos AS (SELECT user_id, frame_idx, frame_idx * 5.0 AS place FROM series)
SELECT p.user_id, frame_idx, (SELECT genre FROM spans s WHERE s.user_id = p.user_id AND place >= start_s AND place < end_s ORDER BY start_s, end_s, genre LIMIT 1) AS label FROM pos p""")
def interval_labels(spark, d):
    """Frames under the first span that covers them."""
    spans = table(spark, d, "events").where("value > 150").select("user_id", F.col("value").alias("start_s"), (F.col("value") + 100.0).alias("end_s"), F.col("event_type").alias("genre"))
    frames = user_series(spark, d).select("user_id", "frame_idx", (F.col("frame_idx") * 5.0).alias("at"))
    return S.interval_labels(frames, "user_id", "at", spans).select("user_id", "frame_idx", "label")


@query(f"""WITH {SPANS}, dur AS (SELECT user_id, max(value) AS duration FROM events GROUP BY 1)
SELECT user_id, start_s, end_s, genre FROM spans JOIN dur USING (user_id) WHERE start_s >= 0 AND end_s > start_s AND (duration = 0 OR end_s <= duration + 0.5)""")
def valid_spans(spark, d):
    """Labelled spans that fit their track."""
    events = table(spark, d, "events")
    spans = events.where("value > 150").select("user_id", F.col("value").alias("start_s"), (F.col("value") + 100.0).alias("end_s"), F.col("event_type").alias("genre"))
    return S.valid_spans(spans, events.groupBy("user_id").agg(F.max("value").alias("duration")), "user_id")


ENVELOPE = f"""{SERIES_SQL}, pk AS (SELECT user_id, max(abs(value)) AS peak FROM series GROUP BY 1),
b AS (SELECT s.user_id, ((frame_idx + 1) * 24 - 1) // n AS bin, min(value) AS lo, max(value) AS hi, sqrt(avg(value * value)) AS rms FROM series s JOIN sizes USING (user_id) GROUP BY ALL),
env AS (SELECT p.user_id, g.bin, round(coalesce(lo, 0) / peak, 3) AS lo, round(coalesce(hi, 0) / peak, 3) AS hi, round(coalesce(rms, 0) / peak, 3) AS rms
 FROM pk p CROSS JOIN (SELECT unnest(range(0, 24)) AS bin) g LEFT JOIN b ON b.user_id = p.user_id AND b.bin = g.bin)"""


@query(f"WITH {ENVELOPE} SELECT user_id, bin, lo, hi, rms FROM env")
def envelope_bins(spark, d):
    """Minimum, maximum and rms in equal bins, scaled to the peak."""
    return S.envelope(user_series(spark, d), "user_id", 24)


@query(f"""WITH {ENVELOPE}, c AS (SELECT unnest(range(0, 10)) AS col) SELECT user_id, col, min(lo) AS lo, max(hi) AS hi, max(rms) AS rms FROM env, c
WHERE bin >= floor(col / 9.0 * 23) AND bin <= ceil(least(1.0, (col + 1) / 9.0) * 23) GROUP BY user_id, col""")
def rebin_columns(spark, d):
    """An envelope pooled to drawing columns."""
    return S.rebin(S.envelope(user_series(spark, d), "user_id", 24), "user_id", 24, 10)


@query(f"""WITH {SERIES_SQL}, g AS (SELECT user_id, n, unnest(range(0, round_even(n * 3 / 4.0, 0)::BIGINT)) AS out_idx FROM sizes),
p AS (SELECT *, out_idx * (4.0 / 3.0)::DOUBLE - 0.4 AS pos FROM g), q AS (SELECT *, greatest(0, least(floor(pos), n - 1)) AS i0, pos - floor(pos) AS frac FROM p)
SELECT q.user_id, out_idx, round((1 - frac) * a.value + frac * b.value, 6) AS value FROM q JOIN series a ON a.user_id = q.user_id AND a.frame_idx = i0 JOIN series b ON b.user_id = q.user_id AND b.frame_idx = least(i0 + 1, n - 1)""")
def resample(spark, d):
    """Linear resampling at three quarters of the rate with a phase."""
    out = S.resample(user_series(spark, d), "user_id", 4, 3, phase=-0.4)
    return out.withColumn("value", F.round("value", 6))


@query(f"""WITH {SERIES_SQL}, p AS (SELECT user_id, n, unnest(range(0, (n - 16) // 5 + 1)) AS patch FROM sizes WHERE n >= 16)
SELECT p.user_id, patch, count(*) AS rows, round(avg(value), 6) AS mean FROM p JOIN series s ON s.user_id = p.user_id AND frame_idx >= patch * 5 AND frame_idx < patch * 5 + 16 GROUP BY ALL""")
def patches(spark, d):
    """Mean over overlapping patches of 16 at hop 5; a trailing part is dropped."""
    out = S.patches(user_series(spark, d), "user_id", 16, 5)
    return out.groupBy("user_id", "patch").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("value"), 6).alias("mean"))


@query("""WITH b AS (SELECT user_id, least(floor(value / 10), 9)::BIGINT AS bin, sum(value) AS w FROM events WHERE value >= 0 AND value <= 100 GROUP BY ALL),
m AS (SELECT user_id, max(w) AS top, sum(w) AS al, arg_max(bin, w) AS bin FROM b GROUP BY 1) SELECT user_id, CASE WHEN top >= al / 10 * 2 THEN (bin + 0.5) * 10 ELSE 0.0 END::DOUBLE AS mode FROM m""")
def histogram_mode(spark, d):
    """Centre of the heaviest weighted bin if it stands out."""
    rows = table(spark, d, "events").select("user_id", "value", F.col("value").alias("weight"))
    return S.histogram_mode(rows, "user_id", 0.0, 100.0, 10)


@query("""WITH x AS (SELECT label, vec_id, list_transform(embedding, lambda q: greatest(q::DOUBLE, 0)) AS v FROM embeddings),
t AS (SELECT label, unnest(list_transform(v, lambda e: CASE WHEN list_max(v) > 0 THEN e / list_max(v) ELSE e END)) AS val, generate_subscripts(v, 1) - 1 AS pos FROM x),
m AS (SELECT label, pos, avg(val) AS m FROM t GROUP BY ALL) SELECT label, pos::INT AS pos, round(CASE WHEN m / max(m) OVER (PARTITION BY label) < 0.93 THEN 0 ELSE m / max(m) OVER (PARTITION BY label) END, 6) AS value FROM m""")
def mean_profile(spark, d):
    """Mean of max-normalised profiles per group, gated."""
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda v: F.greatest(v.cast("double"), F.lit(0.0))).alias("v"))
    return S.mean_profile(rows, "label", "v", gate=0.93).withColumn("value", F.round("value", 6))
