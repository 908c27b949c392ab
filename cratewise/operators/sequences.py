"""Ordered sequences of frames and samples.

A sequence may be one track or a third of the library, so nothing here sorts or
collects a whole sequence. Frames have a dense index per key; work is keyed by
(key, chunk of the index) or pre-aggregated, and only chunk summaries meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .. import dims
from ..plans import dyadic, scan
from ..plans.ranks import group_rank

# Salience floor and slope, frame and read lengths, lens and wave settings.
SALIENCE_FLOOR, SALIENCE_SLOPE = 0.4, 0.6
READ_LENGTH = 8
FRAME_LENGTH = 6
HOLD, MARGIN = 2, 0.08
NAMED_STYLES = 3
GATE = 0.2
PROMINENCE = 2.0


def with_frame_index(df: DataFrame, key: str | list[str], order: list[Column], out: str = "frame_idx") -> DataFrame:
    """Dense 0-based index of each row in its key's order."""
    return group_rank(df, [key] if isinstance(key, str) else key, order, out="_r").withColumn(out, F.col("_r") - 1).drop("_r")


def frame_topk(scores: DataFrame, key: str, k: int = FRAME_LENGTH) -> DataFrame:
    """(key, frame_idx, rank, style, score): best k styles per frame, scores to 3 places."""
    order = Window.partitionBy(key, "frame_idx").orderBy(F.desc("score"), "style")
    ranked = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(key, "frame_idx", "rank", "style", F.round("score", 3).alias("score"))


def frames_as_rows(topk: DataFrame, key: str) -> DataFrame:
    """One row per frame with its ranked ``top`` array."""
    packed = topk.groupBy(key, "frame_idx").agg(F.sort_array(F.collect_list(F.struct("rank", "style", "score"))).alias("t"))
    return packed.select(key, "frame_idx", F.transform("t", lambda e: F.struct(e["style"].alias("style"), e["score"].alias("score"))).alias("top"))


def salience(frames: DataFrame, key: str, k: int = READ_LENGTH) -> DataFrame:
    """(key, rank, style, score) from frames (key, style, conf, energy) of frame winners.

    Every frame votes for its winner with energy x confidence x recurrence, each
    relative to the track's maximum. Track maxima come from aggregates, not windows.
    """
    per_style = frames.groupBy(key, "style").agg(
        F.count(F.lit(1)).alias("wins"), F.max("conf").alias("c"), F.max("energy").alias("e")
    )
    per_track = per_style.groupBy(key).agg(F.max("wins").alias("mw"), F.max("c").alias("mc"), F.max("e").alias("me"))
    share = lambda x, top: F.when(F.col(top) > 0, x / F.col(top)).otherwise(x)
    bend = lambda x: SALIENCE_FLOOR + SALIENCE_SLOPE * x
    lookup = per_style.select(key, "style", "wins").join(per_track, key)
    votes = frames.join(lookup, [key, "style"]).withColumn(
        "vote", share(F.col("energy"), "me") * bend(share(F.col("conf"), "mc")) * bend(F.col("wins") / F.col("mw"))
    )
    tally = votes.groupBy(key, "style").agg(F.sum("vote").alias("vote"))
    total = F.sum("vote").over(Window.partitionBy(key))  # one row per style
    order = Window.partitionBy(key).orderBy(F.desc("vote"), "style")
    return (
        tally.withColumn("score", F.when(total > 0, F.col("vote") / total).otherwise(F.col("vote")))
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, "rank", "style", "score")
    )


def timeline_share(segments: DataFrame, key: str) -> DataFrame:
    """Fraction of a track's frames each style holds."""
    counts = segments.groupBy(key, "style").agg(F.count(F.lit(1)).alias("frames"))
    return counts.withColumn("share", F.col("frames") / F.sum("frames").over(Window.partitionBy(key)))


def name_top(segments: DataFrame, key: str, n: int | None = NAMED_STYLES) -> DataFrame:
    """(key, style, frames, band): the n most frequent styles named, the rest "Other" (A10).

    Ties go to the style that appears first. ``n=None`` names every style.
    """
    counts = segments.groupBy(key, "style").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_idx").alias("first"))
    order = Window.partitionBy(key).orderBy(F.desc("frames"), "first")
    band = F.col("style") if n is None else F.when(F.row_number().over(order) <= n, F.col("style")).otherwise("Other")
    return counts.withColumn("band", band).drop("first")


def pooled_winner(topk: DataFrame, key: str, groups: DataFrame | None = None) -> DataFrame:
    """(key, frame_idx, style): a frame's scores summed by group, the largest sum wins.

    ``groups`` is (style, group); without it the built-in sibling clusters apply.
    A style in no group stands for itself; ties go to the group met first.
    """
    if groups is None:
        table = dims.map_column(dims.sibling_table())
        grouped = topk.withColumn("g", F.coalesce(F.try_element_at(table, F.lower("style")), "style"))
    else:
        grouped = topk.join(groups.select("style", F.col("group").alias("_g")), "style", "left").withColumn("g", F.coalesce("_g", "style"))
    sums = grouped.groupBy(key, "frame_idx", "g").agg(F.round(F.sum("score"), 9).alias("s"), F.min("rank").alias("r"))
    return sums.groupBy(key, "frame_idx").agg(F.max_by("g", F.struct("s", -F.col("r"))).alias("style"))


# --- hysteresis ------------------------------------------------------------------

def hysteresis_step(state: tuple, top: list, margin: float = MARGIN, hold: int = HOLD) -> tuple:
    """One frame of the hold-until-beaten rule; state is (held, challenger, count)."""
    held, rival, count = state
    name, score = top[0]
    if held is None:
        return (name, None, 0)
    if name == held:
        return (held, None, 0)
    count = count + 1 if name == rival else 1
    own = next((s for n, s in top if n == held), 0.0)
    if count >= hold and not score - own < margin:  # a NaN lead is the largest, as in Spark's order
        return (name, None, 0)
    return (held, name, count)


_OUTSIDE = "\0outside"  # stands for any held style a chunk never mentions


def _summarise(rows: list, margin: float, hold: int) -> dict:
    """What a chunk does to the held style, for every style it could start with.

    While a style is held, the challenger's count is the length of the run of frames
    it has won, so only the run that crosses the chunk's start needs outside
    knowledge: one map is kept per count (0..hold) that the leading winner may bring.
    """
    winners = [top[0][0] for top in rows]
    lead = 1
    while lead < len(rows) and winners[lead] == winners[0]:
        lead += 1
    tail = 1
    while tail < len(rows) and winners[-1 - tail] == winners[-1]:
        tail += 1
    labels = {n for top in rows for n, _ in top}
    maps = []
    for brought in range(hold + 1):
        where = {name: [name] for name in labels}
        where[_OUTSIDE] = [_OUTSIDE]
        run = brought
        for i, top in enumerate(rows):
            run = run + 1 if i == 0 or winners[i] == winners[i - 1] else 1
            name, score = top[0]
            if run < hold:
                continue
            scores = dict(reversed(top))
            for held in [h for h in where if h != name and not score - scores.get(h, 0.0) < margin]:
                where.setdefault(name, []).extend(where.pop(held))
        maps.append({start: end for end, starts in where.items() for start in starts})
    return {"first": winners[0], "lead": lead, "last": winners[-1], "tail": tail, "maps": maps, "rows": len(rows)}


def _tops(batch: pa.RecordBatch) -> list:
    """The ranked (style, score) lists of a batch, from its flat Arrow buffers."""
    column = batch.column("top")
    ends = column.offsets.to_pylist()
    flat = column.values
    pairs = list(zip(flat.field("style").to_pylist(), flat.field("score").to_pylist()))
    return [pairs[a:b] for a, b in zip(ends, ends[1:])]


def _groups(batches: Iterator[pa.RecordBatch], by: list[str], values) -> Iterator[tuple]:
    """(group, rows) of batches already sorted by ``by``; one group is held at a time."""
    group, held = None, []
    for batch in batches:
        keys = zip(*[batch.column(c).to_pylist() for c in by])
        for k, row in zip(keys, values(batch)):
            if k != group:
                if held:
                    yield group, held
                group, held = k, []
            held.append(row)
    if held:
        yield group, held


def _sorted(df: DataFrame, by: list[str], order: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, order)


def hysteresis(frames: DataFrame, key: str, margin: float = MARGIN, hold: int = HOLD, chunk: int | None = None) -> DataFrame:
    """(key, frame_idx, style) after the hold-until-beaten rule over ``frames_as_rows``.

    Tracks no longer than a chunk are one fold each. For longer ones the chunks are
    summarised in parallel, the summaries of a track are chained, and every chunk is
    replayed from its true starting state: a prefix scan over functions.
    """
    chunk = chunk or scan.chunk_for(frames, "frame_idx")
    kind = frames.schema[key].dataType
    out_type = f"{key} {kind.simpleString()}, frame_idx long, style string"
    names = [key, "frame_idx", "style"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, state = None, None
        for batch in batches:
            keys, idx, out = batch.column(key).to_pylist(), batch.column("frame_idx"), []
            starts = batch.column("start").to_pylist() if "start" in batch.schema.names else None
            marks = keys if starts is None else list(zip(keys, batch.column("chunk").to_pylist()))
            for i, (mark, top) in enumerate(zip(marks, _tops(batch))):
                if mark != track:
                    begin = None if starts is None else starts[i]
                    track, state = mark, (None, None, 0) if begin is None else (begin["held"], begin["rival"], begin["run"])
                state = hysteresis_step(state, top, margin, hold)
                out.append(state[0])
            yield pa.RecordBatch.from_arrays([batch.column(key), idx.cast(pa.int64()), pa.array(out, pa.string())], names)

    rows = frames.select(key, "frame_idx", "top")
    if chunk is None:
        return _sorted(rows, [key], "frame_idx").mapInArrow(replay, out_type)

    chunked = rows.withColumn("chunk", F.floor(F.col("frame_idx") / chunk))
    long = rows.where(F.col("frame_idx") >= chunk).select(key).distinct()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (track, at), tops in _groups(batches, [key, "chunk"], _tops):
            s = _summarise(tops, margin, hold)
            maps = [[{"from": k, "to": v} for k, v in m.items()] for m in s["maps"]]
            yield pa.RecordBatch.from_pylist(
                [{key: track, "chunk": at, **{c: s[c] for c in ("first", "lead", "last", "tail", "rows")}, "maps": maps}], summary_type
            )

    pair = pa.struct([("from", pa.string()), ("to", pa.string())])
    arrow_key = to_arrow_type(kind)
    summary_type = pa.schema([
        (key, arrow_key), ("chunk", pa.int64()), ("first", pa.string()), ("lead", pa.int64()), ("last", pa.string()),
        ("tail", pa.int64()), ("rows", pa.int64()), ("maps", pa.list_(pa.list_(pair))),
    ])
    start_type = pa.schema([(key, arrow_key), ("chunk", pa.int64()), ("start", pa.struct([("held", pa.string()), ("rival", pa.string()), ("run", pa.int64())]))])
    summary = _sorted(chunked.join(long, key, "left_semi"), [key, "chunk"], "frame_idx").mapInArrow(
        summarise,
        f"{key} {kind.simpleString()}, chunk long, first string, lead long, last string, tail long, rows long, "
        "maps array<array<struct<`from`:string,`to`:string>>>",
    )

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        track, held, rival, run = None, None, None, 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[key] != track:
                    track, held, rival, run = row[key], None, None, 0
                begin = None if held is None else {"held": held, "rival": None if held == rival else rival, "run": 0 if held == rival else run}
                out.append({key: track, "chunk": row["chunk"], "start": begin})
                table = {e["from"]: e["to"] for e in row["maps"][min(hold, run) if row["first"] == rival else 0]}
                start = row["first"] if held is None else held
                end = table.get(start, table[_OUTSIDE])
                held = start if end == _OUTSIDE else end
                run = row["tail"] + (run if row["tail"] == row["rows"] and row["last"] == rival else 0)
                rival = row["last"]
            yield pa.RecordBatch.from_pylist(out, start_type)

    starts = _sorted(summary, [key], "chunk").mapInArrow(
        chain, f"{key} {kind.simpleString()}, chunk long, start struct<held:string,rival:string,run:long>"
    )
    return _sorted(chunked.join(starts, [key, "chunk"], "left"), [key, "chunk"], "frame_idx").mapInArrow(replay, out_type)


def steady_siblings(topk: DataFrame, key: str, groups: DataFrame | None = None, **options) -> DataFrame:
    """Sibling pooling, then hysteresis over the pooled winners."""
    pooled = pooled_winner(topk, key, groups)
    frames = pooled.select(key, "frame_idx", F.array(F.struct(F.col("style"), F.lit(1.0).alias("score"))).alias("top"))
    return hysteresis(frames, key, **options)


# --- smoothing -------------------------------------------------------------------

def majority_smooth(segments: DataFrame, key: str, win: int) -> DataFrame:
    """(key, frame_idx, style): the commonest style within +/- win frames.

    Ties go to the style met first in the window. Every frame of a style marks where
    it enters the moving window and where it leaves. Between two marks of a style its
    count and its first frame in the window stand still, so a style is a list of
    intervals and a frame takes the best interval over it: rows do not grow with win.
    """
    chunk = scan.chunk_for(segments, "frame_idx")
    series = [key, "style"]
    votes = segments.groupBy(*series, "frame_idx").agg(F.count(F.lit(1)).alias("_c"))
    mark = lambda place, change, gone: F.struct(place.alias("at"), change.alias("change"), gone.alias("gone"))
    both = F.array(
        mark(F.col("frame_idx") - win, F.col("_c"), F.lit(0).cast("long")),
        mark(F.col("frame_idx") + win + 1, -F.col("_c"), F.lit(1).cast("long")),
    )
    marks = votes.select(*series, F.explode(both).alias("_m")).groupBy(*series, F.col("_m.at").alias("_at")).agg(
        F.sum("_m.change").alias("_change"), F.sum("_m.gone").alias("_gone")
    )
    placed = with_frame_index(marks, series, [F.col("_at")], "_i")
    counted = scan.running_sum(placed, series, "_i", F.col("_change"), "_count", chunk)
    passed = scan.running_sum(counted, series, "_i", F.col("_gone"), "_nth", chunk)
    spans = scan.neighbour(passed, series, "_i", F.col("_at"), "_next", 1, chunk).where(F.col("_count") > 0)
    # The first frame in the window is the one after all that have left it.
    firsts = with_frame_index(votes, series, [F.col("frame_idx")], "_nth").select(
        F.col(key).alias("_k"), F.col("style").alias("_s"), "_nth", F.col("frame_idx").alias("_first")
    )
    met = (F.col(key) == F.col("_k")) & F.col("style").eqNullSafe(F.col("_s")) & (spans["_nth"] == firsts["_nth"])
    size = segments.groupBy(key).agg(F.max("frame_idx").alias("_last"))
    inside = spans.join(firsts, met).select(key, "style", "_at", "_next", "_count", "_first").join(size, key).select(
        key, F.greatest(F.col("_at"), F.lit(0)).alias("_lo"), F.least(F.col("_next"), F.col("_last") + 1).alias("_hi"),
        F.struct((-F.col("_count")).alias("c"), F.col("_first").alias("first"), "style").alias("_vote"),
    )
    best = dyadic.best_at(inside, [key], "_lo", "_hi", F.col("_vote"), "_vote", "frame_idx")
    return best.select(key, "frame_idx", F.col("_vote.style").alias("style"))


def runs(segments: DataFrame, key: str, chunk: int | None = None) -> DataFrame:
    """(key, run, style, start, length) of maximal runs of one style."""
    return _runs(segments, key, chunk or scan.chunk_for(segments, "frame_idx"))


def _runs(segments: DataFrame, key: str, chunk: int | None) -> DataFrame:
    prev = scan.neighbour(segments, [key], "frame_idx", F.col("style"), "_prev", chunk=chunk)
    starts = prev.withColumn("_new", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("style")), 1).otherwise(0))
    numbered = scan.running_sum(starts, [key], "frame_idx", F.col("_new"), "run", chunk)
    return numbered.groupBy(key, "run").agg(
        F.first("style").alias("style"), F.min("frame_idx").alias("start"), F.count(F.lit(1)).alias("length")
    ).withColumn("run", F.col("run") - 1)


def absorb_short_runs(segments: DataFrame, key: str, min_run: int, chunk: int | None = None) -> DataFrame:
    """(key, start, length, style): runs shorter than ``min_run`` merged away to the fixed point.

    The fixed point has a closed form. A short run takes the last long run before
    it. Short runs before the first long run first take the second run's style; if
    together they are still short and differ from it, they take the first long
    run's style. With no long run everything takes the second run's style.
    """
    chunk = chunk or scan.chunk_for(segments, "frame_idx")
    spans = _runs(segments, key, chunk)
    long_style = F.when(F.col("length") >= min_run, F.col("style"))
    known = scan.last_known(spans, [key], "run", long_style, "_held", chunk)
    heads = spans.groupBy(key).agg(
        F.max(F.when(F.col("run") == 1, F.col("style"))).alias("_second"),
        F.min(F.when(F.col("length") >= min_run, F.col("run"))).alias("_first_long"),
        F.min_by("style", F.when(F.col("length") >= min_run, F.col("run"))).alias("_long_style"),
        F.min(F.when(F.col("length") >= min_run, F.col("start"))).alias("_prefix"),
    )
    early = (
        F.when(F.col("_second").isNull(), F.col("style"))
        .when(F.col("_first_long").isNull() | (F.col("_prefix") >= min_run), F.col("_second"))
        .otherwise(F.col("_long_style"))
    )
    return known.join(heads, key).select(key, "start", "length", F.coalesce("_held", early).alias("style"))


def spread_runs(spans: DataFrame, key: str, chunk: int = scan.CHUNK) -> DataFrame:
    """Runs back to frames; long runs are cut first so no row explodes without bound."""
    pieces = spans.withColumn("_at", F.explode(F.expr(f"sequence(0, (length - 1) div {chunk})")))
    return pieces.withColumn(
        "frame_idx", F.explode(F.expr(f"sequence(start + _at * {chunk}, start + least(length, (_at + 1) * {chunk}) - 1)"))
    ).select(key, "frame_idx", "style")


def smooth(segments: DataFrame, key: str, seconds: float, hop: float = 2.0) -> DataFrame:
    """Both smoothing passes at a strength in seconds."""
    win = max(1, int(seconds / hop + 0.5))
    voted = majority_smooth(segments, key, win)
    return spread_runs(absorb_short_runs(voted, key, win), key)


def value_at(segments: DataFrame, key: str, positions: DataFrame) -> DataFrame:
    """(key, f, style): the frame at fractional position ``f`` of each track."""
    size = segments.groupBy(key).agg((F.max("frame_idx") + 1).alias("n"))
    wanted = positions.join(size, key).withColumn(
        "frame_idx", F.greatest(F.lit(0), F.least(F.floor(F.col("f") * F.col("n")), F.col("n") - 1))
    )
    return wanted.join(segments.select(key, "frame_idx", "style"), [key, "frame_idx"]).select(key, "f", "style")


def densest_section(series: DataFrame, key: str, frac: float = 0.25, which: str = "loud") -> DataFrame:
    """(key, start, length, energy) of the contiguous fraction with most or least energy."""
    summed = scan.running_sum(series, [key], "frame_idx", F.col("energy"), "csum", scan.chunk_for(series, "frame_idx"))
    size = series.groupBy(key).agg((F.max("frame_idx") + 1).alias("n")).withColumn(
        "w", F.greatest(F.lit(1), F.bround(F.col("n") * frac).cast("long"))
    )
    ends = summed.join(size, key).select(key, (F.col("frame_idx") + 1).alias("end"), "csum", "w")
    base = summed.select(key, (F.col("frame_idx") + 1).alias("start"), F.col("csum").alias("before"))
    zero = series.select(key).distinct().select(key, F.lit(0).cast("long").alias("start"), F.lit(0.0).alias("before"))
    windows = ends.where(F.col("end") >= F.col("w")).withColumn("start", F.col("end") - F.col("w")).join(
        base.unionByName(zero), [key, "start"]
    ).withColumn("energy", F.round(F.col("csum") - F.col("before"), 9))
    score = F.col("energy") if which == "loud" else -F.col("energy")
    return windows.groupBy(key).agg(F.max_by(F.struct("start", "w", "energy"), F.struct(score, -F.col("start"))).alias("b")).select(
        key, F.col("b.start").alias("start"), F.col("b.w").alias("length"), F.col("b.energy").alias("energy")
    )


def change_points(segments: DataFrame, key: str) -> DataFrame:
    """Frames whose style differs from the frame before."""
    prev = scan.neighbour(segments, [key], "frame_idx", F.col("style"), "previous", chunk=scan.chunk_for(segments, "frame_idx"))
    return prev.where(F.col("previous").isNotNull() & (F.col("previous") != F.col("style"))).select(key, "frame_idx", "previous", "style")


def interval_labels(frames: DataFrame, key: str, position: str, spans: DataFrame) -> DataFrame:
    """Frames with the label of the first span covering them, ``[start, end)``.

    Of the spans over a frame the one with the least start, then end, then genre counts.
    Spans are turned into ranges of a track's distinct positions by two ranks, and the
    best range over each position comes from aligned nodes: a span of a whole week
    costs a few rows, and no bucket width has to suit long and short spans alike.
    A null position, or a span with a null or empty extent, meets nothing.
    """
    place = F.col(position).cast("double")
    real = spans.select(key, F.col("start_s").cast("double"), F.col("end_s").cast("double"), "genre").where(F.col("start_s") < F.col("end_s"))
    places = frames.select(key, place.alias("_p")).where(F.col("_p").isNotNull()).distinct()
    ends = real.select(key, F.explode(F.array("start_s", "end_s")).alias("_p")).distinct()
    # An end sorts before a frame at the same position: what is before it is what it leaves out.
    line = places.withColumn("_frame", F.lit(1)).unionByName(ends.withColumn("_frame", F.lit(0)))
    ranked = group_rank(group_rank(line, [key], [F.col("_p"), F.col("_frame")], out="_r"), [key, "_frame"], [F.col("_p")], out="_w")
    cuts = ranked.where("_frame = 0").select(key, "_p", (F.col("_r") - F.col("_w")).alias("_i"))
    cut = lambda end, out: cuts.select(key, F.col("_p").alias(end), F.col("_i").alias(out))
    ranges = real.join(cut("start_s", "_lo"), [key, "start_s"]).join(cut("end_s", "_hi"), [key, "end_s"])
    best = dyadic.best_at(ranges, [key], "_lo", "_hi", F.struct("start_s", "end_s", "genre"), "_best", "_i")
    index = ranked.where("_frame = 1").select(key, "_p", (F.col("_w") - 1).alias("_i"))
    labels = index.join(best, [key, "_i"]).select(key, "_p", F.col("_best.genre").alias("label"))
    return frames.withColumn("_p", place).join(labels, [key, "_p"], "left").select(*frames.columns, "label")


def valid_spans(spans: DataFrame, durations: DataFrame, key: str) -> DataFrame:
    """Spans with ``0 <= start < end <= duration + 0.5``; an unknown duration does not limit."""
    known = spans.join(durations.select(key, "duration"), key, "left")
    fits = F.col("duration").isNull() | (F.col("duration") == 0) | (F.col("end_s") <= F.col("duration") + 0.5)
    return known.where((F.col("start_s") >= 0) & (F.col("end_s") > F.col("start_s")) & fits).drop("duration")


# --- envelopes and resampling ------------------------------------------------------

def _bin_of(row: Column, n: Column, bins: int) -> Column:
    return F.floor(((row + 1) * bins - 1) / n)


def _spine(keys: DataFrame, key: str, bins: int) -> DataFrame:
    return keys.select(key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))


def envelope(series: DataFrame, key: str, bins: int) -> DataFrame:
    """(key, bin, lo, hi, rms) of equal-width bins, scaled by the track's peak; empty bins are 0."""
    size = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("value")).alias("peak"))
    binned = series.join(size, key).withColumn("bin", _bin_of(F.col("frame_idx"), F.col("n"), bins))
    stats = binned.groupBy(key, "bin").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms")
    )
    scale = F.when(F.col("peak") > 0, F.col("peak")).otherwise(1.0)
    full = _spine(size, key, bins).join(stats, [key, "bin"], "left").join(size, key)
    return full.select(key, "bin", *[F.round(F.coalesce(c, F.lit(0.0)) / scale, 3).alias(c) for c in ("lo", "hi", "rms")])


def peaks(series: DataFrame, key: str, bins: int) -> DataFrame:
    """(key, bin, peak): peak of |x| per bin, scaled to the largest."""
    full = envelope(series, key, bins)
    return full.select(key, "bin", F.greatest(F.abs("lo"), F.abs("hi")).alias("peak"))


def rebin(env: DataFrame, key: str, bins: int, columns: int) -> DataFrame:
    """(key, col, lo, hi, rms): an envelope pooled to drawing columns, two at least.

    Column c covers bins floor(c/(columns-1) * (bins-1)) to ceil((c+1)/(columns-1) * (bins-1)).
    """
    last, ratio = bins - 1, (columns - 1) / (bins - 1)
    at = lambda c: F.least(F.lit(1.0), c / (columns - 1)) * last
    low = F.greatest(F.lit(0).cast("long"), F.floor((F.col("bin") - 1) * ratio) - 1)
    high = F.least(F.lit(columns - 1).cast("long"), F.ceil((F.col("bin") + 1) * ratio))
    cols = env.withColumn("col", F.explode(F.sequence(low, high))).where(
        (F.col("bin") >= F.floor(at(F.col("col")))) & (F.col("bin") <= F.ceil(at(F.col("col") + 1)))
    )
    return cols.groupBy(key, "col").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("rms").alias("rms"))


def resample(series: DataFrame, key: str, rate_in: int, rate_out: int, phase: float = 0.0) -> DataFrame:
    """(key, out_idx, value): linear interpolation at a new rate, clamped at both ends.

    Every source sample emits the output positions that fall on it; the first and
    last also take the positions beyond the ends.
    """
    step = rate_in / rate_out
    size = series.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    chunk = scan.chunk_for(series, "frame_idx")
    ahead = scan.neighbour(series, [key], "frame_idx", F.col("value"), "_next", step=1, chunk=chunk).join(size, key)
    total = F.bround(F.col("n") * rate_out / rate_in).cast("long")
    idx = F.col("frame_idx")
    low = F.when(idx == 0, F.lit(0).cast("long")).otherwise(F.floor((idx - phase) / step) - 1)
    high = F.when(idx == F.col("n") - 1, total - 1).otherwise(F.ceil((idx + 1 - phase) / step) + 1)
    out = ahead.withColumn("_n", total).withColumn("_lo", F.greatest(F.lit(0).cast("long"), low)).withColumn(
        "_hi", F.least(F.col("_n") - 1, high)
    ).where(F.col("_lo") <= F.col("_hi")).withColumn("out_idx", F.explode(F.sequence("_lo", "_hi")))
    pos = F.col("out_idx") * step + phase
    base = F.floor(pos)
    mine = F.greatest(F.lit(0).cast("long"), F.least(base, F.col("n") - 1)) == idx
    frac = pos - base
    value = (1 - frac) * F.col("value") + frac * F.coalesce("_next", "value")
    return out.where(mine).select(key, "out_idx", value.alias("value"))


def patches(series: DataFrame, key: str, size: int, hop: int) -> DataFrame:
    """Rows of every full fixed-size patch: (key, patch, offset, value); a trailing part is dropped."""
    length = series.groupBy(key).agg((F.max("frame_idx") + 1).alias("n"))
    idx = F.col("frame_idx")
    first = F.greatest(F.lit(0).cast("long"), F.ceil((idx - size + 1) / hop))
    last = F.floor(F.least(idx, F.col("n") - size) / hop)
    return series.join(length, key).withColumn("_a", first).withColumn("_b", last).where(
        (F.col("n") >= size) & (F.col("_a") <= F.col("_b"))
    ).withColumn("patch", F.explode(F.sequence("_a", "_b"))).select(
        key, "patch", (F.col("frame_idx") - F.col("patch") * hop).alias("offset"), "value"
    )


def histogram_mode(weighted: DataFrame, key: str, lo: float, hi: float, bins: int, prominence: float = PROMINENCE) -> DataFrame:
    """(key, mode): centre of the heaviest of equal bins over [lo, hi], 0 unless it stands out."""
    width = (hi - lo) / bins
    sums = weighted.where((F.col("value") >= lo) & (F.col("value") <= hi)).withColumn(
        "bin", F.least(F.floor((F.col("value") - lo) / width), F.lit(bins - 1).cast("long"))
    ).groupBy(key, "bin").agg(F.sum("weight").alias("w"))
    best = sums.groupBy(key).agg(F.max_by("bin", F.struct("w", -F.col("bin"))).alias("bin"), F.max("w").alias("top"), F.sum("w").alias("all"))
    centre = F.lit(lo) + (F.col("bin") + 0.5) * width
    stands_out = (F.col("top") > 0) & (F.col("top") >= F.col("all") / bins * prominence)
    return best.select(key, F.when(stands_out, centre).otherwise(0.0).alias("mode"))


def mean_profile(frames: DataFrame, key: str, vec: str, gate: float = GATE) -> DataFrame:
    """(key, pos, value): mean of per-frame max-normalised vectors, re-normalised, small values 0."""
    top = F.array_max(vec)
    tall = frames.select(key, F.posexplode(F.transform(vec, lambda v: F.when(top > 0, v / top).otherwise(v))).alias("pos", "v"))
    means = tall.groupBy(key, "pos").agg(F.avg("v").alias("m"))
    peak = F.max("m").over(Window.partitionBy(key))  # a dozen rows per key
    scaled = F.when(peak > 0, F.col("m") / peak).otherwise(F.col("m"))
    return means.select(key, "pos", F.when(scaled < gate, 0.0).otherwise(scaled).alias("value"))
