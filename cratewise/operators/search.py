"""Search, facets, listings and playlists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import music, text as T
from ..plans import scan
from ..plans.ranks import group_rank, nearest_rank, order_stats

SEARCH_LIMIT = 8


def display_title(title: Column, filename: Column, key: Column) -> Column:
    """Title, else file name, else the first eight characters of the key."""
    return F.coalesce(T.blank_to_null(title), T.blank_to_null(filename), F.substring(key, 1, 8))


def library_listing(tracks: DataFrame, key: str = "hash") -> DataFrame:
    """Listing columns, newest first."""
    return tracks.select(
        key, display_title(F.col("title"), F.col("filename"), F.col(key)).alias("title"),
        T.artist_or_guess(F.col("tag_artist"), F.col("title"), F.col("filename")).alias("artist"),
        "style", "bpm", "key", "scale", "camelot", "duration", "created",
        (F.trim(F.coalesce("filepath", F.lit(""))) != "").alias("has_file"),
    ).orderBy(F.desc("created"), key)


def label_card(tracks: DataFrame, key: str = "hash") -> DataFrame:
    """Identity columns only: the card of a blind label never shows the read."""
    return tracks.select(key, "title", "filename", "tag_artist", "filepath")


def text_search(tracks: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query inside any of the columns, ignoring case; a blank query keeps all."""
    q = query.strip().lower()
    if not q:
        return tracks
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))).contains(q)
    return tracks.where(hit)


def quick_search(tracks: DataFrame, query: str, columns: list[str], order: list[Column], limit: int = SEARCH_LIMIT) -> DataFrame:
    """The first eight rows whose joined columns contain the query."""
    joined = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))
    return tracks.where(joined.contains(query.strip().lower())).orderBy(*order).limit(limit)


def in_range(value: Column, lo: float | None, hi: float | None) -> Column:
    """Bounds are inclusive; an unknown value passes only when neither is set."""
    if lo is None and hi is None:
        return F.lit(True)
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (value >= lo)
    if hi is not None:
        ok = ok & (value <= hi)
    return F.coalesce(ok, F.lit(False))


@dataclass
class Facets:
    """Every facet of the filter panel; unset ones do not filter (P5)."""

    artist: str = ""
    camelot: str = ""
    style: str = ""
    keystone: str = ""
    archgenre: str = ""
    tags: list[str] = field(default_factory=list)
    hidden: list[str] = field(default_factory=list)
    playable: bool = False
    flagged: bool = False
    bpm: tuple[float | None, float | None] = (None, None)
    length: tuple[float | None, float | None] = (None, None)


def facet_filter(nodes: DataFrame, f: Facets, playlist: DataFrame | None = None, key: str = "hash") -> DataFrame:
    """Nodes passing every set facet; all facets combine with AND (P5).

    Array columns: artists, styles (top three reads), keystones, tags.
    """
    ok = F.lit(True)
    has = lambda c, v: F.coalesce(F.array_contains(c, v), F.lit(False))
    if f.artist:
        ok = ok & F.exists("artists", lambda a: F.lower(a).contains(f.artist.strip().lower()))
    if f.camelot:
        ok = ok & (F.col("camelot") == f.camelot)
    if f.style:
        ok = ok & ((F.col("style") == f.style) | has("styles", f.style))
    if f.keystone:
        ok = ok & has("keystones", f.keystone)
    if f.archgenre:
        ok = ok & (F.col("archgenre") == f.archgenre)
    for tag in f.tags:
        ok = ok & has("tags", tag)
    if f.hidden:
        ok = ok & ~F.coalesce(F.arrays_overlap("keystones", F.array(*map(F.lit, f.hidden))), F.lit(False))
    if f.playable:
        ok = ok & F.col("playable")
    if f.flagged:
        ok = ok & F.col("flag")
    if f.bpm != (None, None):
        ok = ok & in_range(F.col("bpm"), *f.bpm)
    if f.length != (None, None):
        ok = ok & in_range(F.col("duration"), *f.length)
    kept = nodes.where(ok)
    return kept if playlist is None else kept.join(playlist.select(key), key, "left_semi")


def facet_bounds(tracks: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, lo, hi): floor and ceiling of the 1st and 99th nearest-rank percentile."""
    tall = tracks.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("facet"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("f")).select("f.*").where(F.col("value") > 0)
    picks = order_stats(tall, ["facet"], "value", {"lo": nearest_rank(0.01), "hi": nearest_rank(0.99)})
    lo, hi = F.floor("lo"), F.ceil("hi")
    return picks.select("facet", lo.alias("lo"), F.when(hi <= lo, lo + 1).otherwise(hi).alias("hi"))


def facet_values(nodes: DataFrame) -> DataFrame:
    """(facet, value, position): the distinct choices of the key, style and tag pickers."""
    pairs = F.flatten(F.array(
        F.array(F.struct(F.lit("camelot").alias("facet"), F.col("camelot").alias("value"))),
        F.transform(F.array_append("styles", F.col("style")), lambda s: F.struct(F.lit("style").alias("facet"), s.alias("value"))),
        F.transform("tags", lambda t: F.struct(F.lit("tag").alias("facet"), t.alias("value"))),
    ))
    values = nodes.select(F.explode(pairs).alias("p")).select("p.*").where(F.coalesce("value", F.lit("")) != "").distinct()
    number = F.when(F.col("facet") == "camelot", music.wheel_number(F.col("value")))
    return values.withColumn("number", number).orderBy("facet", "number", "value")


def known_genres(nodes: DataFrame, columns: list[str], arrays: list[str]) -> DataFrame:
    """(genre): every genre name the library carries."""
    singles = F.array(*[F.col(c) for c in columns])
    every = F.concat(singles, *[F.coalesce(F.col(a), F.array().cast("array<string>")) for a in arrays])
    return nodes.select(F.explode(every).alias("genre")).where(F.coalesce("genre", F.lit("")) != "").distinct()


def complete_genre(genres: DataFrame, prefix: str) -> DataFrame:
    """The genre a prefix completes to: an exact match first, then alphabetical."""
    q = prefix.strip().lower()
    low = F.lower("genre")
    hits = genres.where((low == q) | low.startswith(q)) if q else genres.limit(0)
    return hits.orderBy(F.when(low == q, 0).otherwise(1), low, "genre").limit(1)


def point_lookup(tracks: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """(key, found) for asked keys."""
    return values.select(key).distinct().join(tracks.select(key).distinct().withColumn("_f", F.lit(True)), key, "left").select(
        key, F.col("_f").isNotNull().alias("found")
    )


# --- harmonic mixing -----------------------------------------------------------------

def harmonic_matches(tracks: DataFrame, key: str, camelot: str, bpm: float | None, self_key=None) -> DataFrame:
    """Tracks that mix with one selected track: one pruned scan, no join."""
    ok = music.keys_compatible(F.lit(camelot), F.col("camelot")) & music.bpms_compatible(F.lit(bpm).cast("double"), F.col("bpm"))
    hits = tracks.where(ok)
    return hits if self_key is None else hits.where(F.col(key) != self_key)


_NEAR_ENDS = 16  # half steps of a double that an end is looked for on either side


def _tempo_windows(tempos: DataFrame) -> DataFrame:
    """(bpm, v, kind, sign): first (kind 0) and last (2) tempo that mixes with each bpm at half, equal and double time.

    Ends are exact to the double: inside a window the rule is monotone on either side,
    so an end is the outermost neighbour of the rounded end for which the rule holds.
    """
    t = music.BPM_TOLERANCE
    ends = [  # factor of the end, whether other tempos are above, octaves between, last of its window
        (1 / (2 * (1 + t)), False, 2, False), (1 / (2 * (1 - t)), False, 2, True),
        (1 / (1 + t), False, 1, False), (1 + t, True, 1, True),
        (2 * (1 - t), True, 2, False), (2 * (1 + t), True, 2, True),
    ]
    own = F.col("bpm").cast("double")
    stepped = tempos.select("bpm", *[(own * f).alias(f"_v{i}") for i, (f, *_) in enumerate(ends)]).select(
        "*", *[F.pow(F.lit(2.0), F.floor(F.log2(f"_v{i}")) - 53).alias(f"_s{i}") for i in range(len(ends))]
    )
    near = F.array(*[F.lit(k) for k in range(-_NEAR_ENDS, _NEAR_ENDS + 1)])

    def end(i: int) -> Column:
        _, above, octave, last = ends[i]
        ratio = (lambda x: F.try_divide(x, own)) if above else (lambda x: F.try_divide(own, x))
        at = F.transform(near, lambda k: F.col(f"_v{i}") + F.col(f"_s{i}") * k)
        held = F.filter(at, lambda x: F.abs(ratio(x) / octave - 1) <= t)
        point = (F.array_max if last else F.array_min)(held)
        return F.named_struct(F.lit("v"), point, F.lit("kind"), F.lit(2 if last else 0), F.lit("sign"), F.lit(1 if last else -1))

    return stepped.select("bpm", F.explode(F.array(*[end(i) for i in range(len(ends))])).alias("_w")).select("bpm", "_w.*").where("v IS NOT NULL")


_LINE_ROWS = 25  # a cell and its six ends in four codes


def harmonic_counts(tracks: DataFrame, key: str, small: int = scan.LONG_SERIES) -> DataFrame:
    """(key, partners): how many other tracks each track mixes with.

    Tracks are first counted per distinct (camelot, bpm), so a popular key and tempo
    is one row. A cell asks its four codes for three windows of tempo. Cells and the
    windows' ends are sorted together once per code, and a window is the difference of
    two running counts, so no two cells meet: n log n whatever the tempos. Up to ``small``
    rows of cells and ends take one window per code, more are ranked by ranges.
    """
    code = F.concat(music.wheel_number(F.col("camelot")).cast("string"), music.wheel_letter(F.col("camelot")))
    coded = tracks.select(key, "bpm", code.alias("camelot"))
    cells = coded.where(F.col("camelot").isNotNull() & (F.col("bpm").isNull() | (F.col("bpm") >= 0))).groupBy("camelot", "bpm").agg(
        F.count(F.lit(1)).alias("c")
    )
    timed = cells.where("bpm > 0")
    windows = _tempo_windows(timed.select("bpm").distinct())
    asks = timed.select("camelot", "bpm", F.explode(music.compatible_codes(F.col("camelot"))).alias("code")).join(windows, "bpm")
    # At one tempo the windows that start there come before its tracks, those that end there after them.
    line = timed.select(F.col("camelot").alias("code"), F.col("bpm").cast("double").alias("v"), F.lit(1).alias("kind"), "c").unionByName(
        asks.select("code", "v", "kind").distinct().withColumn("c", F.lit(0).cast("long"))
    )
    if timed.count() * _LINE_ROWS <= small:
        counts = line.withColumn("_before", F.sum("c").over(Window.partitionBy("code").orderBy("v", "kind")))
    else:
        sorted_line = group_rank(line, ["code"], [F.col("v"), F.col("kind")], out="_i")
        counts = scan.running_sum(sorted_line, ["code"], "_i", F.col("c"), "_before")
    timed_hits = asks.join(counts.where("kind <> 1").select("code", "v", "kind", "_before"), ["code", "v", "kind"]).groupBy("camelot", "bpm").agg(
        F.sum(F.col("sign") * F.col("_before")).alias("hits")
    )
    untimed = cells.groupBy("camelot").agg(F.sum("c").alias("all"), F.sum(F.when(F.col("bpm").isNull(), F.col("c"))).alias("nobpm"))
    reach = untimed.select(F.col("camelot").alias("camelot2"), "all", "nobpm")
    wide = untimed.select("camelot", F.explode(music.compatible_codes(F.col("camelot"))).alias("camelot2")).join(reach, "camelot2").groupBy(
        "camelot"
    ).agg(F.sum("all").alias("any_bpm"), F.coalesce(F.sum("nobpm"), F.lit(0)).alias("unknown"))
    timed_hits = timed_hits.select(F.col("camelot").alias("_c"), F.col("bpm").alias("_b"), "hits")
    scored = cells.join(wide, "camelot").join(timed_hits, (F.col("camelot") == F.col("_c")) & (F.col("bpm") == F.col("_b")), "left").select(
        "camelot", "bpm",
        F.when(F.col("bpm").isNull(), F.col("any_bpm") - 1).when(~music.bpms_compatible(F.col("bpm"), F.col("bpm")), F.col("unknown"))
        .otherwise(F.coalesce("hits", F.lit(0)) + F.col("unknown") - 1).alias("partners"),
    )
    per_cell = scored.select(F.col("camelot").alias("_k"), F.col("bpm").alias("_b"), "partners")
    return coded.join(per_cell, (F.col("camelot") == F.col("_k")) & F.col("bpm").eqNullSafe(F.col("_b")), "left").select(
        key, F.coalesce("partners", F.lit(0)).cast("long").alias("partners")
    )


# --- tags, vibes, playlists, labels --------------------------------------------------

def tag_names(asked: DataFrame, links: DataFrame, tags: DataFrame, key: str = "hash") -> DataFrame:
    """(key, tags): sorted tag names of every asked track, tagged or not."""
    wanted = asked.select(key).distinct()
    named = links.join(wanted, key, "left_semi").join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    # Distinct names per track: bounded by the tag vocabulary.
    sets = named.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("tags"))
    return wanted.join(sets, key, "left").select(key, F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def member_counts(groups: DataFrame, links: DataFrame, link_id: str, key: str = "hash") -> DataFrame:
    """(id, name, count) of tags or vibes, empty ones kept."""
    counts = links.groupBy(link_id).agg(F.count(key).alias("count"))
    return groups.join(counts, groups["id"] == counts[link_id], "left").select("id", "name", F.coalesce("count", F.lit(0)).alias("count"))


def vibe_listing(members: DataFrame, tracks: DataFrame, key: str = "hash") -> DataFrame:
    """Members with titles, strongest first; a member absent from the library stays."""
    return members.join(tracks.select(key, "title"), key, "left").orderBy(F.desc("weight"), key)


def membership(vibes: DataFrame, members: DataFrame, key: str = "hash") -> DataFrame:
    """(id, name, key) of every vibe; one with no member has a null key."""
    return vibes.join(members.select(F.col("vibe_id").alias("id"), key), "id", "left").select("id", "name", key)


def playlist_rows(playlists: DataFrame, tracks: DataFrame, key: str = "hash") -> DataFrame:
    """(id, pos, key, ...): playlist entries in list order, repeats kept, unknown tracks skipped.

    ``playlists.tracks`` is the stored JSON list of hashes or objects with a hash.
    """
    entries = F.from_json("tracks", "array<string>")
    item = F.coalesce(F.get_json_object("entry", f"$.{key}"), F.when(~F.col("entry").startswith("{"), F.col("entry")))
    flat = playlists.select("id", F.posexplode(entries).alias("pos", "entry")).select("id", "pos", item.alias(key)).where(F.coalesce(key, F.lit("")) != "")
    return flat.join(tracks, key)


def playlist_index(playlists: DataFrame) -> DataFrame:
    """Playlists newest first with their length; an unreadable list counts 0 (L4)."""
    size = F.size(F.from_json("tracks", "array<string>"))
    return playlists.select("id", "name", F.when(size > 0, size).otherwise(0).alias("count"), "updated").orderBy(F.desc("updated"), "id")


def recent_labels(labels: DataFrame, tracks: DataFrame, key: str = "hash", limit: int = 20) -> DataFrame:
    """The newest labels with track identity."""
    newest = labels.join(tracks.select(key), key, "left_semi").orderBy(F.desc("created"), key).limit(limit)
    return newest.join(tracks, key).orderBy(F.desc("created"), key)
