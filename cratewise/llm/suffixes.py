"""Repeated passages of notes: exact substring de-duplication by bucket-pointer refinement.

Bucket-pointer refinement sorts suffixes by first throwing them into buckets by their
first q bytes, then refines only buckets with several members, by the bucket
identifiers found at later offsets, whose own refinements are reused. Here a bucket
identifier is a fingerprint, so it is the same number on every machine, and three
things differ from an array in one memory: only content-chosen suffixes are thrown
into the first buckets, buckets live in sorted partitions, and refinement stops at the
depth that the rule asks for.

1. Every window of ``length`` bytes holds one *anchor*: its q-gram with the least
   identifier. The choice depends on the window's bytes alone, so equal windows have
   equal anchors at equal places. Neighbouring windows mostly share theirs; such a
   stretch of windows is a *run*. The q-gram of the anchor is the initial bucket.
2. A bucket with one member is done. Members of the others are sorted by the identifier
   of their whole run (all bytes that its windows reach), then by place: equal runs but
   the first repeat it, window for window.
3. Buckets that hold several different runs are refined to single windows, named by
   doubling from the identifiers of a quarter of their length; only the first run of
   each kind takes part, since the others are settled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage
from .blocks import Fingerprints, bounded_side, fold, pieces, signed

GRAM = 36

# Places or ends of spans (8 bytes each) that are shipped whole to every executor at most.
MOST_PLACES = 4_000_000

# A place packs (checksum of the text: 24 bits, start: 32 bits, windows of the run: 7 bits);
# places of one note sort by start.
_START, _SUM = 7, 39


def _window_minima(grams: np.ndarray, width: int) -> np.ndarray:
    """The least value among every ``width`` neighbours."""
    reach, least = 1, grams
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(least[:-rest], least[rest:]) if rest else least


def _text_runs(buf: np.ndarray, off: np.ndarray, length: int, gram: int):
    """Runs of windows of one piece: (row, start in row, windows, bucket, run identifier)."""
    none = np.zeros(0, dtype=np.int64)
    n = len(buf)
    if n < length:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    prints = Fingerprints(buf)
    low = np.uint64((1 << int(n).bit_length()) - 1)
    ids = prints.grams(gram)
    least = _window_minima((ids & ~low) | np.arange(len(ids), dtype=np.uint64), length - gram + 1)
    anchor = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= off[1:][row]
    new = np.empty(len(anchor), dtype=bool)
    new[0] = True
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), len(anchor))
    last = stop[np.searchsorted(stop, first, side="right")]
    return row[first], first - off[row[first]], last - first, ids[anchor[first]], prints.of(first, last + length - 1)


def _runs_of(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, buf, off in pieces(batch.column(2)):
                row, start, count, bucket, name = _text_runs(buf, off, length, gram)
                if len(row):
                    place = (sums[rows][row] << _SUM) | (start << _START) | count
                    yield pa.RecordBatch.from_arrays(
                        [signed(bucket), signed(name), batch.column(0).slice(rows.start, rows.stop - rows.start).take(pa.array(row)), pa.array(place)],
                        names=["bucket", "name", "hash", "place"],
                    )

    return run


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of buckets with several, each marked when it is the first of its name.

    Rows come sorted by (bucket, name, hash, place) and are passed on as they come; what
    is kept between batches is one row and the first place of its name. A row that stands
    at the same place of the same note as the first one is that note's twin, a head too.
    """
    held: pa.RecordBatch | None = None
    held_shared = False
    head: tuple | None = None  # bucket, name, hash, place of the latest head
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bucket, name, place = (batch.column(i).to_numpy() for i in (0, 1, 3))
        known = batch.column(2).is_null().to_numpy(zero_copy_only=False)
        key = batch.column(2).fill_null(0).to_numpy()
        fresh = np.empty(n, dtype=bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (name[1:] != name[:-1])
        fresh[0] = head is None or head[:2] != (bucket[0], name[0])
        at = np.maximum.accumulate(np.where(fresh, np.arange(n), -1))
        lead = at.clip(0)
        same = (known == known[lead]) & (key == key[lead]) & (place == place[lead])
        early = at < 0
        if early.any():
            same[early] = (known[early] == head[2]) & (key[early] == head[3]) & (place[early] == head[4])
        if at[-1] >= 0:
            k = at[-1]
            head = (bucket[k], name[k], known[k], key[k], place[k])
        pair = bucket[1:] == bucket[:-1]
        shared = np.zeros(n, dtype=bool)
        shared[1:] |= pair
        shared[:-1] |= pair
        marked = pa.RecordBatch.from_arrays([*batch.columns, pa.array(same)], names=["bucket", "name", "hash", "place", "head"])
        if held is not None:
            joined = held.column(0)[0].as_py() == bucket[0]
            shared[0] |= joined
            if held_shared or joined:
                yield held
        yield marked.filter(pa.array(np.append(shared[:-1], False)))
        held, held_shared = marked.slice(n - 1), bool(shared[-1])
    if held is not None and held_shared:
        yield held


def _windows_of(length: int):
    """Every window of the given runs: its identifier, doubled up from a quarter of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(2)
            counts = np.diff(places.offsets.to_numpy())
            flat = places.flatten().to_numpy()
            for rows, buf, off in pieces(batch.column(1)):
                took = flat[counts[: rows.start].sum() : counts[: rows.stop].sum()]
                row = np.repeat(np.arange(rows.stop - rows.start), counts[rows])
                if not len(took) or len(buf) < length:
                    continue
                ids, reach = Fingerprints(buf).grams(length // 4), length // 4
                while reach * 2 <= length:
                    ids, reach = fold(ids, reach), reach * 2
                if reach < length:
                    ids = fold(ids, length - reach)
                start, count = (took >> _START) & 0xFFFFFFFF, took & 127
                each = np.repeat(np.arange(len(took)), count)
                step = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
                place = (took[each] >> _SUM << _SUM) | (start[each] + step << _START) | 1
                name = ids[off[row][each] + start[each] + step]
                yield pa.RecordBatch.from_arrays(
                    [signed(name), signed(name), batch.column(0).slice(rows.start, rows.stop - rows.start).take(pa.array(row[each])), pa.array(place)],
                    names=["bucket", "name", "hash", "place"],
                )

    return run


_MEMBERS = "bucket long, name long, hash long, place long"


def _sorted_heads(members: DataFrame) -> DataFrame:
    spread = members.repartition("bucket").sortWithinPartitions("bucket", "name", "hash", "place")
    return spread.mapInArrow(_heads, _MEMBERS + ", head boolean")


def _checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).bitwiseAND(0xFFFFFF)


def repeated_spans(notes: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """(hash, checksum, spans): for notes with repeats, the byte ranges an earlier text holds.

    ``spans`` is an array of (start, end), end exclusive, sorted, maximal, over the UTF-8
    bytes of ``note``: exactly the bytes covered by a string of ``length`` bytes that also
    starts earlier, in a note of smaller hash or earlier in the same note. Strings are
    judged on the input. ``checksum`` tells apart rows that repeat a hash.

    Notes equal as a whole are settled first: all but the one of smallest hash repeat it.
    Nothing is collected; a bucket is streamed through its partition in sorted order and
    never held. ``length`` is from 2 ``gram`` up to 126 bytes more than ``gram``.
    """
    if not 2 * gram <= length <= gram + 126 or length % 4:
        raise ValueError("length must be a multiple of four between 2 * gram and gram + 126")
    texts = notes.select("hash", _checksum(F.col("note")).alias("checksum"), F.coalesce("note", F.lit("")).alias("note"))
    long = texts.where(F.octet_length("note") >= length)
    digest = F.md5("note")
    twins = cut_lineage(
        long.groupBy(digest.alias("digest")).agg(F.min(F.struct("hash")).alias("first"), F.max(F.struct("hash")).alias("last"))
        .where("first <> last").select("digest", F.col("first.hash").alias("first"), F.lit(True).alias("known"))
    )
    flagged = long.withColumn("digest", digest).join(bounded_side(twins), "digest", "left")
    twin = F.col("known").isNotNull() & ~F.col("hash").eqNullSafe(F.col("first"))
    whole = flagged.where(twin).select("hash", "checksum", F.lit(0).cast("long").alias("s"), F.octet_length("note").cast("long").alias("e"))
    own = flagged.where(~twin).select("hash", "checksum", "note")

    members = cut_lineage(_sorted_heads(own.mapInArrow(_runs_of(length, gram), _MEMBERS)))
    heads = members.where("head").groupBy("bucket", "name").agg(F.min(F.struct("hash", "place")).alias("m"))
    mixed = heads.groupBy("bucket").agg(F.count("*").alias("kinds")).where("kinds > 1").select("bucket")
    refine = (
        heads.join(mixed, "bucket").select("m.*")
        .groupBy("hash", F.shiftrightunsigned("place", _SUM).alias("checksum")).agg(F.sort_array(F.collect_list("place")).alias("places"))
    )
    refine = cut_lineage(refine)
    texts_of = own.join(
        bounded_side(refine, MOST_PLACES, F.size("places")).alias("r"), own["hash"].eqNullSafe(F.col("r.hash")) & (own["checksum"] == F.col("r.checksum"))
    ).select(own["hash"], own["note"], "places")
    windows = _sorted_heads(texts_of.mapInArrow(_windows_of(length), _MEMBERS))

    repeats = members.where("not head").unionByName(windows.where("not head"))
    start = F.shiftrightunsigned("place", _START).bitwiseAND(0xFFFFFFFF)
    ranges = repeats.select(
        "hash", F.shiftrightunsigned("place", _SUM).alias("checksum"), start.alias("s"),
        (start + F.col("place").bitwiseAND(127) + (length - 1)).alias("e"),
    ).unionByName(whole)
    return ranges.groupBy("hash", "checksum").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("found")).select(
        "hash", "checksum", _merged(F.col("found")).alias("spans")
    )


def _merged(found: Column) -> Column:
    """Sorted ranges joined where they overlap or touch."""
    kind = "array<struct<s:bigint,e:bigint>>"
    state = F.struct(F.lit(None).cast(kind).alias("done"), F.lit(None).cast("struct<s:bigint,e:bigint>").alias("open"))
    empty = F.array().cast(kind)

    def step(acc: Column, r: Column) -> Column:
        opened, done = acc["open"], F.coalesce(acc["done"], empty)
        grown = F.struct(opened["s"].alias("s"), F.greatest(opened["e"], r["e"]).alias("e"))
        return F.when(opened.isNotNull() & (r["s"] <= opened["e"]), F.struct(done.alias("done"), grown.alias("open"))).otherwise(
            F.struct(F.when(opened.isNull(), done).otherwise(F.concat(done, F.array(opened))).alias("done"), r.alias("open"))
        )

    return F.aggregate(found, state, step, lambda acc: F.concat(F.coalesce(acc["done"], empty), F.array(acc["open"])))


def without_repeats(notes: DataFrame, length: int = 100, gram: int = GRAM) -> DataFrame:
    """``notes`` with ``spans`` and ``kept``: the bytes left once repeated passages are cut out.

    ``notes`` is (hash, note) and any further columns, all returned, but those named
    ``spans``, ``kept``, ``checksum``, ``_h`` and ``_c`` are replaced or left out. ``kept`` is binary, since a cut can fall inside a
    character. Each row is returned once.

    * A null or empty note has no bytes and no spans; so has one shorter than ``length``.
    * Rows equal in hash and note are one document: none repeats the other.
    * Rows that share a hash but not the note are told apart and ordered by checksum.
    * A null hash comes before all others.
    * An empty table gives no rows; notes of any length are read whole.
    """
    notes = notes.drop("spans", "kept", "checksum", "_h", "_c")
    spans = cut_lineage(repeated_spans(notes, length, gram))
    text = F.coalesce(F.col("note"), F.lit(""))
    keyed = notes.withColumn("checksum", _checksum(F.col("note")))
    found = keyed.join(
        bounded_side(spans, MOST_PLACES, 2 * F.size("spans")).withColumnRenamed("hash", "_h").withColumnRenamed("checksum", "_c"),
        F.col("hash").eqNullSafe(F.col("_h")) & (F.col("checksum") == F.col("_c")), "left",
    )
    raw = F.encode(text, "UTF-8")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["e"]))
    starts = F.concat(F.transform("spans", lambda s: s["s"]), F.array(F.octet_length(text).cast("long")))
    gaps = F.zip_with(ends, starts, lambda e, s: F.struct(e.alias("e"), s.alias("s")))
    kept = F.aggregate(
        gaps, F.lit(b"").cast("binary"),
        lambda acc, g: F.concat(acc, F.substring(raw, g["e"].cast("int") + 1, (g["s"] - g["e"]).cast("int"))),
    )
    return found.withColumn("kept", F.when(F.col("spans").isNull(), raw).otherwise(kept)).withColumn(
        "spans", F.coalesce("spans", F.array().cast("array<struct<s:bigint,e:bigint>>"))
    ).drop("_h", "_c", "checksum")
