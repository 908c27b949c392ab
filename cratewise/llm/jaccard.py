"""Near-equal notes: an exact n-gram Jaccard join by vertical partitioning.

The word n-grams of all notes stand in one global order, rare ones first. The order is
cut into fragments, every note's set is cut with it, overlaps are counted fragment by
fragment and summed per pair of notes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage, release
from .blocks import SOLID, LOWER, Fingerprints, bounded_side, mix, pieces, runs, signed
from .components import components

CHUNKS = 64
FLUSH = 1 << 18  # n-grams that a task gathers before it passes them on

# Rounds of comparing with the most central class before pairs that are still apart are all compared.
STAR_ROUNDS = 2


def shingle_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram fingerprints) of every row.

    Words are what blanks part, A-Z lower-cased. A text of fewer than ``width`` words,
    but not none, has its whole word sequence as its one n-gram.
    """
    for rows, raw, off in pieces(texts):
        buf = LOWER[raw]
        starts, ends = runs(SOLID[buf], off)
        words = Fingerprints(buf).of(starts, ends)
        at = np.searchsorted(starts, off)
        n = len(words) - width + 1
        grams = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(width if n > 0 else 0):
            grams += words[k : k + n] * np.uint64(2 * (k * 0x9E3779B97F4A7C15 % (1 << 62)) + 1)
        grams = mix(grams)
        for i in range(len(off) - 1):
            a, b = at[i], at[i + 1]
            if b - a >= width:
                yield rows.start + i, np.unique(grams[a : b - width + 1])
            elif b > a:
                whole = np.uint64(b - a)
                for w in words[a:b]:
                    whole = mix(np.array([whole]) * np.uint64(0xD6E8FEB86659FD93) + w)[0]
                yield rows.start + i, np.array([whole], dtype=np.uint64)
            else:
                yield rows.start + i, np.zeros(0, dtype=np.uint64)


def set_signature(grams: np.ndarray) -> int:
    """One 64-bit fingerprint of a whole set, whatever its order."""
    return int(np.add.reduce(mix(grams ^ np.uint64(0x5851F42D4C957F2D)), initial=np.uint64(0)).view(np.int64))


class Order:
    """The global order of n-grams: rare before frequent, by the counts of hashed buckets.

    ``levels`` holds a bucket's count on a logarithmic scale; equal levels go by
    fingerprint. ``cuts`` part the order into fragments of about equal mass.
    """

    def __init__(self, counts: np.ndarray, fragments: int) -> None:
        self.levels = np.minimum(np.floor(8 * np.log2(counts + 1.0)), 255).astype(np.uint64)
        self.shift = np.uint64(64 - int(np.log2(len(counts))))
        mass = np.bincount(self.levels.astype(np.int64), weights=counts, minlength=256)
        ends = np.cumsum(mass)
        marks = ends[-1] * np.arange(1, fragments) / fragments
        level = np.searchsorted(ends, marks, side="right").clip(0, 255)
        inside = (marks - (ends[level] - mass[level])) / np.maximum(mass[level], 1)
        self.cuts = (level.astype(np.uint64) << np.uint64(56)) + (inside * float(1 << 56)).astype(np.uint64)

    @classmethod
    def from_parts(cls, levels: np.ndarray, shift: np.uint64, cuts: np.ndarray) -> Order:
        order = object.__new__(cls)
        order.levels, order.shift, order.cuts = levels, shift, cuts
        return order

    @property
    def parts(self) -> tuple:
        """Plain arrays, which reach a worker without this package; see :meth:`from_parts`."""
        return self.levels, self.shift, self.cuts

    def keys(self, grams: np.ndarray) -> np.ndarray:
        return (self.levels[(grams >> self.shift).astype(np.int64)] << np.uint64(56)) | (mix(grams) >> np.uint64(8))


def checksum(note: str = "note"):
    """A 64-bit checksum of the text as it stands."""
    return F.xxhash64(note)


def _sets_and_counts(width: int, buckets: int):
    """Per note its set size and signature; per task the n-gram counts of hashed buckets."""
    shift = np.uint64(64 - int(np.log2(buckets)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            sizes, sigs, held = [], [], []
            for _, grams in shingle_sets(batch.column(1), width):
                sizes.append(len(grams))
                sigs.append(set_signature(grams))
                held.append((grams >> shift).astype(np.int64))
                if len(held) == 2000:
                    counts += np.bincount(np.concatenate(held), minlength=buckets)
                    held = []
            if held:
                counts += np.bincount(np.concatenate(held), minlength=buckets)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["hash", "sum", "n", "sig", "chunk", "counts"],
            )
        if counts.any():
            parts = [zlib.compress(x.astype(np.int64).tobytes(), 1) for x in np.split(counts, CHUNKS)]
            k = len(parts)
            yield pa.RecordBatch.from_pydict(
                {"hash": pa.nulls(k, pa.int64()), "sum": pa.nulls(k, pa.int64()), "n": pa.nulls(k, pa.int64()), "sig": pa.nulls(k, pa.int64()),
                 "chunk": pa.array(range(k), pa.int32()), "counts": pa.array(parts, pa.binary())}
            )

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            part = np.frombuffer(zlib.decompress(counts), dtype=np.int64)
            sums[chunk] = sums[chunk] + part if chunk in sums else part
    if sums:
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())}
        )


def _share_of(n: np.ndarray | int, percent: int):
    """The least overlap that a set of size n can link with."""
    return -(-n * percent // 100)


def _prefixes(order, width: int, percent: int):
    """The first n-grams of each set in the global order; linked sets share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flushed(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in columns], names=["gram", "sig", "n", "pos"])

        ranked = Order.from_parts(*order.value)
        for batch in batches:
            out, held = [], 0
            for _, grams in shingle_sets(batch.column(0), width):
                n = len(grams)
                if n:
                    first = np.sort(ranked.keys(grams))[: n - _share_of(n, percent) + 1]
                    k = len(first)
                    out.append((first.view(np.int64), np.full(k, set_signature(grams)), np.full(k, n), np.arange(k)))
                    held += k
                if held > FLUSH:
                    yield flushed(out)
                    out, held = [], 0
            if out:
                yield flushed(out)

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by their first column, those whose value occurs in more rows.

    Batches keep their bounds: a row waits for its successor, never a whole group.
    """
    last: pa.RecordBatch | None = None
    last_shared = False
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        same = key[1:] == key[:-1]
        shared = np.zeros(len(key), dtype=bool)
        shared[1:] |= same
        shared[:-1] |= same
        if last is not None:
            joined = last.column(0)[0].as_py() == key[0]
            shared[0] |= joined
            if last_shared or joined:
                yield last
        yield batch.filter(pa.array(np.append(shared[:-1], False)))
        last, last_shared = batch.slice(len(key) - 1), bool(shared[-1])
    if last is not None and last_shared:
        yield last


def _segments(order, width: int):
    """A set cut by the fragments of the global order: (sig, fragment, n-grams)."""

    def flushed(sigs: list[int], frags: list[int], parts: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *map(len, parts)])
        grams = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(parts)))
        return pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(frags, pa.int32()), grams], names=["sig", "fragment", "grams"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = Order.from_parts(*order.value)
        for batch in batches:
            sigs, frags, parts, held = [], [], [], 0
            for _, grams in shingle_sets(batch.column(0), width):
                which = np.searchsorted(ranked.cuts, ranked.keys(grams), side="right")
                by = np.argsort(which, kind="stable")
                bounds = np.flatnonzero(np.diff(which[by])) + 1
                for part in np.split(by, bounds) if len(by) else []:
                    sigs.append(set_signature(grams))
                    frags.append(int(which[part[0]]))
                    parts.append(grams[part].view(np.int64))
                held += len(grams)
                if held > FLUSH:
                    yield flushed(sigs, frags, parts)
                    sigs, frags, parts, held = [], [], [], 0
            if parts:
                yield flushed(sigs, frags, parts)

    return run


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, overlap): partial overlaps counted in every fragment, then summed per pair."""
    left = segments.select(F.col("sig").alias("a"), "fragment", F.col("grams").alias("ga"))
    right = segments.select(F.col("sig").alias("b"), "fragment", F.col("grams").alias("gb"))
    partial = (
        pairs.select("a", "b").join(left, "a").join(right, ["b", "fragment"])
        .groupBy("a", "b", "fragment").agg(F.max(F.size(F.array_intersect("ga", "gb"))).alias("part"))
    )
    return partial.groupBy("a", "b").agg(F.sum("part").alias("overlap"))


# Fragments that are counted first, to rule pairs out before the rest is read.
HEAD = 1


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The ``pairs`` (a, b, na, nb) that link.

    The first fragments are counted for all pairs. A pair goes on only if it could still
    link with everything beyond them shared; then the other fragments are added.
    """
    def reached(overlap, na="na", nb="nb"):
        return 100 * overlap >= percent * (F.col(na) + F.col(nb) - overlap)

    front = segments.where(F.col("fragment") < HEAD)
    fronts = cut_lineage(front.groupBy("sig", "fragment").agg(F.max(F.size("grams")).alias("k")).groupBy("sig").agg(F.sum("k").alias("k")))
    counted = pairs.join(overlaps(pairs, front), ["a", "b"], "left")
    for side in ("a", "b"):
        counted = counted.join(fronts.select(F.col("sig").alias(side), F.col("k").alias(f"k{side}")), side, "left")
    some = F.coalesce("overlap", F.lit(0))
    most = some + F.least(F.col("na") - F.coalesce("ka", F.lit(0)), F.col("nb") - F.coalesce("kb", F.lit(0)))
    open_ = cut_lineage(counted.where(reached(most)).select("a", "b", "na", "nb", some.alias("some")))
    ends = overlaps(open_, segments.where(F.col("fragment") >= HEAD))
    total = F.col("some") + F.coalesce("overlap", F.lit(0))
    return cut_lineage(open_.join(ends, ["a", "b"], "left").where(reached(total)).select("a", "b"))


def note_links(
    notes: DataFrame, width: int = 5, percent: int = 80, fragments: int = 3, buckets: int = 1 << 20, every: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The sets of all ``notes`` and the links between distinct ones.

    ``notes`` is (hash, note): the free text kept with a track. Returns
    ``sets`` (hash, sum, n, sig), one row per note, its text's checksum, equal sets under one signature, and
    ``links`` (a, b), all pairs of signatures with ``100 * |A and B| >= percent * |A or B|``,
    each once. Without ``every``, enough of them to join the same components.

    * Equal sets are one class, so copies of any number cost one member.
    * The order comes from counts over all notes, kept in ``buckets`` hashed counters
      (a bounded table; raise it with the corpus). It decides cost, never the result.
    * Candidates share an n-gram of their order's first ``n - ceil(percent n) + 1``,
      which linked sets must. Its place, the number of n-grams before it that any other
      set shares, and the sizes bound the overlap and rule most out.
    * Every candidate pair that the bounds leave is compared.
    * Without ``every``, each class meets in the first rounds, for each n-gram it shares,
      only the class that has this n-gram earliest in its order, the one with least of its
      own. Classes already in one component are not compared again. What is still apart
      after STAR_ROUNDS rounds is compared pair by pair. So a group of near copies is
      joined through stars, not through all its pairs.

    Fingerprints are 64 bits wide.
    """
    spark = notes.sparkSession
    texts = notes.select("hash", "note")
    scanned = cut_lineage(
        texts.withColumn("sum", checksum()).mapInArrow(
            _sets_and_counts(width, buckets), "hash long, sum long, n long, sig long, chunk int, counts binary"
        )
    )
    sets = scanned.where("chunk IS NULL").select("hash", "sum", "n", "sig")
    chunks = (
        scanned.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk")
        .mapInArrow(_sum_chunks, "chunk int, counts binary").collect()
    )
    counts = np.zeros((CHUNKS, buckets // CHUNKS), dtype=np.int64)
    for row in chunks:
        counts[row["chunk"]] = np.frombuffer(zlib.decompress(row["counts"]), dtype=np.int64)
    order = spark.sparkContext.broadcast(Order(counts.reshape(-1), fragments).parts)

    classes = cut_lineage(sets.where("n > 0").groupBy("sig", "n").agg(F.min("hash").alias("least"), F.count("*").alias("members")))
    many = sets.join(bounded_side(cut_lineage(classes.where("members > 1").select("sig", "least"))), "sig")
    copies = cut_lineage(many.where("hash <> least").select("hash").distinct().join(classes.select(F.col("least").alias("hash")), "hash", "left_anti"))
    kept = texts.join(bounded_side(copies), "hash", "left_anti")

    prefixes = kept.select("note").mapInArrow(_prefixes(order, width, percent), "gram long, sig long, n long, pos long")
    shared = cut_lineage(
        prefixes.repartition("gram").sortWithinPartitions("gram").mapInArrow(_shared_only, "gram long, sig long, n long, pos long")
        .distinct().withColumn("seen", F.row_number().over(Window.partitionBy("sig").orderBy("pos", "gram")) - 1)
    )

    def bounds(x: str, y: str):
        """Whether sets sharing an n-gram at these places can still link.

        Earlier ones can be common only if they are shared at all; later ones all can.
        """
        before = F.least(f"{x}.seen", f"{y}.seen")
        after = F.least(F.col(f"{x}.n") - F.col(f"{x}.pos"), F.col(f"{y}.n") - F.col(f"{y}.pos"))
        most = before + after
        total = F.col(f"{x}.n") + F.col(f"{y}.n")
        return (100 * most >= percent * (total - most)) & (100 * F.least(f"{x}.n", f"{y}.n") >= percent * F.greatest(f"{x}.n", f"{y}.n"))

    def pairs_of(x: str, y: str) -> list:
        swap = F.col(f"{x}.sig") > F.col(f"{y}.sig")
        pick = lambda c, d: F.when(swap, F.col(d)).otherwise(F.col(c))
        return [pick(f"{x}.sig", f"{y}.sig").alias("a"), pick(f"{y}.sig", f"{x}.sig").alias("b"),
                pick(f"{x}.n", f"{y}.n").alias("na"), pick(f"{y}.n", f"{x}.n").alias("nb")]

    links = tested = segments = None

    def check(pairs: DataFrame) -> None:
        """Test ``pairs`` by the segments of the notes they name, read where they are new."""
        nonlocal links, tested, segments
        named = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        if segments is not None:
            named = named.join(segments.select("sig").distinct(), "sig", "left_anti")
        wanted = cut_lineage(named.join(classes, "sig").select(F.col("least").alias("w")).distinct())
        holders = texts.join(bounded_side(wanted), texts["hash"].eqNullSafe(F.col("w")), "left_semi")
        more = cut_lineage(holders.select("note").mapInArrow(_segments(order, width), "sig long, fragment int, grams array<long>"))
        segments = more if segments is None else segments.unionByName(more)
        found = _linked(pairs, segments, percent)
        links = found if links is None else links.unionByName(found)
        tested = pairs if tested is None else tested.unionByName(pairs)

    def untested(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        return cut_lineage(pairs if tested is None else pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"))

    placed = shared.withColumn("root", F.col("sig"))
    central = F.min(F.struct("pos", "sig", "n", "seen", "root"))
    for _ in range(0 if every else STAR_ROUNDS):
        first = placed.groupBy("gram").agg(central.alias("p"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram", "p")
        near = placed.join(first, "gram")
        other = near.where(F.col("root") != F.col("p.root")).groupBy("gram").agg(central.alias("q"))
        met = near.join(other, "gram").withColumn("y", F.when(F.col("root") == F.col("p.root"), F.col("q")).otherwise(F.col("p")))
        pairs = untested(
            met.select(F.struct("sig", "n", "pos", "seen").alias("x"), "y").where(bounds("x", "y")).select(*pairs_of("x", "y"))
        )
        if pairs.isEmpty():
            break
        check(pairs)
        roots = components(links).select(F.col("node").alias("sig"), F.col("root").alias("r"))
        # n-grams whose notes are all in one component have nothing left to say
        known = placed.drop("root").join(roots, "sig", "left").withColumn("root", F.coalesce("r", "sig")).drop("r")
        apart = known.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
        old, placed = (shared, placed), cut_lineage(known.join(apart, "gram"))
        release(*old)
    mixed = placed.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram")
    open_ = placed.join(mixed, "gram")
    check(untested(
        open_.alias("x").join(open_.alias("y"), F.col("x.gram") == F.col("y.gram"))
        .where((F.col("x.sig") < F.col("y.sig")) & (F.col("x.root") != F.col("y.root")) & bounds("x", "y")).select(*pairs_of("x", "y"))
    ))
    return sets, links


def _components_of(sets: DataFrame, links: DataFrame) -> DataFrame:
    """(sig, n, root, component) of every class: one signature and the smallest hash reachable over ``links``."""
    classes = sets.where("n > 0").groupBy("sig", "n").agg(F.min("hash").alias("least"))
    placed = classes.join(components(links).withColumnRenamed("node", "sig"), "sig", "left").select(
        "sig", "n", "least", F.coalesce("root", "sig").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("least").alias("component"))
    return placed.join(smallest, "root").select("sig", "n", "root", "component")


def note_components(notes: DataFrame, width: int = 5, percent: int = 80, fragments: int = 3, buckets: int = 1 << 20) -> DataFrame:
    """(hash, n_shingles, component_id) of every note, as :func:`note_classes` has them.

    Pairs inside a component that is already joined are not compared, so links are not counted.
    """
    sets, links = note_links(notes, width, percent, fragments, buckets, every=False)
    return sets.join(_components_of(sets, links), ["sig", "n"], "left").select(
        "hash", F.col("n").alias("n_shingles"), F.coalesce("component", "hash").alias("component_id")
    )


def note_classes(notes: DataFrame, width: int = 5, percent: int = 80, fragments: int = 3, buckets: int = 1 << 20) -> DataFrame:
    """(hash, n_shingles, component_id, n_links) of every note: its component and links to near-equal notes.

    ``notes`` is (hash, note), any further columns are ignored; ``hash`` is an integer
    key. ``component_id`` is the smallest hash reachable over links (see
    :func:`note_links`), the note's own included. ``n_links`` counts the other notes that
    link with it directly, copies of the same set among them.

    * A null or blank note has an empty set, its own hash as component and no links.
    * Rows that repeat a hash are notes of their own; each is returned and counted.
    * A null hash is returned with the smallest hash of its component, or null.
    * An empty table gives no rows. Long notes are read whole.
    """
    sets, links = note_links(notes, width, percent, fragments, buckets)
    members = sets.where("n > 0").groupBy("sig").agg(F.count("*").alias("members"))
    ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(members.withColumnRenamed("sig", "b"), "b").groupBy("a").agg(F.sum("members").alias("others"))
    counted = members.join(others.withColumnRenamed("a", "sig"), "sig", "left").select(
        "sig", (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    return sets.join(_components_of(sets, links).join(counted, "sig"), ["sig", "n"], "left").select(
        "hash", F.col("n").alias("n_shingles"), F.coalesce("component", "hash").alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def distinct_notes(notes: DataFrame, **options) -> DataFrame:
    """One row of ``notes`` for each component.

    It is the one with the smallest hash; a null hash comes last. Among texts with that
    hash the one of least checksum stays, among rows that repeat both the first by the
    other columns. Blank and null notes of one hash are a component; without a hash each
    of them stays, as nothing links them. Columns of any name are kept.

    The texts are read once more and, where the rows that go are few enough to be
    broadcast, never shuffled; only rows with a repeated hash and text are.
    """
    sets, links = note_links(notes, **options, every=False)
    rows = cut_lineage(
        sets.join(_components_of(sets, links).drop("component"), ["sig", "n"], "left").select(
            "hash", "sum", F.coalesce("root", "hash", F.lit(0)).alias("group"),
            F.when(F.col("n") > 0, 0).when(F.col("hash").isNotNull(), 1).otherwise(2).alias("kind"),
        ).groupBy("hash", "sum", "group", "kind").agg(F.count("*").alias("times"))
    )
    first = rows.groupBy("group", "kind").agg(F.min(F.struct(F.col("hash").isNull().alias("none"), "hash", "sum")).alias("first"))
    named = rows.where("kind <> 2").join(first, ["group", "kind"])
    stands = F.col("hash").eqNullSafe(F.col("first.hash")) & (F.col("sum") == F.col("first.sum"))
    free = "_" * (1 + max(map(len, notes.columns)))  # longer than any name of the notes
    h, s, at = free + "h", free + "s", free + "p"
    key = lambda t: t.select(F.col("hash").alias(h), F.col("sum").alias(s))
    gone, repeated = cut_lineage(key(named.where(~stands))), cut_lineage(key(named.where(stands & (F.col("times") > 1))))
    same = F.col("hash").eqNullSafe(F.col(h)) & (checksum() == F.col(s))
    kept = notes.join(bounded_side(gone), same, "left_anti")
    if repeated.isEmpty():
        return kept
    others = [c for c in notes.columns if c not in ("hash", "note")]
    place = F.row_number().over(Window.partitionBy("hash", "note").orderBy(*(others or [F.lit(0)])))
    repeated = bounded_side(repeated)
    one = kept.join(repeated, same, "left_semi").withColumn(at, place).where(F.col(at) == 1).drop(at)
    return kept.join(repeated, same, "left_anti").unionByName(one)
