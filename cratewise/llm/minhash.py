"""Near copies of notes: one-permutation MinHash, banded buckets, star-shaped candidates.

One hash per word n-gram serves all bins of a sketch; an empty bin borrows from a filled
one that it draws by a hash of its own (optimal densification). Bands of bins are the
buckets. A bucket proposes a star, its hub with every other member, so candidates grow
with the members and never with their pairs. Every link is confirmed on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage
from .blocks import bounded_side, mix
from .components import components
from .jaccard import checksum, set_signature, shingle_sets

BANDS, ROWS = 40, 5
# How far the share of equal bins may lie below the asked similarity before a pair is left
# out unseen: ten standard deviations of 200 bins at 0.8. Shares are read from 8-bit marks.
MARGIN = 0.3
STAR_ROUNDS = 3
MEMBERS = 512  # of a star or a block that one group of a task compares
FLUSH = 2_000

_SALT = np.uint64(0x2545F4914F6CDD1D)


def _draws(bins: int, turn: int, turns: int = 64) -> np.ndarray:
    """The bins that every bin asks, one after another, for a value: (bins, turns)."""
    x = np.arange(bins * turns, dtype=np.uint64) + np.uint64(turn * bins * turns)
    return (mix(x * _SALT + np.uint64(1)) % np.uint64(bins)).astype(np.int64).reshape(turns, bins).T


class Sketcher:
    """Sketches of sets of fingerprints: ``bins`` numbers, equal at a place about as often as sets are alike."""

    def __init__(self, bins: int) -> None:
        self.bins, self.draws = np.uint64(bins), [_draws(bins, 0)]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Of sorted distinct fingerprints, at least one: a bin's least one is its first."""
        at = (((grams >> np.uint64(32)) * self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        sketch, filled = np.zeros(int(self.bins), dtype=np.uint64), np.zeros(int(self.bins), dtype=bool)
        sketch[at[first]], filled[at[first]] = grams[first], True
        source, left, turn = np.arange(int(self.bins)), np.flatnonzero(~filled), 0
        while len(left):
            if turn == len(self.draws):
                self.draws.append(_draws(int(self.bins), turn))
            asked = self.draws[turn][left]
            good = filled[asked]
            hit = good.any(axis=1)
            source[left[hit]] = asked[hit, good[hit].argmax(axis=1)]
            left, turn = left[~hit], turn + 1
        return sketch[source]


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """One bucket key per band of the sketch."""
    rows = mix(sketch).reshape(bands, -1)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * _SALT
    for column in rows.T:
        keys = mix(keys * np.uint64(0xD6E8FEB86659FD93) + column)
    return keys


def _sketched(width: int, bands: int, rows: int):
    """(hash, sum, text) to (hash, sum, n, sig, keys, marks) of every note."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher(bands * rows)
        for batch in batches:
            n = batch.num_rows
            sizes, sigs = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            keys, marks = np.zeros((n, bands), dtype=np.uint64), np.zeros((n, bands * rows), dtype=np.uint8)
            for i, grams in shingle_sets(batch.column(2), width):
                sizes[i], sigs[i] = len(grams), set_signature(grams)
                if len(grams):
                    sketch = sketcher.of(grams)
                    keys[i], marks[i] = band_keys(sketch, bands), mix(sketch ^ _SALT).astype(np.uint8)
            for at in range(0, n, FLUSH):
                part = slice(at, min(at + FLUSH, n))
                k = part.stop - at
                held = pa.ListArray.from_arrays(pa.array(np.arange(k + 1) * bands, pa.int32()), pa.array(keys[part].view(np.int64).ravel()))
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(bands * rows), k, [None, pa.py_buffer(np.ascontiguousarray(marks[part]))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, k), batch.column(1).slice(at, k), pa.array(sizes[part]), pa.array(sigs[part]), held, whole.cast(pa.binary())],
                    names=["hash", "sum", "n", "sig", "keys", "marks"],
                )

    return run


def _alike(bins: int, percent: int):
    """Whether two columns of marks are equal at enough places for a link."""
    least = max(percent / 100 - MARGIN, 0.0) * bins

    @F.arrow_udf("boolean")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint8).reshape(len(c), bins) for c in (a, b))
        return pa.array((x == y).sum(axis=1) >= least)

    return run


def _links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On whole sets, both sorted and distinct."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    x = np.concatenate([a, b])
    x.sort()
    both = int((x[1:] == x[:-1]).sum())
    return 100 * both >= percent * (len(x) - both)


def _confirm(width: int, percent: int):
    """Rows sorted by (hub, lane, role): a hub's text, then its members' texts, to links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub = None, None
        for batch in batches:
            hubs, lanes, roles, sigs = (batch.column(c).to_numpy() for c in range(4))
            found = []
            for i, grams in shingle_sets(batch.column(4), width):
                if roles[i] == 0:
                    now, hub = (hubs[i], lanes[i]), grams
                elif now == (hubs[i], lanes[i]) and _links(hub, grams, percent):
                    found.append((int(hubs[i]), int(sigs[i])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def _rows_of_group(percent: int, bins: int):
    least = max(percent / 100 - MARGIN, 0.0) * bins

    def pairs(table: pa.Table) -> Iterator[tuple[int, int]]:
        """Places (i, j) of a group that must be compared here.

        Both lie in the blocks of this group, in different components, could link by size
        and marks, and share no earlier band, where they would meet as well.
        """
        roots, sizes, side = (table.column(c).to_numpy() for c in ("root", "n", "side"))
        band = table.column("band")[0].as_py()
        marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype=np.uint8).reshape(len(roots), bins)
        keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(roots), -1)[:, :band]
        diagonal = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        for i in range(len(roots)):
            ok = (np.arange(len(roots)) > i) if diagonal else (side > side[i])
            ok &= (roots != roots[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
            at = np.flatnonzero(ok)
            at = at[(marks[at] == marks[i]).sum(axis=1) >= least]
            at = at[~(keys[at] == keys[i]).any(axis=1)]
            for j in at:
                yield i, int(j)

    return pairs


def _open_members(percent: int, bins: int):
    """The members of a group with anything left to compare."""
    pairs = _rows_of_group(percent, bins)

    def run(table: pa.Table) -> pa.Table:
        wanted = np.zeros(table.num_rows, dtype=bool)
        for i, j in pairs(table):
            wanted[i] = wanted[j] = True
        return table.filter(pa.array(wanted)).select(["key", "x", "y", "sig"])

    return run


def _compare_block(width: int, percent: int, bins: int):
    """Links inside a group, as many as join what they join."""
    pairs = _rows_of_group(percent, bins)

    def run(table: pa.Table) -> pa.Table:
        sets = {i: grams for i, grams in shingle_sets(table.column("note"), width)}
        up = {int(r): int(r) for r in table.column("root").to_numpy()}
        roots, sigs = table.column("root").to_pylist(), table.column("sig").to_pylist()

        def top(r: int) -> int:
            while up[r] != r:
                up[r] = r = up[up[r]]
            return r

        found = []
        for i, j in pairs(table):
            p, q = top(roots[i]), top(roots[j])
            if p != q and _links(sets[i], sets[j], percent):
                up[p] = q
                found.append((sigs[i], sigs[j]))
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_copies(notes: DataFrame, width: int = 4, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(hash, n_shingles, component_id, kept) of every note: its group of near copies and the one that stands for it.

    ``notes`` is (hash, note), the free text kept with a track; further columns are
    ignored whatever their names. ``hash`` is an integer key. A note's set is its distinct
    ``width``-word n-grams, A-Z lower-cased; two notes link when
    ``100 * |A and B| >= percent * |A or B|``. ``component_id`` is the smallest hash
    reachable over links, ``kept`` whether it is the note's own.

    * Notes of equal sets are one class and cost one member.
    * A pair linked at the bound of 0.8 shares one of 40 bands of 5 bins but for one case
      in 8 million; closer pairs are missed far more rarely.
    * For STAR_ROUNDS rounds each bucket proposes its hub, the member of least signature,
      with each member of other components. The next round takes the least member of what
      is not yet in the hub's component, and so on.
    * Buckets that still hold several components are cut into blocks of about MEMBERS and
      block pairs are compared inside a task, but for those inside the largest component;
      only links leave it. No candidate is dropped.
    * Links are confirmed on whole sets of 64-bit fingerprints, read from whole texts.
    * A null or blank note has an empty set, its own hash as component, and links with
      nothing. With fewer words than ``width`` the whole sequence is its one n-gram.
    * Rows that repeat a hash are notes of their own. A null hash is returned with the
      smallest hash of its component, or null, and is never kept. No notes give no rows.
    """
    bins = bands * rows
    texts = notes.select("hash", "note")
    scanned = cut_lineage(
        texts.select("hash", checksum().alias("sum"), "note")
        .mapInArrow(_sketched(width, bands, rows), "hash long, sum long, n long, sig long, keys array<long>, marks binary")
    )
    first = F.struct("hash", "sum")
    classes = cut_lineage(
        scanned.where("n > 0").groupBy("sig", "n")
        .agg(F.min("hash").alias("least"), F.min(first).alias("own"), F.first("keys").alias("keys"), F.first("marks").alias("marks"))
    )
    banded = classes.select("sig", "n", F.posexplode("keys").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    placed = members = cut_lineage(banded.join(shared, "key").select("key", "band", "sig", "n"))
    placed = placed.withColumn("root", F.col("sig"))
    sketches = cut_lineage(classes.join(members.select("sig").distinct(), "sig").select("sig", "keys", "marks"))

    def texts_of(sigs: DataFrame) -> DataFrame:
        """(sig, note) of the classes ``sigs`` names, one row each."""
        wanted = cut_lineage(sigs.join(classes, "sig").select("sig", F.col("own.hash").alias("_hash"), F.col("own.sum").alias("_sum")))
        found = texts.join(bounded_side(wanted), texts["hash"].eqNullSafe(F.col("_hash")) & (checksum() == F.col("_sum")))
        return found.groupBy("sig").agg(F.min("note").alias("note"))

    links = tested = None

    def regroup(found: DataFrame) -> DataFrame:
        nonlocal links
        links = found if links is None else links.unionByName(found)
        roots = components(links).select(F.col("node").alias("sig"), F.col("root").alias("r"))
        known = members.join(roots, "sig", "left").withColumn("root", F.coalesce("r", "sig")).drop("r")
        mixed = known.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        return cut_lineage(known.join(mixed, "key"))

    hub = F.min(F.struct("sig", "n", "root"))
    for _ in range(STAR_ROUNDS):
        stars = placed.groupBy("key").agg(hub.alias("h"))
        edges = (
            placed.join(stars, "key").where(F.col("root") != F.col("h.root"))
            .where(100 * F.least("n", "h.n") >= percent * F.greatest("n", "h.n"))
            .select(F.col("h.sig").alias("hub"), "sig").distinct()
        )
        if tested is not None:
            edges = edges.join(tested, ["hub", "sig"], "left_anti")
        marked = (
            edges.join(sketches.select("sig", "marks"), "sig")
            .join(sketches.select(F.col("sig").alias("hub"), F.col("marks").alias("hub_marks")), "hub")
            .select("hub", "sig", _alike(bins, percent)("marks", "hub_marks").alias("alike"))
        )
        edges = cut_lineage(marked)
        tested = edges.select("hub", "sig") if tested is None else tested.unionByName(edges.select("hub", "sig"))
        edges = edges.where("alike").select("hub", "sig")
        if edges.isEmpty():
            break
        # a hub's star is dealt over lanes, each with the hub's text, so that a hot hub is many groups
        lanes = edges.groupBy("hub").agg(F.ceil(F.count("*") / MEMBERS).alias("lanes"))
        dealt = edges.join(lanes, "hub").select("hub", "sig", F.pmod(F.xxhash64("sig"), "lanes").alias("lane"))
        heads = lanes.select("hub", F.col("hub").alias("sig"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("lanes") - 1)).alias("lane"))
        rows_ = heads.withColumn("role", F.lit(0)).unionByName(dealt.withColumn("role", F.lit(1)))
        rows_ = cut_lineage(rows_)
        found = (
            rows_.join(texts_of(rows_.select("sig").distinct()), "sig").select("hub", "lane", "role", "sig", "note")
            .repartition("hub", "lane").sortWithinPartitions("hub", "lane", "role")
            .mapInArrow(_confirm(width, percent), "a long, b long")
        )
        placed = regroup(cut_lineage(found))
        # the hubs of this round have met everyone in their buckets
        placed = cut_lineage(placed.join(stars.select("key", F.col("h.sig").alias("sig")), ["key", "sig"], "left_anti"))
    # what is apart after the stars: members of mixed buckets, in pairs of blocks
    # (within a bucket's largest component nothing is: its blocks meet those of the other members only)
    held = placed.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("root", F.struct("c", "root")).alias("big"), F.max("c").alias("most"), F.sum("c").alias("m")
    )
    blocks_of = lambda rows: F.ceil(rows / MEMBERS).cast("int")
    parts = held.select("key", "big", blocks_of(F.col("m") - F.col("most")).alias("few"), blocks_of(F.col("most")).alias("many")).where("few > 0")
    at, large = F.xxhash64("sig"), F.col("root") == F.col("big")
    cut = placed.join(parts, "key").withColumn(
        "side", F.when(large, F.col("few") + F.pmod(at, "many")).otherwise(F.pmod(at, "few")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.when(large, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1))
    met = cut.withColumn("o", other).select(
        "key", F.least("side", "o").alias("x"), F.greatest("side", "o").alias("y"), "side", "sig", "n", "root", "band"
    )
    group = ["key", "x", "y"]
    blocks = met.join(sketches, "sig")
    waiting = blocks.groupBy(*group).applyInArrow(_open_members(percent, bins), "key long, x int, y int, sig long")
    waiting = cut_lineage(waiting)
    rest = blocks.join(waiting, [*group, "sig"]).join(texts_of(waiting.select("sig").distinct()), "sig")
    found = cut_lineage(rest.groupBy(*group).applyInArrow(_compare_block(width, percent, bins), "a long, b long"))
    links = found if links is None else links.unionByName(found)

    roots = components(links)
    rooted = classes.select("sig", "n", "least").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    return scanned.select("hash", "n", "sig").join(rooted.join(smallest, "root").select("sig", "n", "component"), ["sig", "n"], "left").select(
        "hash", F.col("n").alias("n_shingles"), F.coalesce("component", "hash").alias("component_id"),
        F.coalesce(F.col("hash") == F.coalesce("component", "hash"), F.lit(False)).alias("kept"),
    )
