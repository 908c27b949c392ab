"""Hard negatives for training genre heads, scored by Kronecker-packed products.

The components of several tracks, biased to be positive, stand in separate fields of one
wide integer. One product with an anchor's component moves all of them on, the sum over
the components holds every track's inner product in its field, and unpacking gives exact
integers.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage

WORD_BITS = 53  # a double holds integers of so many bits exactly, and matrix products of doubles are fast
WIDE_FIELDS = 16  # fields of a Python integer, where components are too large for a double
ANCHORS = 4096  # of a group that one task keeps in memory
PANEL = 256  # anchors multiplied at once
BLOCK = 4096  # tracks of a block
LANE = 256 * BLOCK  # tracks that one task streams at most, about
LARGEST = 1 << 55  # of a component; products then fit a decimal(38, 0)


@dataclass(frozen=True)
class Layout:
    """Fields of a word: their width in bits, their number, what is added to a component."""

    width: int
    fields: int
    bias: int

    @classmethod
    def of(cls, largest: int, longest: int) -> Layout:
        """For components of at most ``largest`` and anchors of at most ``longest`` in sum of magnitudes.

        A field holds a signed sum of at most ``longest * 2 * largest``.
        """
        width = max(int(longest) * 2 * int(largest), 1).bit_length() + 1
        fields = WORD_BITS // width
        return cls(width, fields if fields > 1 else WIDE_FIELDS, int(largest))

    @property
    def wide(self) -> bool:
        return self.width * self.fields > WORD_BITS

    def pack(self, tracks: np.ndarray) -> np.ndarray:
        """(words, dim): the rows of ``tracks``, field by field; rows that fill the last words are zero."""
        words = -(-len(tracks) // self.fields)
        kind = object if self.wide else np.int64
        rows = np.zeros((words * self.fields, tracks.shape[1]), dtype=kind)
        rows[: len(tracks)] = tracks
        fields = (rows + self.bias).reshape(self.fields, words, -1)
        out = fields[0]
        for i in range(1, self.fields):
            out = out + fields[i] * (1 << (self.width * i))
        return out if self.wide else out.astype(np.float64)

    def products(self, anchors: np.ndarray, words: np.ndarray, count: int) -> np.ndarray:
        """(anchors, count): exact inner products of anchors with the packed tracks."""
        kind = object if self.wide else np.int64
        sums = anchors.dot(words.T) if self.wide else (anchors.astype(np.float64) @ words.T).astype(np.int64)
        half = 1 << (self.width - 1)
        sums = sums + sum(half << (self.width * i) for i in range(self.fields))
        shift = anchors.sum(axis=1).astype(kind)[:, None] * self.bias + half
        full = (1 << self.width) - 1
        return np.concatenate([((sums >> (self.width * i)) & full) - shift for i in range(self.fields)], axis=1)[:, :count]


@dataclass
class Block:
    """Tracks in the order of their hashes, with genre codes of this block, packed."""

    ids: np.ndarray
    codes: np.ndarray
    genres: list
    words: np.ndarray


def _packed_blocks(layout: Layout):
    """(hash, genre, v) of tracks of any widths to blocks of one width each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes = batch.column(0).to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            starts = np.append(0, np.cumsum(sizes))
            flat = np.array(batch.column(2).flatten().to_pylist(), dtype=object) if layout.wide else batch.column(2).flatten().to_numpy().astype(np.int64)
            genres = np.array(batch.column(1).to_pylist(), dtype=object)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                rows = rows[np.argsort(ids[rows], kind="stable")]
                for at in range(0, len(rows), BLOCK):
                    part = rows[at : at + BLOCK]
                    names, codes = np.unique(genres[part].astype(str), return_inverse=True)
                    vectors = flat[starts[part][:, None] + np.arange(dim)]
                    block = Block(ids[part], codes, names.tolist(), layout.pack(vectors))
                    yield pa.RecordBatch.from_pydict({
                        "dim": pa.array([int(dim)], pa.int32()), "number": pa.array([hash((int(ids[part[0]]), int(ids[part[-1]]), len(part))) & ((1 << 62) - 1)], pa.int64()),
                        "body": pa.array([pickle.dumps(vars(block))], pa.binary()),
                    })

    return run


class Shortlist:
    """The best ``k`` (score, hash) of every slot so far, ties to the smaller hash."""

    def __init__(self, slots: int, k: int, wide: bool) -> None:
        self.k = k
        self.kind = object if wide else np.int64
        self.score = np.zeros((slots, k), dtype=self.kind)
        self.id = np.zeros((slots, k), dtype=np.int64)
        self.held = np.zeros(slots, dtype=np.int64)

    def take(self, slots: np.ndarray, scores: np.ndarray, good: np.ndarray, ids: np.ndarray) -> None:
        """Meet candidates: (slots, tracks) scores and which of them count."""
        full = self.held[slots] == self.k
        good = good & (~full[:, None] | (scores >= self.score[slots, -1][:, None]))
        for r in np.flatnonzero(good.any(axis=1)):
            s, pick = slots[r], np.flatnonzero(good[r])
            score = scores[r, pick]
            if len(pick) > self.k:
                worst = np.partition(score, len(score) - self.k)[len(score) - self.k]
                above, level = np.flatnonzero(score > worst), np.flatnonzero(score == worst)
                top = np.append(above, level[: self.k - len(above)])  # tracks stand in the order of their hashes
                pick, score = pick[top], score[top]
            n = self.held[s]
            score, found = np.append(self.score[s, :n], score), np.append(self.id[s, :n], ids[pick])
            order = sorted(range(len(score)), key=lambda i: (-score[i], found[i]))[: self.k]
            self.held[s] = len(order)
            self.score[s, : len(order)], self.id[s, : len(order)] = score[order], found[order]


def _meet(layout: Layout, k: int, low: int):
    """Stream rows sorted by (group, lane, role): a group's anchors, then blocks of tracks.

    Without ceilings an anchor has one slot, for tracks of its genre. With them it has a
    slot per positive, for tracks of other genres within the positive's window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = asked = best = None

        def result() -> pa.RecordBatch:
            slot, col = np.nonzero(np.arange(k)[None, :] < best.held[:, None])
            scores = best.score[slot, col]
            return pa.RecordBatch.from_pydict({
                "anchor": pa.array(np.asarray(asked["row"])[slot], pa.int64()), "hash": pa.array(best.id[slot, col], pa.int64()), "score": pa.array(list(map(Decimal, scores.tolist())), pa.decimal128(38)) if layout.wide else pa.array(scores, pa.int64()),
                "slot": pa.array(np.asarray(asked["slot"])[slot], pa.int32()),
            })

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                body = pickle.loads(batch.column(3)[i].as_py())
                if batch.column(2)[i].as_py() == 0:
                    if best is not None:
                        yield result()
                    now, asked, best = key, body, Shortlist(len(body["row"]), k, layout.wide)
                elif key == now:
                    _score_block(layout, asked, Block(**body), best, low)
        if best is not None:
            yield result()

    return run


def _score_block(layout: Layout, asked: dict, block: Block, best: Shortlist, low: int) -> None:
    code = {g: i for i, g in enumerate(block.genres)}
    own = np.array([code.get(g, -1) for g in asked["genre"]])
    for at in range(0, len(asked["hash"]), PANEL):
        part = slice(at, at + PANEL)
        scores = layout.products(asked["v"][part], block.words, len(block.ids))
        same = own[part][:, None] == block.codes[None, :]
        if asked["ceiling"] is None:
            good = same & (asked["hash"][part][:, None] != block.ids[None, :])
            best.take(np.arange(at, at + len(scores)), scores, good, block.ids)
            continue
        slots = np.flatnonzero((asked["of"] >= at) & (asked["of"] < at + PANEL))
        for s in range(0, len(slots), PANEL):
            some = slots[s : s + PANEL]
            ours, top = scores[asked["of"][some] - at], asked["ceiling"][some][:, None]
            good = ~same[asked["of"][some] - at] & (ours <= top) & (100 * ours >= low * top)
            best.take(some, ours, good, block.ids)


def _anchor_group(wide: bool):
    """(group, row, hash, genre, v, positives) of a group to one row with its anchors."""

    def run(table: pa.Table) -> pa.Table:
        kind = object if wide else np.int64
        rows = table.to_pydict()
        v = np.array(rows["v"], dtype=kind).reshape(len(rows["row"]), -1)
        asked = {"hash": np.array(rows["hash"], dtype=np.int64), "genre": rows["genre"], "v": v, "row": rows["row"], "slot": [0] * len(v), "ceiling": None}
        if "positives" in rows:
            flat = [(i, p["slot"], int(p["score"])) for i, ps in enumerate(rows["positives"]) for p in ps]
            asked |= {"of": np.array([f[0] for f in flat], dtype=np.int64), "slot": [f[1] for f in flat], "ceiling": np.array([f[2] for f in flat], dtype=kind),
                      "row": [rows["row"][f[0]] for f in flat]}
        return pa.table({"group": table.column("group")[:1], "body": pa.array([pickle.dumps(asked)], pa.binary())})

    return run


def sound_vector(vector: Column) -> Column:
    """Neither null nor empty, no component null, NaN or infinite."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def hard_negatives(
    tracks: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256, group: int = ANCHORS,
) -> DataFrame:
    """(anchor, positive, rank, negative, positive_score, negative_score): what nearly passes for a track's genre.

    ``tracks`` and ``anchors`` are (hash, genre, embedding), further columns ignored;
    ``hash`` is an integer key, ``genre`` a training label of any simple type. Components
    are taken as ``floor(scale * x)``, a score is the integer inner product with the
    anchor, ties go to the smaller hash. An anchor's positives are its ``positives`` best
    other tracks of its genre. Of the tracks of other genres with
    ``low * positive_score <= 100 * negative_score <= 100 * positive_score`` the best
    ``negatives`` follow each positive, ranked from 1.

    The anchors stand in groups of about ``group`` in memory and blocks of packed tracks
    stream past them, one lane of blocks per task; a lane keeps the best few of each
    anchor. A second pass does the same with the positives' scores as bounds. The cost is
    anchors times tracks, as the search is exact; no pair leaves a task but those kept.

    * Rows with a null hash, genre or vector, an empty vector, or a null or non-finite
      component take no part. Vectors of different lengths never meet.
    * Rows that repeat a hash are tracks each, never answers of that hash. An anchor that
      is given twice is answered once; one hash with two vectors or genres is two anchors.
    * An anchor without positives, or a positive without tracks in its window, gives no
      rows. Empty tables give none.
    * Components are clipped to 2**55 either way; products are exact, and clipped to a long at the end.
    """
    def ready(df: DataFrame) -> DataFrame:
        sound = df.where(F.col("hash").isNotNull() & F.col("genre").isNotNull() & sound_vector(F.col("embedding")))
        v = F.transform("embedding", lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LARGEST)), F.lit(-LARGEST)))
        return sound.select(F.col("hash").cast("long").alias("hash"), F.col("genre").cast("string").alias("genre"), v.alias("v"))

    def size_of(column: str) -> Column:
        return F.aggregate(column, F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + F.abs(x.cast("decimal(20,0)"))).cast("decimal(38,0)"))

    def as_long(score: str) -> Column:
        ends = [F.lit(x).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
        return F.greatest(F.least(F.col(score).cast("decimal(38,0)"), ends[1]), ends[0]).cast("long").alias(score)

    pool = ready(tracks)
    asked = cut_lineage(ready(anchors).distinct().withColumn("row", F.xxhash64("hash", "genre", "v")))
    largest, total = pool.agg(F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))), F.count("*")).first()
    longest, count = asked.agg(F.max(size_of("v")), F.count("*")).first()
    layout = Layout.of(largest or 0, longest or 0)
    blocks = cut_lineage(pool.mapInArrow(_packed_blocks(layout), "dim int, number long, body binary"))
    parts = max(-(-count // group), 1)
    # lanes of a group: enough tasks for the cluster, none of them longer than a bound
    busy = min(-(-total // BLOCK), -(-4 * tracks.sparkSession.sparkContext.defaultParallelism // parts))
    lanes = int(max(busy, -(-total // LANE), 1))
    asked = asked.withColumn("dim", F.size("v")).withColumn("group", F.concat_ws("-", "dim", F.pmod("row", F.lit(parts))))

    def meet(rows: DataFrame, k: int) -> DataFrame:
        sides = cut_lineage(rows.groupBy("group").applyInArrow(_anchor_group(layout.wide), "group string, body binary"))
        names = rows.select("dim", "group").distinct()
        heads = sides.select("group", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("role"), "body")
        panels = blocks.join(names, "dim").select("group", F.pmod("number", F.lit(lanes)).cast("int").alias("lane"), F.lit(1).alias("role"), "body")
        found = (
            heads.unionByName(panels).repartition("group", "lane").sortWithinPartitions("group", "lane", "role")
            .mapInArrow(_meet(layout, k, low), f"anchor long, hash long, score {'decimal(38,0)' if layout.wide else 'long'}, slot int")
        )
        place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "hash"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    good = cut_lineage(meet(asked, positives))
    held = good.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("slot"), "hash", "score"))).alias("positives"))
    second = asked.join(held.withColumnRenamed("anchor", "row"), "row")
    bad = meet(second, negatives)
    names = asked.select(F.col("row").alias("anchor"), F.col("hash").alias("name"))
    return (
        bad.withColumnsRenamed({"hash": "negative", "score": "negative_score"})
        .join(good.select("anchor", F.col("rank").alias("slot"), F.col("hash").alias("positive"), F.col("score").alias("positive_score")), ["anchor", "slot"])
        .join(names, "anchor")
        .select(F.col("name").alias("anchor"), "positive", "rank", "negative", as_long("positive_score"), as_long("negative_score"))
    )
