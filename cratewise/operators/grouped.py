"""Exact k best of many asked vectors over the cells they want, with little data moved.

Blocks of asked vectors are dealt to groups. A group is one task: it holds its asked
vectors and their k best so far, and the rows of every cell that one of its blocks wants
stream through it, once a group. What is moved is the stored rows times the number of
groups, GROUPS as long as a group stays within GROUP_BYTES, and k rows per asked vector;
hits of single blocks never leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions import vectors as V

GROUPS = 24
GROUP_BYTES = 32 * 1024 * 1024
PIECE = 2 * 1024 * 1024  # products looked at together
_SLACK = 1e-9
ASKED, WANTS, STORED = 0, 1, 2


def top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column indices of each row's k largest entries; ties go to the lower column."""
    if sims.shape[1] <= k:
        return np.nonzero(np.ones_like(sims, dtype=bool))
    floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, -k][:, None]
    above, level = sims > floor, sims == floor
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (level & (np.cumsum(level, axis=1) <= room)))


class Group:
    """The asked vectors of one group and the k best keys of each so far."""

    repeats = False  # whether a key may be met in several cells

    def __init__(self, k: int):
        self.k, self.vids, self.parts, self.ends, self.wants = k, [], [], {}, {}
        self.units, self.floor, self.new = None, None, 0
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def take(self, side: int, at: int, rows: pa.RecordBatch) -> None:
        if side == ASKED:
            begin = self.ends.get(at, (len(self.vids),))[0]
            self.vids += rows.column("vid").to_pylist()
            self.parts.append(V.as_matrix(rows.column("unit")))
            self.ends[at] = (begin, len(self.vids))
        elif side == WANTS:
            for wanted in rows.column("wants").to_pylist():
                self.wants.setdefault(at, []).extend(wanted)
        elif self.vids:
            if self.units is None:
                self.units, self.parts = np.concatenate(self.parts), []
                self.floor = np.full(len(self.units), -np.inf)
            self.compare(self.asking(at), V.as_matrix(rows.column("unit")), rows.column("keys"))

    def asking(self, cell: int) -> np.ndarray:
        """Numbers of the asked vectors that want ``cell``."""
        return np.concatenate([np.arange(*self.ends[w]) for w in self.wants[cell]])

    def compare(self, asked: np.ndarray, stored: np.ndarray, keys: pa.ListArray) -> None:
        flat, ends = keys.flatten().to_numpy(zero_copy_only=False), np.cumsum(keys.value_lengths().to_numpy())
        step = max(1, PIECE // len(stored))
        for i in range(0, len(asked), step):
            rows = asked[i : i + step]
            sims = self.units[rows] @ stored.T
            live = sims.max(axis=1) >= self.floor[rows] - _SLACK
            if not live.any():
                continue
            rows, sims = rows[live], sims[live]
            qi, ci = top(sims, self.k)
            near = sims[qi, ci] >= self.floor[rows[qi]] - _SLACK
            q, c = rows[qi[near]], ci[near]
            exact = np.einsum("ij,ij->i", self.units[q], stored[c])
            first = np.concatenate([[0], ends[:-1]])
            times = (ends - first)[c]
            at = np.repeat(first[c], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            self.hits.append((np.repeat(q, times), np.repeat(exact, times), flat[at]))
            self.new += len(at)
            if self.new >= max(len(self.units), 4096) * self.k:
                self.compact()

    def compact(self) -> None:
        """Keep each asked vector's k best keys, ties to the smaller one."""
        q, sim, key = (np.concatenate(part) for part in zip(*self.hits, strict=True))
        rank = np.unique(key, return_inverse=True)[1] if key.dtype == object else key
        if self.repeats:
            order = np.lexsort((-sim, rank, q))
            first = np.append(True, (q[order][1:] != q[order][:-1]) | (rank[order][1:] != rank[order][:-1]))
            q, sim, key, rank = q[order][first], sim[order][first], key[order][first], rank[order][first]
        order = np.lexsort((rank, -sim, q))
        q, sim, key = q[order], sim[order], key[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = sim[last]
        self.hits, self.new = [(q[kept], sim[kept], key[kept])], 0

    def best(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.hits:
            self.compact()
            q, sim, key = self.hits[0]
            vids = np.asarray(self.vids, dtype=object)
            for a in range(0, len(q), 50_000):
                cut = slice(a, a + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(vids[q[cut]], pa.string()), pa.array(key[cut], schema.field("neighbour").type), pa.array(sim[cut])], schema=schema
                )


def best_of_cells(asked: DataFrame, pairs: DataFrame, stored: DataFrame, blocks: int, block_rows: int, dim: int, k: int, kind: DataType) -> DataFrame:
    """(vid, neighbour, sim): the ``k`` best keys of each asked vector over the cells its block wants.

    ``asked`` is (ord, vid, unit) with ``ord`` a block's number below ``blocks``, ``pairs`` distinct
    (ord, cell), ``stored`` (cell, keys, unit) with ``keys`` sorted and of type ``kind``.
    """
    per = max(1, min(GROUP_BYTES // (8 * dim * block_rows), math.ceil(blocks / GROUPS)))
    groups = max(1, math.ceil(blocks / per))
    group = F.floor(F.col("ord") / per).cast("int").alias("group")
    wants = pairs.select(group, "ord", F.col("cell").cast("int").alias("cell")).groupBy("group", "cell").agg(F.collect_list("ord").alias("wants"))
    targets = wants.groupBy("cell").agg(F.collect_list("group").alias("groups"))  # at most one row per cell
    none = lambda what: F.lit(None).cast(what)
    keys, unit = f"array<{kind.simpleString()}>", "array<double>"
    rows = asked.select(group, F.lit(ASKED).alias("side"), F.col("ord").cast("long").alias("at"), "vid", none(keys).alias("keys"), "unit", none("array<bigint>").alias("wants"))
    rows = rows.unionByName(wants.select(
        "group", F.lit(WANTS).alias("side"), F.col("cell").cast("long").alias("at"), none("string").alias("vid"), none(keys).alias("keys"),
        none(unit).alias("unit"), F.col("wants").cast("array<bigint>").alias("wants"),
    )).unionByName(stored.join(F.broadcast(targets), "cell").select(
        F.explode("groups").alias("group"), F.lit(STORED).alias("side"), F.col("cell").cast("long").alias("at"), none("string").alias("vid"),
        "keys", "unit", none("array<bigint>").alias("wants"),
    ))
    return streamed(rows, groups, k, kind, Group)


def streamed(rows: DataFrame, groups: int, k: int, kind: DataType, make: type[Group]) -> DataFrame:
    """(vid, neighbour, sim) of ``rows`` (group, side, at, vid, keys, unit, wants): each group through one ``make(k)``."""
    schema = pa.schema([("vid", pa.string()), ("neighbour", to_arrow_type(kind)), ("sim", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("group", "side", "at")], axis=1)
            edges = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges], [*edges, len(marks)], strict=True):
                if marks[a, 0] != at:
                    if held:
                        yield from held.best(schema)
                    at, held = marks[a, 0], make(k)
                held.take(int(marks[a, 1]), int(marks[a, 2]), batch.slice(a, b - a))
        if held:
            yield from held.best(schema)

    # one group a task; rows of a cell by key, so that ties inside a batch go to the smaller one
    dealt = rows.repartitionById(groups, "group").sortWithinPartitions("group", "side", "at", F.col("keys")[0])
    return dealt.mapInArrow(run, f"vid string, neighbour {kind.simpleString()}, sim double")
