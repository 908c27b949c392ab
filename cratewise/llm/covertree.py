"""Exact nearest tracks by inner product, with cover trees over both sides.

Tracks and queries are cut into blocks around common pivots; every block becomes a
cover tree. Two trees are walked together: a pair of nodes is left as soon as the
largest product that their centres and covering radii allow falls below the worst
k-th score among the node's queries. Blocks are nodes too, the ones above the trees:
pairs of blocks are ruled out the same way before their vectors are moved.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage

LEAF = 64
FEW = 16  # points that make a child of their own
SHRINK = 1.4
FANOUT = 16  # children of a node
HANDFUL = 16  # leaves that a leaf of queries meets at once


@dataclass
class Tree:
    """Points in tree order and nodes as arrays; ``kids[i]`` are the children of node i."""

    points: np.ndarray
    ids: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    norm: np.ndarray
    start: np.ndarray
    end: np.ndarray
    kids: list[np.ndarray]


def build_tree(points: np.ndarray, ids: np.ndarray) -> Tree:
    """A cover tree, level by level: a node's children lie around centres that are each the farthest point left.

    Such centres are a net: after any number of them, they are farther apart than what
    they leave uncovered. A node takes centres until they cover it within
    ``radius / SHRINK``, FANOUT at most; where points do not gather, the level shrinks
    less and there are more levels. Centres with fewer than FEW points share one child. A
    node of at most LEAF points, of equal points, or that does not part is a leaf.
    """
    order: list[np.ndarray] = []
    nodes: list[tuple] = []
    kids: list[list[int]] = []
    placed = 0

    def grow(index: np.ndarray) -> int:
        nonlocal placed
        at = points[index]
        mid = at[np.argmin(((at - at.mean(0)) ** 2).sum(1))]
        gap = np.sqrt(((at - mid) ** 2).sum(1))
        radius = float(gap.max())
        me, start = len(nodes), placed
        nodes.append(())
        kids.append([])
        if len(index) > LEAF and radius > 0:
            reach, nearest, owner, found = radius / SHRINK, gap.copy(), np.zeros(len(index), dtype=np.int64), 1
            while nearest.max() > reach and found < FANOUT:
                far = at[nearest.argmax()]
                other = np.sqrt(((at - far) ** 2).sum(1))
                closer = other < nearest
                owner[closer], nearest = found, np.minimum(nearest, other)
                found += 1
            sizes = np.bincount(owner, minlength=found)
            alone = np.flatnonzero(sizes >= FEW)
            rest = index[sizes[owner] < FEW]
            parts = [index[owner == k] for k in alone] + ([rest] if len(rest) else [])
            if len(parts) > 1:
                kids[me] = [grow(part) for part in parts]
        if not kids[me]:
            order.append(index)
            placed += len(index)
        nodes[me] = (mid, radius, start, placed)
        return me

    grow(np.arange(len(points)))
    into = np.concatenate(order)
    center = np.array([n[0] for n in nodes])
    return Tree(
        points[into], ids[into], center, np.array([n[1] for n in nodes]), np.sqrt((center**2).sum(1)),
        np.array([n[2] for n in nodes]), np.array([n[3] for n in nodes]), [np.array(k, dtype=np.int64) for k in kids],
    )


class Best:
    """The k best (score, id) of every query of a tree so far, ties to the smaller id."""

    def __init__(self, queries: Tree, k: int) -> None:
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.score = np.full((n, k), -np.inf)
        self.id = np.full((n, k), np.iinfo(np.int64).max)
        self.floor = -np.inf
        self.visited = self.left = 0  # pairs of nodes looked at, and left at once
        self.kth = np.full(n, -np.inf)

    def take(self, rows: slice, tree: Tree, cols: slice | np.ndarray) -> None:
        """Meet a run of queries with some points."""
        scores = self.q.points[rows] @ tree.points[cols].T
        scores[self.q.ids[rows][:, None] == tree.ids[cols][None, :]] = -np.inf
        good = scores >= self.kth[rows][:, None]
        good &= scores > -np.inf
        for i in np.flatnonzero(good.any(1)):
            r = rows.start + i
            pick = np.flatnonzero(good[i])
            s, d = np.append(self.score[r], scores[i, pick]), np.append(self.id[r], tree.ids[cols][pick])
            top = np.lexsort((d, -s))[: self.k]
            self.score[r], self.id[r] = s[top], d[top]
            self.kth[r] = max(self.floor, self.score[r, -1])

    def walk(self, tree: Tree) -> None:
        """Both trees together, most promising children first; a leaf of queries meets the leaves below a node in handfuls."""
        q, leaves = self.q, np.flatnonzero([not len(k) for k in tree.kids])
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            if not self._open(a, tree, np.array([b]))[0]:
                continue
            if len(tree.kids[b]) and not len(q.kids[a]):
                below = leaves[(tree.start[leaves] >= tree.start[b]) & (tree.end[leaves] <= tree.end[b])]
                bound = self._open(a, tree, below, True)[1]
                below, bound = below[np.argsort(-bound, kind="stable")], np.sort(bound)[::-1]
                for at in range(0, len(below), HANDFUL):
                    some = below[at : at + HANDFUL][bound[at : at + HANDFUL] >= self.kth[q.start[a] : q.end[a]].min()]
                    self.left += min(HANDFUL, len(below) - at) - len(some)
                    if len(some):
                        cols = np.concatenate([np.arange(tree.start[x], tree.end[x]) for x in some])
                        self.take(slice(q.start[a], q.end[a]), tree, cols)
            elif len(tree.kids[b]) and tree.radius[b] >= q.radius[a]:
                live, bound = self._open(a, tree, tree.kids[b], True)
                self.left += int((~live).sum())
                stack += [(a, int(x)) for x in tree.kids[b][live][np.argsort(bound[live])]]
            elif len(q.kids[a]):
                stack += [(int(x), b) for x in q.kids[a]]
            else:
                self.take(slice(q.start[a], q.end[a]), tree, slice(tree.start[b], tree.end[b]))

    def _open(self, a: int, tree: Tree, nodes: np.ndarray, bounds: bool = False):
        q = self.q
        bound = tree.center[nodes] @ q.center[a] + q.norm[a] * tree.radius[nodes] + (tree.norm[nodes] + tree.radius[nodes]) * q.radius[a]
        bound = bound + 1e-6 * (1 + np.abs(bound))
        live = bound >= self.kth[q.start[a] : q.end[a]].min()
        self.visited += len(live)
        self.left += 0 if bounds else int((~live).sum())
        return (live, bound) if bounds else live


def sound_vector(vector: Column) -> Column:
    """Neither null nor empty, no component null, NaN or infinite."""
    return F.coalesce(
        (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)
    )


def scaled(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def spread_pivots(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` points far from each other, each next one the farthest left: any prefix is a coarser cover."""
    if not len(sample):
        return sample
    picked = [int(np.argmin(((sample - sample.mean(0)) ** 2).sum(1)))]
    gap = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < most and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[picked[-1]]) ** 2).sum(1))
    return sample[picked]


def _nearest(pivots: dict[int, np.ndarray], first: int):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            cell = np.zeros(len(vectors), dtype=np.int32)
            sizes = np.diff(vectors.offsets.to_numpy())
            flat = vectors.flatten().to_numpy()
            starts = np.append(0, np.cumsum(sizes))
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                if dim in pivots:
                    x = flat[starts[rows][:, None] + np.arange(dim)]
                    p = pivots[dim][:first]
                    for at in range(0, len(rows), 2048):
                        part = x[at : at + 2048]
                        cell[rows[at : at + 2048]] = np.argmin((p**2).sum(1) - 2 * part @ p.T, axis=1)
            yield pa.array(cell)

    return F.arrow_udf(run, "int", F.ArrowUDFType.SCALAR_ITER)


_BLOCK = "dim int, cell int, part int, center array<double>, radius double, tree binary"


def _tree_of(table: pa.Table) -> pa.Table:
    dim = table.column("dim")[0].as_py()
    points = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
    tree = build_tree(points, table.column("hash").to_numpy())
    if np.abs(tree.points).max() < 1 << 15:
        tree.points = tree.points.astype(np.int16)
    return pa.table({
        "dim": pa.array([dim], pa.int32()), "cell": pa.array([table.column("cell")[0].as_py()], pa.int32()),
        "part": pa.array([table.column("part")[0].as_py()], pa.int32()), "center": pa.array([tree.center[0].tolist()], pa.list_(pa.float64())),
        "radius": pa.array([tree.radius[0]]), "tree": pa.array([pickle.dumps(vars(tree))], pa.binary()),
    })


def _blocks(vectors: DataFrame, pivots: dict[int, np.ndarray], first: int, size: int) -> DataFrame:
    """``vectors`` (hash, v) in cells around the pivots, cells in parts of about ``size``, a tree each."""
    celled = vectors.select("hash", "v", F.size("v").alias("dim"), _nearest(pivots, first)(F.col("v")).alias("cell"))
    celled = cut_lineage(celled)
    parts = celled.groupBy("dim", "cell").agg(F.ceil(F.count("*") / size).cast("int").alias("parts"))
    # at most `first` cells of each width of vector
    placed = celled.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("hash", "v"), "parts").cast("int"))
    return cut_lineage(placed.drop("parts").groupBy("dim", "cell", "part").applyInArrow(_tree_of, _BLOCK).withColumn("block", F.xxhash64("dim", "cell", "part")))


def _join_blocks(k: int):
    """Stream (queries, block) pairs, sorted by queries and then by bound; keep the best of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best = None, None

        def result() -> pa.RecordBatch:
            row, col = np.nonzero(best.score > -np.inf)
            top = best.score[row, col].clip(-(2.0**63), 2.0**63 - 1024)
            return pa.RecordBatch.from_pydict({
                "query": pa.array(best.q.ids[row]), "hash": pa.array(best.id[row, col]), "score": pa.array(top.astype(np.int64)),
                "floor": pa.array(np.full(len(row), best.kth.min())), "qblock": pa.array(np.full(len(row), key[0])),
            })

        for batch in batches:
            for i in range(batch.num_rows):
                now = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if now != key:
                    if best is not None:
                        yield result()
                    queries = _loaded(batch.column(2)[i].as_py())
                    key, best = now, Best(queries, k)
                    start = batch.column(5)[i].as_py()
                    best.floor = -np.inf if start is None else start
                    best.kth[:] = best.floor
                best.walk(_loaded(batch.column(3)[i].as_py()))
        if best is not None:
            yield result()

    return run


def _loaded(raw: bytes) -> Tree:
    tree = Tree(**pickle.loads(raw))
    tree.points = tree.points.astype(np.float64)
    return tree


def top_tracks(tracks: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, pivots: int = 32, block: int = 4096, sample: int = 4096) -> DataFrame:
    """(query, rank, hash, score): the ``k`` tracks with the largest inner product, for each query.

    ``tracks`` and ``queries`` are (hash, embedding), further columns ignored; ``hash``
    is an integer key. Components are taken as ``floor(scale * x)``; the score is the
    integer inner product, ties go to the smaller hash. A query is never its own answer:
    rows of its hash are left out. Fewer than ``k`` candidates are all returned.

    Pivots are picked from a sample of at most ``sample`` tracks; they decide how tight
    the blocks are, not the result. Blocks hold about ``block`` tracks. First each query
    block meets its two most promising track blocks; with the k-th scores reached there
    as a floor, only block pairs that can still matter are joined.

    * Vectors that are null, empty, or hold a null or non-finite component take no part
      on either side; vectors of different lengths never meet.
    * Rows that repeat a hash are candidates each; a hash that asks twice gets the ranks
      of both its vectors' answers together.
    * Empty tables and null hashes give no rows. Products are exact while they stay
      below 2**53 and are clipped to a long.
    """
    tracks, queries = (cut_lineage(
        x.select("hash", "embedding").where(F.col("hash").isNotNull() & sound_vector(F.col("embedding"))).select("hash", scaled(F.col("embedding"), scale).alias("v"))
    ) for x in (tracks, queries))
    seen = tracks.select("v", F.xxhash64("hash").alias("o")).orderBy("o").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for row in seen:
        by_dim.setdefault(len(row["v"]), []).append(row["v"])
    spots = {d: spread_pivots(np.array(v, dtype=float), pivots) for d, v in by_dim.items()}

    data = _blocks(tracks, spots, pivots, block)
    asked = _blocks(queries, spots, max(pivots // 4, 1), max(block // 8, 1))

    def norm(v: str) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))

    left = asked.select("dim", F.col("block").alias("qblock"), F.col("center").alias("qc"), F.col("radius").alias("qr"))
    right = data.select("dim", "block", F.col("center").alias("rc"), F.col("radius").alias("rr"))
    dot = F.aggregate(F.zip_with("qc", "rc", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    bound = dot + norm("qc") * F.col("rr") + norm("rc") * F.col("qr") + F.col("qr") * F.col("rr")
    pairs = cut_lineage(left.join(right, "dim").select("qblock", "block", bound.alias("bound")).withColumn(
        "turn", F.row_number().over(Window.partitionBy("qblock").orderBy(F.desc("bound"), "block"))
    ))

    def met(chosen: DataFrame, lanes: int) -> DataFrame:
        full = (
            chosen.join(asked.select(F.col("block").alias("qblock"), F.col("tree").alias("qtree")), "qblock")
            .join(data.select("block", "tree"), "block")
            .select("qblock", F.pmod("block", F.lit(lanes)).cast("int").alias("lane"), "qtree", "tree", "bound", "floor")
        )
        return full.repartition("qblock", "lane").sortWithinPartitions("qblock", "lane", F.desc("bound")).mapInArrow(
            _join_blocks(k), "query long, hash long, score long, floor double, qblock long"
        )

    near = cut_lineage(met(pairs.where("turn <= 2").withColumn("floor", F.lit(None).cast("double")), 1))
    # a block whose queries have not all found k tracks has no floor yet
    floors = near.groupBy("qblock").agg(F.min("floor").alias("floor"))
    rest = pairs.where("turn > 2").join(floors, "qblock", "left").where(
        F.col("floor").isNull() | (F.col("bound") + 1e-6 * (1 + F.abs("bound")) >= F.col("floor"))
    )
    found = near.unionByName(met(rest, 4)).select("query", "hash", "score")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "hash"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "hash", "score")
