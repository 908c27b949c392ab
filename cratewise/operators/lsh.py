"""Approximate neighbours by signed random projections.

The signs of a vector's products with random directions are its key in a band. Every
vector is filed under its key of each band; a query asks its own key and those next to it
in order of margin, the keys that differ where its products are smallest. What is filed
there is compared exactly, in groups of asked vectors.

How many bits, bands and keys are worth it depends on the data alone: a bounded sample
is compared with everything, and the cheapest choice that finds SAMPLE_RECALL of its
neighbours is taken. Tight clusters need few keys, data without clusters most of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage
from .grouped import ASKED, GROUP_BYTES, GROUPS, STORED, Group, streamed

MOST_BANDS = 4
MOST_BITS = 20
ALL_KEYS = 6  # up to so many bits every key can be asked, beyond it those with at most two bits turned
BUCKET = 256  # vectors that a bucket is meant to hold
BLOCK = 1024
RANGE_BITS = 12
MOST_SENT = 1 << 14
SAMPLE = 256
SAMPLE_RECALL = 0.95


@dataclass(frozen=True)
class Keys:
    """Directions of the bands, and the sets of bits that a query turns."""

    planes: np.ndarray  # (bands, bits, dim)
    masks: np.ndarray  # (masks, bits) of 0 and 1

    @classmethod
    def draw(cls, bands: int, bits: int, dim: int, seed: int) -> Keys:
        planes = np.random.default_rng([seed, bits]).normal(size=(bands, bits, dim))
        most = bits if bits <= ALL_KEYS else 2
        turned = [c for n in range(most + 1) for c in combinations(range(bits), n)]
        masks = np.zeros((len(turned), bits))
        for row, at in zip(masks, turned, strict=True):
            row[list(at)] = 1
        return cls(planes, masks)

    def of(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, bands) keys and (rows, bands, bits) margins."""
        products = np.einsum("nd,bkd->nbk", units, self.planes)
        weights = 1 << np.arange(self.planes.shape[1], dtype=np.int64)
        return (products > 0) @ weights, products**2

    def asked(self, units: np.ndarray, probes: int) -> np.ndarray:
        """(rows, bands, probes) keys in the order of what is turned; the first is the own one."""
        keys, margins = self.of(units)
        cost = margins @ self.masks.T
        order = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        flips = (self.masks @ (1 << np.arange(self.masks.shape[1]))).astype(np.int64)
        return keys[:, :, None] ^ flips[order]


@dataclass(frozen=True)
class Plan:
    bits: int
    bands: int
    probes: int
    seed: int

    def keys(self, dim: int) -> Keys:
        return Keys.draw(self.bands, self.bits, dim, self.seed)


def choose(asked: np.ndarray, found: np.ndarray, owner: np.ndarray, most_bits: int, seed: int) -> Plan:
    """The cheapest plan that finds SAMPLE_RECALL of the neighbours ``found`` of ``asked[owner]``."""
    dim, best = asked.shape[1], None
    for bits in range(4, max(most_bits, 4) + 1):
        keys = Keys.draw(MOST_BANDS, bits, dim, seed)
        theirs = keys.of(found)[0]
        order = keys.asked(asked, len(keys.masks))
        hit = order[owner] == theirs[:, :, None]
        place = np.where(hit.any(axis=2), hit.argmax(axis=2), len(keys.masks))
        for bands in range(1, MOST_BANDS + 1):
            need = np.sort(place[:, :bands].min(axis=1))[math.ceil(SAMPLE_RECALL * len(place)) - 1] + 1
            if need <= len(keys.masks):
                cost = bands * need / 2**bits
                if best is None or cost < best[0]:
                    best = (cost, Plan(bits, bands, int(need), seed))
    return best[1]


def _sampled(reps: DataFrame, k: int, most_bits: int, seed: int) -> Plan:
    """:func:`choose` on a sample of at most SAMPLE vectors, compared with all."""
    from .knn import _top

    rows = reps.orderBy(F.xxhash64(F.lit(13), "vid"), "vid").limit(SAMPLE).select("unit").collect()
    asked = np.array([r["unit"] for r in rows], dtype=np.float64)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                units = np.stack(pdf["unit"].to_numpy())
                sims = asked @ units.T
                qi, ci = _top(sims, k)
                yield pd.DataFrame({"q": qi.astype(np.int32), "sim": sims[qi, ci], "unit": list(units[ci])})

    hits = reps.select("unit").mapInPandas(nearest, "q int, sim double, unit array<double>")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "unit"))
    near = hits.withColumn("n", place).where(F.col("n") <= k).select("q", "unit").collect()  # at most SAMPLE * k rows
    return choose(asked, np.array([r["unit"] for r in near]), np.array([r["q"] for r in near]), most_bits, seed)


def _cells(plan: Plan, dim: int):
    """Arrow-batched column of (own, asked): bucket numbers of all bands."""
    keys = plan.keys(dim)
    base = np.arange(plan.bands, dtype=np.int64) << 40

    @F.pandas_udf("struct<own:array<bigint>,asked:array<bigint>>")
    def cells(units: pd.Series) -> pd.DataFrame:
        m = np.stack(units.to_numpy()) if len(units) else np.zeros((0, dim))
        own = keys.of(m)[0] + base
        asked = keys.asked(m, plan.probes) + base[None, :, None]
        return pd.DataFrame({"own": list(own), "asked": list(asked.reshape(len(m), -1))})

    return cells


def _key_group(plan: Plan, dim: int) -> type[Group]:
    """Groups whose asked vectors each want the cells of their own keys."""

    class KeyGroup(Group):
        repeats = True  # bands may find a pair more than once
        cells = None

        def asking(self, cell: int) -> np.ndarray:
            if self.cells is None:
                keys, base = plan.keys(dim), np.arange(plan.bands, dtype=np.int64)[None, :, None] << 40
                parts = [keys.asked(self.units[i : i + BLOCK], plan.probes) + base for i in range(0, len(self.units), BLOCK)]
                flat = np.concatenate([part.ravel() for part in parts])
                order = np.argsort(flat, kind="stable")
                self.cells, self.rows = flat[order], (order // (plan.bands * plan.probes)).astype(np.int32)
            return self.rows[np.searchsorted(self.cells, cell) : np.searchsorted(self.cells, cell, side="right")]

    return KeyGroup


def _dealt(filed: DataFrame, n: int, plan: Plan, dim: int) -> tuple[DataFrame, int]:
    """``filed`` with its ``group``: vectors of near numbers of own keys in the first band, about equally many in each."""
    each = 8 * dim + 16 * plan.bands * plan.probes
    groups = max(1, min(GROUPS, math.ceil(n / BLOCK)), math.ceil(n * each / GROUP_BYTES))
    coarse = F.shiftright(F.col("own")[0], max(0, plan.bits - RANGE_BITS)).alias("coarse")
    sizes = sorted(map(tuple, filed.groupBy(coarse).count().collect()))  # at most 2 ** RANGE_BITS rows
    starts, at = [], 0
    for key, size in sizes:
        starts.append((key, size, at))
        at += size
    begin = F.broadcast(filed.sparkSession.createDataFrame(starts, "coarse long, size long, start long"))
    place = F.col("start") + F.pmod(F.xxhash64(F.lit(17), "vid"), "size")
    group = F.floor(place * groups / max(at, 1)).cast("int").alias("group")
    return filed.select("*", coarse).join(begin, "coarse").select("vid", "keys", "unit", "own", group), groups


def lsh_vectors(reps: DataFrame, n: int, dim: int, k: int, seed: int = 5, plan: Plan | None = None) -> DataFrame:
    """(vid, neighbour, sim, n): near keys of every distinct vector (vid, keys, unit), its own included, the k best found.

    Asked vectors are dealt to groups (see :mod:`grouped`); a stored vector is sent once to each group that asks its cell.
    """
    from .knn import _best

    reps = cut_lineage(reps)
    if reps.isEmpty():
        plan = plan or Plan(4, 1, 1, seed)
    plan = plan or _sampled(reps, k, min(MOST_BITS, math.ceil(math.log2(max(n / BUCKET, 1))) + 4), seed)
    cells = _cells(plan, dim)
    filed, groups = _dealt(cut_lineage(reps.withColumn("own", cells("unit")["own"])), n, plan, dim)

    def wanted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, base = plan.keys(dim), np.arange(plan.bands, dtype=np.int64)[None, :, None] << 40
        for pdf in batches:
            for group, rows in pdf.groupby("group").indices.items():
                for i in range(0, len(rows), BLOCK):
                    asked = keys.asked(np.stack(pdf["unit"].to_numpy()[rows[i : i + BLOCK]]), plan.probes) + base
                    yield pd.DataFrame({"cell": np.unique(asked)}).assign(group=group)[["group", "cell"]]

    wants = filed.select("group", "unit").mapInPandas(wanted, "group int, cell long").groupBy("cell").agg(F.collect_set("group").alias("groups"))
    few = plan.bands << plan.bits <= MOST_SENT  # rows of wants
    stored = filed.select(F.explode("own").alias("at"), "keys", "unit").join(F.broadcast(wants) if few else wants, F.col("at") == F.col("cell"))
    kind = reps.schema["keys"].dataType.elementType
    none = lambda what: F.lit(None).cast(what)
    rows = filed.select("group", F.lit(ASKED).alias("side"), F.lit(0).cast("long").alias("at"), "vid", none(reps.schema["keys"].dataType).alias("keys"), "unit")
    rows = rows.unionByName(stored.select(F.explode("groups").alias("group"), F.lit(STORED).alias("side"), "at", none("string").alias("vid"), "keys", "unit"))
    return _best(streamed(rows, groups, k, kind, _key_group(plan, dim)), k)


def compared_share(reps: DataFrame, dim: int, plan: Plan) -> float:
    """The share of all pairs of distinct vectors that ``plan`` compares, repeats counted."""
    at = reps.select(_cells(plan, dim)("unit").alias("at"))
    own = at.select(F.explode("at.own").alias("cell")).groupBy("cell").agg(F.count("*").alias("c"))
    asked = at.select(F.explode("at.asked").alias("cell")).groupBy("cell").agg(F.count("*").alias("q"))
    n = reps.count()
    met = own.join(asked, "cell").agg(F.sum(F.col("c") * F.col("q"))).first()[0] or 0
    return met / max(n * n, 1)
