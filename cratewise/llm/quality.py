"""A quality classifier for notes: histogram gradient-boosted trees over text statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.guards import cut_lineage
from .blocks import ALNUM, LOWER, Fingerprints, mix, pieces, runs

FEATURES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "symbols", "shouts", "beyond_ascii", "lines", "blanks",
    "sentences", "commas", "distinct_words", "distinct_pairs", "echoes", "top_word", "short_words", "long_words", "repeated_lines",
    "capitals", "bars",
)


def _bytes_in(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


PIECE = 1 << 17  # bytes looked at together: temporaries are some 75 times as large, in every Python worker of an executor
_UPPER = _bytes_in(bytes(range(65, 91)))
_LETTER = _bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _bytes_in(b"0123456789")
_BLANK = _bytes_in(b" \t\n\r\x0b\x0c")
_MARK = _bytes_in(bytes(x for x in range(33, 127) if not chr(x).isalnum()))
_SYMBOL = _bytes_in(b"*#%&$@^~<>{}[]=_\\/+|`")


def _distinct(row: np.ndarray, names: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different names, and how often the commonest stands."""
    if not len(names):
        return np.zeros(rows), np.zeros(rows)
    key = np.sort((row.astype(np.uint64) << np.uint64(44)) | (names >> np.uint64(20)))
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of = (key[first] >> np.uint64(44)).astype(np.int64)
    size = np.diff(np.append(first, len(key)))
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    most = np.zeros(rows)
    most[of[start]] = np.maximum.reduceat(size, start)
    return np.bincount(of, minlength=rows).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text, all from its bytes; an empty or null text has zeros."""
    out = []
    for _, raw, off in pieces(texts, PIECE):
        rows = len(off) - 1
        n = np.maximum(np.diff(off), 1).astype(float)

        def share(mask: np.ndarray, by=n, off=off) -> np.ndarray:
            total = np.append(0, np.cumsum(mask))
            return (total[off[1:]] - total[off[:-1]]) / by

        buf = LOWER[raw]
        starts, ends = runs(ALNUM[buf], off)
        at = np.searchsorted(starts, off)
        count = np.diff(at)
        w = np.maximum(count, 1).astype(float)
        row = np.repeat(np.arange(rows), count)
        prints = Fingerprints(buf)
        names = prints.of(starts, ends)
        size = ends - starts
        kinds, top = _distinct(row, names, rows)
        near = row[1:] == row[:-1] if len(row) else np.zeros(0, dtype=bool)
        pairs = mix(names[:-1] * np.uint64(3) + names[1:])[near] if len(names) else names
        pair_kinds, _ = _distinct(row[1:][near] if len(row) else row, pairs, rows)
        echo = np.bincount(row[1:][near & (names[1:] == names[:-1])], minlength=rows) if len(row) else np.zeros(rows)
        ls, le = runs(raw != 10, off)
        lrow = np.searchsorted(off, ls, side="right") - 1
        lines = np.bincount(lrow, minlength=rows)
        line_kinds, _ = _distinct(lrow, prints.of(ls, le), rows)

        def by_word(mask: np.ndarray, row=row, rows=rows, w=w) -> np.ndarray:
            return np.bincount(row[mask], minlength=rows) / w

        letters = share(_LETTER[raw])
        out.append(np.column_stack([
            np.log1p(np.diff(off)), np.log1p(count), np.bincount(row, weights=size, minlength=rows) / w,
            share(_UPPER[raw]) / np.maximum(letters, 1e-9), share(_DIGIT[raw]), share(_MARK[raw]), share(_SYMBOL[raw]), share(raw == 33),
            share(raw >= 128), share(raw == 10), share(_BLANK[raw]), share((raw == 46) | (raw == 63), w), share(raw == 44, w),
            kinds / w, pair_kinds / np.maximum(count - 1, 1), echo / w, top / w, by_word(size == 1), by_word(size > 20),
            (lines - line_kinds) / np.maximum(lines, 1), by_word(_UPPER[raw][starts]), share(raw == 124, w),
        ]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass(frozen=True)
class Forest:
    """Boosted trees as arrays: every tree is complete, node i has children 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray  # trees x inner nodes; beyond it goes right
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for every row of ``x``, all rows stepping down together."""
        total = np.full(len(x), self.base)
        each = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(int(np.log2(inner + 1))):
                node = 2 * node + 1 + (x[each, feature[node]] > bound[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: float = 8.0, ridge: float = 1.0) -> Forest:
    """Fit a :class:`Forest` to labels 0 and 1 by second-order boosting over histograms.

    With no rows the score is 0.5, with one label it is near that label.
    """
    inner, leaves = 2**depth - 1, 2**depth
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    feature, bound, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    if not len(y) or y.min() == y.max():
        return Forest(base, feature, bound, leaf)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    total = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            width, start = 2**level, 2**level - 1
            best = np.full(width, 1e-6)
            local = node - start
            for f, e in enumerate(edges):
                key = local * bins + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=width * bins).reshape(width, bins)
                hs = np.bincount(key, weights=h, minlength=width * bins).reshape(width, bins)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least * 0.1) | (ha - hl < least * 0.1)] = 0
                gain = gain[:, : len(e)]
                if gain.shape[1]:
                    at = gain.argmax(1)
                    better = gain[np.arange(width), at] > best
                    best = np.where(better, gain[np.arange(width), at], best)
                    feature[t, start : start + width][better] = f
                    bound[t, start : start + width][better] = e[at][better]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t][node]] > bound[t][node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + ridge)
        total += leaf[t][at]
    return Forest(base, feature, bound, leaf)


def held_out(key: Column) -> Column:
    """Whether a note's label is kept for testing: by its key alone."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _stats_udf():
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(list(statistics(texts)), pa.list_(pa.float64()))

    return F.arrow_udf(run, "array<double>", F.ArrowUDFType.SCALAR_ITER)


def train_quality(notes: DataFrame, grades: DataFrame, most: int = 20_000) -> Forest:
    """Fit the classifier to ``notes`` (hash, note) that ``grades`` (hash, keep) marks 0 or 1.

    Only grades whose key is not :func:`held_out` are seen. At most ``most`` of them are
    used, those least by a hash of the key: a documented bound, so the fit costs the same
    for any library. Of several notes with one key the one least by a hash is learnt from.
    Null keys, null grades and grades without a note are left out.
    """
    picked = cut_lineage(
        grades.where(F.col("keep").isin(0, 1) & F.col("hash").isNotNull() & ~held_out(F.col("hash")))
        .groupBy("hash").agg(F.max("keep").alias("keep")).orderBy(F.xxhash64("hash"), "hash").limit(most)
    )
    texts = notes.select("hash", "note").join(F.broadcast(picked), "hash")  # at most `most` rows
    rows = texts.select("hash", F.col("keep").cast("int").alias("keep"), _stats_udf()(F.coalesce("note", F.lit(""))).alias("x"), F.xxhash64("hash", "note").alias("k"))
    one = F.min(F.struct("k", "keep", "x")).alias("r")
    rows = sorted((r["r"] for r in rows.groupBy("hash").agg(one).collect()), key=lambda r: r["k"])  # at most `most`
    return boost(np.array([r["x"] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([r["keep"] for r in rows], dtype=float))


def graded_notes(notes: DataFrame, forest: Forest) -> DataFrame:
    """``notes`` with ``score``, from 0 to 1, and ``predicted``, 1 if the score is 0.5 or more.

    ``notes`` is (hash, note), the free text kept with a track, and any further columns,
    all returned but ``score`` and ``predicted``, which are replaced; only the note decides.

    * A null note scores as an empty one. Rows that repeat score alike.
    * An empty table gives no rows. Statistics are those of the whole text.
    """
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(forest.score(statistics(texts)))

    score = F.arrow_udf(run, "double", F.ArrowUDFType.SCALAR_ITER)
    return notes.withColumn("score", score(F.coalesce("note", F.lit("")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
