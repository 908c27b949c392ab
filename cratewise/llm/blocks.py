"""Helpers the operators share: numpy kernels over UTF-8 bytes, and size-checked joins.

A column of texts is handled as the bytes it already is in Arrow: one buffer and the
offsets of its rows, cut into pieces of a few megabytes so that the temporaries of a
task stay small whatever a batch holds. A single longer text is a piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE_BYTES = 1 << 20

# Fixed odd multipliers of the fingerprints; any odd numbers would do.
_BASE = 0x9E3779B97F4A7C15
_MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX_2 = np.uint64(0x94D049BB133111EB)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of a word: lower-case letters, digits and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

# Bytes of a word when only blank characters part words.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_1
    x = (x ^ (x >> np.uint64(27))) * _MIX_2
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown when a longer text comes."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Fingerprints:
    """Fingerprints of any byte range of a buffer, from one pass of prefix sums."""

    def __init__(self, buf: np.ndarray) -> None:
        up, self.down = _POWERS.of(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, size: int) -> np.ndarray:
        """Of the ``size`` bytes from every position on."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)


def fold(ids: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of twice the reach: of each pair (``ids[i]``, ``ids[i + offset]``)."""
    n = max(len(ids) - offset, 0)
    return mix(ids[:n] * np.uint64(0xD6E8FEB86659FD93) + ids[offset:])


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null is empty. Without nulls no byte is copied."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not len(arr):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if arr.null_count:
        arr = arr.fill_null("")
    _, offsets, data = arr.buffers()
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    off = np.frombuffer(offsets, dtype=width, count=len(arr) + 1 + arr.offset)[arr.offset :].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return buf, off


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row."""
    buf, off = packed(texts)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield slice(i, j), buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross rows."""
    if not len(mask):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    before, after = np.empty_like(mask), np.empty_like(mask)
    before[0] = after[-1] = False
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[off[off < len(mask)]] = False
    after[off[off > 0] - 1] = False
    return np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def tsum(column: Column | str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


# Rows of a side that is shipped whole to every executor; its count is taken first.
BROADCAST_ROWS = 500_000


def bounded_side(df: DataFrame, limit: int = BROADCAST_ROWS, items: Column | None = None) -> DataFrame:
    """``df`` marked for broadcasting if it has at most ``limit`` rows, else as it is.

    Give it narrow tables only (keys, flags), read from a written table. With an array
    column, ``items`` is its size, and rows and items together are held to the limit.
    """
    if items is None:
        small = df.limit(limit + 1).count() <= limit
    else:
        small = df.agg(F.count("*") + tsum(items)).first()[0] <= limit
    return F.broadcast(df) if small else df
