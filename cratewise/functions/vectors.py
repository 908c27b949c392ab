"""Vector columns (F1, F2, F24, F25, S4): Arrow UDFs that see a batch as one matrix."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def as_matrix(arr: pa.Array, dim: int | None = None) -> np.ndarray:
    """A list column as a float64 matrix; null or ragged rows are not allowed."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(arr) == 0:
        return flat.reshape(0, dim or 0)
    return flat.reshape(len(arr), -1)


def as_lists(matrix: np.ndarray) -> pa.Array:
    """The reverse of :func:`as_matrix`."""
    n, d = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * d, d if d else 1, dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))


def _split_nulls(arr: pa.Array):
    valid = np.asarray(arr.is_valid())
    return valid, (arr if valid.all() else arr.filter(pa.array(valid)))


def _scatter(valid: np.ndarray, matrix: np.ndarray) -> pa.Array:
    if valid.all():
        return as_lists(matrix)
    rows = iter(matrix)
    return pa.array([next(rows).tolist() if v else None for v in valid], pa.list_(pa.float64()))


def unit(vec: Column | str, eps: float | None = None) -> Column:
    """L2-normalised vector: ``x / (norm + eps)``, or a zero norm read as 1 (F2)."""

    @F.arrow_udf("array<double>")
    def _unit(v: pa.Array) -> pa.Array:
        valid, dense = _split_nulls(v)
        m = as_matrix(dense)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        norm = norm + eps if eps is not None else np.where(norm == 0, 1.0, norm)
        return _scatter(valid, m / norm)

    return _unit(vec)


def cosine_to(vec: Column | str, target: list[float]) -> Column:
    """Cosine of every row to one fixed vector; 0 when either norm is 0."""
    t = np.asarray(target, dtype=np.float64)
    t_norm = float(np.linalg.norm(t))

    @F.arrow_udf("double")
    def _cos(v: pa.Array) -> pa.Array:
        valid, dense = _split_nulls(v)
        m = as_matrix(dense, t.size)
        den = np.linalg.norm(m, axis=1) * t_norm
        sims = np.divide(m @ t, den, out=np.zeros(len(den)), where=den > 0)
        full = np.zeros(len(valid))
        full[valid] = sims
        return pa.array(full, mask=~valid)

    return _cos(vec)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns, as a plain expression (F1)."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
        F.lit(0.0), lambda acc, v: acc + v,
    )
    den = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(den == 0, F.lit(0.0)).otherwise(dot(a, b) / den)


def decode_blob(blob: Column | str) -> Column:
    """Little-endian float32 bytes to an array (S4), once at ingest."""

    @F.pandas_udf("array<float>")
    def _decode(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return _decode(blob)


def encode_blob(vec: Column | str) -> Column:
    """An array as little-endian float32 bytes, the stored form."""

    @F.pandas_udf("binary")
    def _encode(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return _encode(vec)


def array_sum(a: Column) -> Column:
    """Sum of a numeric array, left to right."""
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v.cast("double"))


def pearson(a: Column, b: Column, n: int = 12) -> Column:
    """Correlation of two ``n``-element arrays, 0 when either is constant."""
    ma, mb = array_sum(a) / n, array_sum(b) / n
    ca = F.transform(a, lambda v: v - ma)
    cb = F.transform(b, lambda v: v - mb)
    num = array_sum(F.zip_with(ca, cb, lambda x, y: x * y))
    den = F.sqrt(array_sum(F.transform(ca, lambda v: v * v)) * array_sum(F.transform(cb, lambda v: v * v)))
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def roll(a: Column, steps: Column | int, n: int = 12) -> Column:
    """Element ``i`` of the result is element ``(i - steps) mod n`` of the input."""
    s = F.pmod(F.lit(steps) if isinstance(steps, int) else steps, F.lit(n)).cast("int")
    return F.concat(F.slice(a, F.lit(n) - s + 1, s), F.slice(a, F.lit(1), F.lit(n) - s))


def gate(a: Column, floor: float = 0.2) -> Column:
    """Values below the gate become 0."""
    return F.transform(a, lambda v: F.when(v < floor, F.lit(0.0)).otherwise(v.cast("double")))
