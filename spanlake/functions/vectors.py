"""Vector expressions. Small ones are array functions; products with a matrix run as NumPy blocks on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from spanlake.functions.arrays import list_column, list_parts, matrix, vectors_column
from spanlake.schemas import CODE


def doubles(v: Column) -> Column:
    """The vector in double precision, which all arithmetic uses."""
    return v.cast("array<double>")


def norm(v: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(doubles(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column, floor: float = 1e-8) -> Column:
    """The vector scaled to norm 1; norms below ``floor`` count as ``floor``."""
    length = F.greatest(norm(v), F.lit(floor))
    return F.transform(doubles(v), lambda x: x / length)


def _row_by_row(a: Column, b: Column, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Column:
    """One number per row from two vector columns, computed on whole batches; null where either is null."""

    @F.arrow_udf("double")
    def number(x: pa.Array, y: pa.Array) -> pa.Array:
        both = pc.and_(x.is_valid(), y.is_valid())
        out = np.zeros(len(x))
        mask = both.to_numpy(zero_copy_only=False)
        out[mask] = kernel(matrix(x.filter(both)), matrix(y.filter(both))) if mask.any() else 0.0
        return pa.array(out, mask=~mask)

    return number(a, b)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vector columns."""
    return _row_by_row(a, b, lambda x, y: np.einsum("ij,ij->i", x, y))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two vector columns."""
    return _row_by_row(a, b, lambda x, y: ((x - y) ** 2).sum(axis=1))


def max_abs_diff(a: Column, b: Column) -> Column:
    """Largest absolute difference over the dimensions."""
    return _row_by_row(a, b, lambda x, y: np.abs(x - y).max(axis=1))


def shifted(spark: SparkSession, v: Column, origin: Sequence[float]) -> Column:
    """The vector minus one fixed vector."""
    shared = spark.sparkContext.broadcast(np.asarray(origin, dtype=np.float64))

    @F.arrow_udf("array<double>")
    def minus(x: pa.Array) -> pa.Array:
        return vectors_column(matrix(x, len(shared.value)) - shared.value)

    return minus(v)


def squared_distance_to(spark: SparkSession, v: Column, origin: Sequence[float]) -> Column:
    """Squared Euclidean distance to one fixed vector."""
    shared = spark.sparkContext.broadcast(np.asarray(origin, dtype=np.float64))

    @F.arrow_udf("double")
    def distance(x: pa.Array) -> pa.Array:
        return pa.array(((matrix(x, len(shared.value)) - shared.value) ** 2).sum(axis=1))

    return distance(v)


def largest(z: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` largest positive entries per row, in descending order, and how many there are.

    Equal values go to the lower column. Entries that do not fire come last, as column -1 with value 0.
    """
    n, width = z.shape
    k = min(k, width)
    z = np.where(z > 0, z, 0.0)
    if width > 4 * k + 64:
        # keep all entries above the k-th value and, from the left, as many equal to it as still fit
        kth = np.partition(z, width - k, axis=1)[:, width - k, None]
        equal = z == kth
        room = k - (z > kth).sum(axis=1, keepdims=True)
        chosen = (z > kth) | (equal & (np.cumsum(equal, axis=1) <= room))
        ids = np.nonzero(chosen)[1].reshape(n, k)
    else:
        ids = np.broadcast_to(np.arange(width), (n, width))
    values = np.take_along_axis(z, ids, axis=1)
    order = np.argsort(-values, axis=1, kind="stable")[:, :k]
    values = np.take_along_axis(values, order, axis=1)
    return np.where(values > 0, np.take_along_axis(ids, order, axis=1), -1), values


def codes_column(ids: np.ndarray, values: np.ndarray) -> pa.Array:
    """Sparse codes as a list of (latent_id, strength), firing entries only."""
    fires = ids >= 0
    bounds = np.concatenate([[0], np.cumsum(fires.sum(axis=1))])
    entries = pa.StructArray.from_arrays(
        [pa.array(ids[fires].astype(np.int32)), pa.array(values[fires])], ["latent_id", "strength"]
    )
    return list_column(entries, bounds)


def gathered(column: pa.Array, w: np.ndarray, first: int = 0) -> np.ndarray:
    """Sum of ``strength · w[latent]`` over the entries of each code; only the firing rows of ``w`` are touched."""
    entries, bounds = list_parts(column)
    latent = entries.field("latent_id").to_numpy(zero_copy_only=False) - first
    strength = entries.field("strength").to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), np.diff(bounds))
    here = (latent >= 0) & (latent < len(w))
    total = np.zeros((len(column), w.shape[1]))
    np.add.at(total, row[here], strength[here, None] * w[latent[here]])
    return total


def dense(ids: np.ndarray, values: np.ndarray, width: int) -> np.ndarray:
    """Codes from :func:`largest` as full rows."""
    z = np.zeros((len(ids), width + 1))  # the last column takes what does not fire
    np.put_along_axis(z, np.where(ids >= 0, ids, width), values, axis=1)
    return z[:, :width]


def row_blocks(n: int, width: int, max_bytes: int = 64 << 20) -> list[slice]:
    """Row ranges whose products with ``width`` columns stay below ``max_bytes``."""
    step = max(1, max_bytes // (8 * max(width, 1)))
    return [slice(a, a + step) for a in range(0, n, step)]


def project(spark: SparkSession, v: Column, weights: np.ndarray, bias: np.ndarray, shift: np.ndarray) -> Column:
    """``(v - shift) · weightsᵀ + bias`` as an array of doubles, one entry per row of ``weights``."""
    shared = spark.sparkContext.broadcast((weights.T.copy(), bias, shift))

    @F.arrow_udf("array<double>")
    def product(x: pa.Array) -> pa.Array:
        w, b, c = shared.value
        return vectors_column((matrix(x, w.shape[0]) - c) @ w + b)

    return product(v)


def top_codes(
    spark: SparkSession, v: Column, weights: np.ndarray, bias: np.ndarray, shift: np.ndarray, k: int, first: int = 0
) -> Column:
    """The ``k`` largest positive entries of :func:`project` as a sparse code; latent ids start at ``first``."""
    shared = spark.sparkContext.broadcast((weights.T.copy(), bias, shift))

    @F.arrow_udf(CODE)
    def code(x: pa.Array) -> pa.Array:
        w, b, c = shared.value
        rows = matrix(x, w.shape[0]) - c
        parts = [largest(rows[at] @ w + b, k) for at in row_blocks(len(rows), w.shape[1])]
        if not parts:
            return codes_column(np.zeros((0, k), np.int64), np.zeros((0, k)))
        ids, values = (np.vstack(v) for v in zip(*parts))
        return codes_column(np.where(ids >= 0, ids + first, ids), values)

    return code(v)


def rebuild(spark: SparkSession, code: Column, w_dec: np.ndarray, b_dec: np.ndarray, first: int = 0) -> Column:
    """The vector that a sparse code stands for, as far as the latents from ``first`` on that ``w_dec`` holds."""
    shared = spark.sparkContext.broadcast((w_dec, b_dec))

    @F.arrow_udf("array<double>")
    def vector(z: pa.Array) -> pa.Array:
        w, b = shared.value
        return vectors_column(gathered(z, w, first) + b)

    return vector(code)
