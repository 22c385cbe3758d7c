"""Whitening of vectors by an incremental eigendecomposition.

The covariance is that of the distinct vectors, centred by their exact mean. Every task keeps a spectrum (eigenvalues and
orthonormal eigenvectors) and adds its vectors by rank-one updates: the eigenvalues of D + z z' are the roots of a secular
equation, found between the old ones after deflation, and the eigenvectors are rotated. The tasks' spectra are combined in
a tree, each as a succession of rank-one updates. What is left of rounding, or of the truncation of spectra that are wider
than ``RANK``, is removed by Rayleigh-Ritz steps over the whole data: one pass multiplies the covariance with the basis,
and the small projected problem is solved on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.storage import stored

#: Directions that a spectrum keeps; vectors of at most so many dimensions are decomposed in full.
RANK = 128
#: Spectra that one task combines.
FAN = 16
#: Rayleigh-Ritz steps at most, and the residual (as a share of the largest eigenvalue) that ends them.
REFINEMENTS, RESIDUAL = 200, 1e-13
#: Components whose eigenvalue is below this share of the trace count as null directions.
NULL_SHARE = 1e-12
SCALE = 256


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eigenvalues of diag(d) + z z' and their distances to the d (a row for each root).

    ``d`` ascends strictly and no ``z`` is 0. Root i lies between d[i] and d[i + 1], the last below d[-1] + z'z. It is sought
    as an offset from the nearer pole, so that differences to the poles keep their digits.
    """
    m, z2 = len(d), z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    rows = np.arange(m)
    middle = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(1)
    # the function rises from -inf to inf between poles: below zero in the middle means a root in the upper half
    near = np.where((middle < 0) & (rows < m - 1), rows + 1, rows)
    delta = d[None, :] - d[near][:, None]
    low = np.where(near == rows, 0.0, -gap / 2)
    high = np.where(near == rows, np.where(rows == m - 1, gap, gap / 2), 0.0)
    at = (low + high) / 2
    inside = rows[None, :] <= rows[:, None]
    left_gap, right_gap = d - d[near], upper - d[near]
    for _ in range(100):
        off = delta - at[:, None]
        part = z2 / off
        slope = part / off
        f = 1 + part.sum(1)
        # a value that is all rounding
        done = np.abs(f) <= 2 * np.finfo(float).eps * (1 + np.abs(part).sum(1))
        if done.all():
            break
        low, high = np.where(f < 0, at, low), np.where(f < 0, high, at)
        # fit a pole on each side that agrees in value and slope, and solve for its root
        a, b = left_gap - at, right_gap - at
        s_left, s_right = (slope * inside).sum(1), (slope * ~inside).sum(1)
        c = f - a * s_left - b * s_right
        p = a + b
        q = a * b
        lin = p * f - q * (s_left + s_right)
        root = lin * lin - 4 * q * f * c
        root = np.sqrt(np.maximum(root, 0))
        with np.errstate(all="ignore"):
            step = np.where(lin <= 0, (lin - root) / (2 * c), 2 * q * f / (lin + root))
        new = at + step
        wrong = ~np.isfinite(new) | (new <= low) | (new >= high)
        new = np.where(wrong, (low + high) / 2, new)
        if (done | (new == at) | (high - low <= 4e-16 * np.maximum(np.abs(low), np.abs(high)))).all():
            break
        at = np.where(done, at, new)
    return d[near] + at, delta - at[:, None]


def rank_one(values: np.ndarray, basis: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and orthonormal eigenvectors (columns) of ``basis diag(values) basis' + x x'``.

    ``basis`` may hold fewer columns than dimensions; the part of ``x`` outside its span becomes one more column.
    """
    size = float(x @ x)
    if size == 0:
        return values, basis
    z = basis.T @ x
    if basis.shape[1] < len(x):
        rest = x - basis @ z
        rest -= basis @ (basis.T @ rest)
        height = np.linalg.norm(rest)
        if height > 1e-12 * np.sqrt(size):
            values, basis, z = np.append(0.0, values), np.column_stack([rest / height, basis]), np.append(height, z)
    order = np.argsort(values, kind="stable")
    values, z = values[order], z[order]
    basis = basis[:, order]
    tolerance = 8 * np.finfo(float).eps * max(abs(values[-1]), np.abs(z).max())
    live = np.abs(z) > tolerance / max(1.0, np.sqrt(size)) if size > 1 else np.abs(z) > tolerance
    kept = np.flatnonzero(live)
    # equal eigenvalues: a rotation moves the weight of the earlier one to the later one
    close = kept[:-1][np.diff(values[kept]) <= tolerance]
    if len(close):
        following = dict(zip(kept[:-1].tolist(), kept[1:].tolist()))
        basis = basis.copy()
        for i in close.tolist():
            j = following[i]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            basis[:, [i, j]] = np.column_stack([c * basis[:, i] - s * basis[:, j], s * basis[:, i] + c * basis[:, j]])
            z[i], z[j] = 0.0, r
            live[i] = False
        kept = np.flatnonzero(live)
    if not len(kept):
        return values, basis
    d = values[kept]
    roots, off = secular_roots(d, z[kept])
    # the z for which these roots are exact, so that the vectors are orthogonal to the last digit
    m = len(d)
    ratio = -off / np.where(np.eye(m, dtype=bool), 1.0, d[:, None] - d[None, :])
    exact = np.sqrt(np.abs(np.prod(ratio, axis=0))) if m > 1 else np.sqrt(np.abs(off[0]))
    exact = np.copysign(exact, z[kept])
    vectors = exact[None, :] / off
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    new_values = values.copy()
    new_values[kept] = roots
    new_basis = basis.copy()
    new_basis[:, kept] = basis[:, kept] @ vectors.T
    return new_values, new_basis


class Spectrum:
    """Eigenvalues and eigenvectors of a growing sum of x x', with at most ``rank`` of them."""

    def __init__(self, d: int, rank: int):
        self.rank = rank
        self.values, self.basis = np.zeros(0), np.zeros((d, 0))

    def add(self, x: np.ndarray) -> None:
        if self.basis.shape[1]:
            self.values, self.basis = rank_one(self.values, self.basis, x)
        elif size := np.linalg.norm(x):
            self.values, self.basis = np.array([size**2]), (x / size)[:, None]
        if len(self.values) > self.rank:
            keep = np.argsort(self.values)[-self.rank :]
            self.values, self.basis = self.values[keep], self.basis[:, keep]

    def weighted(self) -> np.ndarray:
        """Rows whose x x' add up to this spectrum."""
        return (self.basis * np.sqrt(np.maximum(self.values, 0))).T


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


_ROWS = "v binary"


def _packed(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(rows, np.float64).tobytes()], pa.binary())], names=["v"])


def _unpacked(batch: pa.RecordBatch, width: int) -> Iterator[np.ndarray]:
    for v in batch.column(0):
        yield np.frombuffer(v.as_py()).reshape(-1, width)


def spectrum(vectors: DataFrame, mean: np.ndarray, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (descending) and eigenvectors (columns) of the sum of (x - mean)(x - mean)' over ``(x)``."""
    d = len(mean)

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(d, rank)
        for batch in batches:
            for x in _matrix(batch.column(0), d) - mean:
                own.add(x)
        if len(own.values):
            yield _packed(own.weighted())

    def of_spectra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Spectrum(d, rank)
        for batch in batches:
            for rows in _unpacked(batch, d):
                for x in rows[::-1]:
                    own.add(x)
        if len(own.values):
            yield _packed(own.weighted())

    parts = stored(vectors.mapInArrow(of_part, _ROWS))
    n = parts.count()
    while n > 1:
        n = -(-n // FAN)
        parts = stored(parts.repartition(n).mapInArrow(of_spectra, _ROWS))
        n = min(n, parts.count())
    row = parts.first()  # one spectrum, of at most rank vectors
    rows = np.frombuffer(row.v).reshape(-1, d) if row else np.zeros((0, d))
    values = (rows**2).sum(1)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] > 0]
    return values[order], (rows[order] / np.sqrt(values[order])[:, None]).T


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of equally large arrays, one per task, in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py()).reshape(shape)
        yield _packed(total)

    total = np.zeros(shape)
    for row in parts.repartition(FAN).mapInArrow(run, _ROWS).toLocalIterator():
        total += np.frombuffer(row.v).reshape(shape)
    return total


def covariance_times(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """The covariance times ``basis``, and its trace, by one pass over ``(x)``."""
    d, k = basis.shape
    shared = vectors.sparkSession.sparkContext.broadcast((mean, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        total = np.zeros((d + 1, k))
        for batch in batches:
            x = _matrix(batch.column(0), d) - mean
            total[:d] += x.T @ (x @ basis)
            total[d, 0] += (x * x).sum()
        yield _packed(total)

    total = _summed(vectors.mapInArrow(run, _ROWS), (d + 1, k)) / n
    return total[:d], float(total[d, 0])


def refine(vectors: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``most`` leading eigenvalues and eigenvectors of the covariance, and its trace, by Rayleigh-Ritz steps from ``basis``.

    A basis of the whole space is right after one step, and the next one only confirms it; a narrower one goes on as a
    subspace iteration until the leading residuals are within rounding.
    """
    last = np.inf
    for _ in range(REFINEMENTS):
        basis = np.linalg.qr(basis)[0]
        image, trace = covariance_times(vectors, mean, basis, n)
        projected = basis.T @ image
        values, turn = np.linalg.eigh((projected + projected.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        basis, image = basis @ turn, image @ turn
        residual = np.linalg.norm(image - basis * values, axis=0)[:most].max(initial=0.0)
        if residual <= RESIDUAL * max(values[0], 1e-300) or basis.shape[0] == basis.shape[1] and residual >= last:
            break
        last = residual
        if basis.shape[0] > basis.shape[1]:
            basis = image
    return values[:most], basis[:, :most], trace


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", most: int = 4, rank: int = RANK) -> DataFrame:
    """``(id_col, component, n, deviation, whitened, explained, identity_error)``, one row per vector and component up to ``most``.

    Entries c become x = floor(256 c). Rows whose vector is null, empty, or holds a null or non-finite entry or one whose x
    is no exact double (from 2^53 on) are left out, and so are vectors of another length than the commonest (the longest of
    equally common ones). The fit takes each distinct x once. Repeated rows have a row each. Null directions (rank below
    ``most``, one distinct vector) have no component. ``deviation`` is null where it does not fit a long. A null id is kept.
    Empty tables give no rows; other columns are not read.
    """
    schema = T.StructType(
        [vectors.schema[id_col]]
        + [T.StructField(c, t) for c, t in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()))]
        + [T.StructField(c, T.DoubleType()) for c in ("whitened", "explained", "identity_error")]
    )
    spark = vectors.sparkSession
    scaled = F.transform(F.col(vector), lambda c: F.floor(F.lit(SCALE) * c.cast("double")))
    fits = F.forall(vector, lambda c: F.coalesce(F.abs(F.lit(SCALE) * c.cast("double")) < float(1 << 53), F.lit(False)))
    fine = vectors.select(F.col(id_col), F.col(vector)).where(F.coalesce(fits, F.lit(False)) & (F.size(vector) > 0))
    every = stored(fine.select(F.col(id_col), scaled.alias("x")))
    common = every.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common.d
    rows = every.where(F.size("x") == d)
    distinct = stored(rows.select("x").distinct())
    entries = distinct.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    sums = {r.i: (r.s, r.n) for r in entries.toLocalIterator()}  # d rows
    n = sums[0][1]
    total = [sums[i][0] for i in range(d)]
    # the whole part apart, so that the mean keeps its digits however large the sums are
    mean = np.array([s // n + (s % n) / n for s in total])
    floats = distinct.select(F.col("x").cast("array<double>").alias("x"))
    _, basis = spectrum(floats, mean, min(d, rank))
    if not basis.shape[1]:
        return spark.createDataFrame([], schema)
    values, basis, trace = refine(floats, mean, basis, n, most)
    found = int((values > NULL_SHARE * trace).sum())
    values, basis = values[:found], basis[:, :found]
    scale = basis / np.sqrt(values)
    spread = covariance_of(floats, mean, scale, n)
    error = float(np.abs(spread - np.eye(found)).max())
    shared = spark.sparkContext.broadcast((total, mean, scale, values / trace))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, mean, scale, explained = shared.value
        for batch in batches:
            m = batch.num_rows
            x = _matrix(batch.column(1), d)
            white = (x - mean) @ scale
            deviation = pa.array(_deviation(x, n, total), pa.int64())
            again = pa.array(np.repeat(np.arange(m), found))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(again),
                    pa.array(np.tile(np.arange(1, found + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * found, n)),
                    deviation.take(again),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * found, error)),
                ],
                names=schema.fieldNames(),
            )

    return rows.mapInArrow(run, schema)


def covariance_of(vectors: DataFrame, mean: np.ndarray, scale: np.ndarray, n: int) -> np.ndarray:
    """The covariance of ``(x - mean) @ scale`` over ``(x)``, itself centred, by one pass."""
    d, k = scale.shape
    shared = vectors.sparkSession.sparkContext.broadcast((mean, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale = shared.value
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = (_matrix(batch.column(0), d) - mean) @ scale
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield _packed(total)

    total = _summed(vectors.mapInArrow(run, _ROWS), (k + 1, k)) / n
    return total[:k] - np.outer(total[k], total[k])


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of each row; in Python's integers where a long might overflow."""
    x = x.astype(np.int64)
    if not len(x):
        return []
    reach = max(abs(n * int(x.max())), abs(n * int(x.min()))) + max(abs(s) for s in total)
    if reach * reach * x.shape[1] < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(1).tolist()
    exact = (sum((n * v - s) ** 2 for v, s in zip(row, total)) for row in x.tolist())
    return [v if v < 1 << 63 else None for v in exact]
