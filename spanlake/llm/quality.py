"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.blocks import Block, blocks, byte_class, xxh64
from spanlake.llm.storage import stored

#: Fixed parameters of a fit: Fourier features, ridge weight (as a share of the rows), seed, bins of the calibration.
FEATURES, RIDGE, SEED, BINS = 256, 1e-4, 7, 2048
#: Tasks that add up the partial sums before the driver does.
ADDERS = 16

WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
UPPER, DIGIT = byte_class((0x41, 0x5A)), byte_class((0x30, 0x39))
LETTER = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
SIGNS = ("!?", ".,;:", "#$%&*|@^~<>=+\\{}[]_`", "\n", " \t\r")


def statistics_of(block: Block) -> np.ndarray:
    """A row of statistics per text: sizes, shares of kinds of bytes and words, repetition, entropy. Empty texts give zeros."""
    n = len(block)
    size = block.end - block.start
    text = np.repeat(np.arange(n), size + 1)
    counts = np.bincount(text * 256 + block.data[:-8], minlength=n * 256).reshape(n, 256)
    counts[:, 10] -= 1
    per_byte = 1 / np.maximum(size, 1)
    out = [np.log1p(size), counts[:, UPPER].sum(1) * per_byte, counts[:, DIGIT].sum(1) * per_byte, counts[:, 128:].sum(1) * per_byte]
    out += [counts[:, np.frombuffer(s.encode(), np.uint8)].sum(1) * per_byte for s in SIGNS]
    share = counts * per_byte[:, None]
    out.append(-(share * np.log2(np.where(share > 0, share, 1))).sum(1))
    start, end = block.runs(WORD)
    bounds = block.of_text(start)
    of = np.repeat(np.arange(n), np.diff(bounds))
    n_words = np.diff(bounds)
    per_word = 1 / np.maximum(n_words, 1)
    mean = lambda v: np.bincount(of, v, n) * per_word
    length = (end - start).astype(float)
    hashes = xxh64(block.data, start, end)
    first = np.unique(hashes ^ (of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
    again = lambda d: mean(np.append(np.zeros(min(d, len(of))), (hashes[d:] == hashes[:-d]) & (of[d:] == of[:-d])))
    head, tail = block.data[start], block.data[np.maximum(end - 1, 0)]
    length_mean = mean(length)
    out += [
        np.log1p(n_words),
        length_mean,
        np.sqrt(np.maximum(mean(length**2) - length_mean**2, 0)),
        np.bincount(of[first], minlength=n) * per_word,
        again(1),
        again(2),
        mean(length <= 3),
        mean(UPPER[head]),
        mean(~LETTER[head]),
        mean(~LETTER[tail]),
        mean(UPPER[head] & UPPER[block.data[np.minimum(start + 1, end - 1)]]) if len(of) else np.zeros(n),
    ]
    return np.column_stack(out).astype(float)


def with_statistics(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, x)``: the statistics of every whole text."""
    source = docs.select(id_col, F.col(text).cast("string").alias("text"))
    schema = T.StructType([docs.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(1)):
                x = statistics_of(block)
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=[id_col, "x"])

    return source.mapInArrow(run, schema)


@dataclass
class Model:
    """What a fit gives; ``weights`` is None when there was no labelled row, and every score is then 0.5."""

    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def fourier(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of a Gaussian kernel whose width is the root of twice the number of statistics, and a constant."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / np.sqrt(2 * x.shape[1]), (x.shape[1], FEATURES))
        shift = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + shift), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), 0.5)
        return np.interp(self.fourier(x) @ self.weights, self.knots, self.values)


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """The non-decreasing share of good rows per bin that fits best (pool adjacent violators)."""
    pools: list[list[float]] = []
    for rows, hits in zip(n, good):
        pools.append([hits, rows, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            hits, rows, bins = pools.pop()
            pools[-1] = [pools[-1][0] + hits, pools[-1][1] + rows, pools[-1][2] + bins]
    return np.concatenate([np.full(bins, hits / rows) for hits, rows, bins in pools])


def _arrays(batch: pa.RecordBatch, column: int) -> np.ndarray:
    lists = batch.column(column)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of rows that each hold an array of ``size`` numbers, in two levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for v in batch.column(0):
                total += np.frombuffer(v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    total = np.zeros(size)
    for row in parts.repartition(ADDERS).mapInArrow(run, "v binary").toLocalIterator():
        total += np.frombuffer(row.v)
    return total


def fit(rows: DataFrame) -> Model:
    """A model from ``(x, y, fold)``: statistics, label from 0 to 1, 0 or 1 for the half. All rows count.

    The scores that the calibration sees come from the other half's weights. One class only, or a handful of rows, give a
    flat curve; no row gives the score 0.5.
    """
    rows = stored(rows.select("x", "y", "fold"))
    size = len((rows.first() or {"x": []})["x"])
    if not size:
        return Model()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * size + 1)
        for batch in batches:
            x = _arrays(batch, 0)
            total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    sums = _added(rows.mapInArrow(moments, "v binary"), 2 * size + 1)
    mean = sums[:size] / sums[-1]
    deviation = np.sqrt(np.maximum(sums[size:-1] / sums[-1] - mean**2, 0))
    model = Model(mean, np.where(deviation > 1e-9, deviation, 1.0))
    d = FEATURES + 1

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d))
        for batch in batches:
            z, y, fold = model.fourier(_arrays(batch, 0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for half in (0, 1):
                own = z[fold == half]
                total[half, :d] += own.T @ own
                total[half, d] += own.T @ y[fold == half]
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    halves = _added(rows.mapInArrow(equations, "v binary"), 2 * (d + 1) * d).reshape(2, d + 1, d)

    def solve(sums: np.ndarray) -> np.ndarray:
        # the constant is not shrunk; its diagonal entry is the number of rows
        penalty = np.append(np.full(FEATURES, RIDGE * sums[d - 1, d - 1] + 1e-6), 1e-6)
        return np.linalg.solve(sums[:d] + np.diag(penalty), sums[d])

    crossed = [solve(halves[1]), solve(halves[0])]
    model.weights = solve(halves.sum(0))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, y, fold = model.fourier(_arrays(batch, 0)), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            raw = np.where(fold == 0, z @ crossed[0], z @ crossed[1])
            at = np.clip(np.floor((raw + 0.5) / 2 * BINS), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(y, pa.float64()), pa.array(raw)], names=["bin", "y", "raw"])

    curve = rows.mapInArrow(binned, "bin int, y double, raw double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("y"), F.avg("raw").alias("raw"))
    bins = sorted(curve.toLocalIterator(), key=lambda r: r.bin)
    model.knots = np.array([r.raw for r in bins])
    model.values = isotonic(np.array([r.n for r in bins], float), np.array([r.y for r in bins], float))
    return model


def is_held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from. A null id is not held out; it has no label either."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model from the labelled documents outside the held-out fifth. Repeated labels of a document count as their mean,
    null labels not at all. The statistics are computed row by row; only they are joined with the labels, not the texts."""
    known = labels.where(F.col(label).isNotNull() & ~is_held_out(id_col)).groupBy(id_col).agg(F.avg(F.col(label).cast("double")).alias("y"))
    rows = with_statistics(docs.where(~is_held_out(id_col)), id_col, text).join(known, id_col)
    return fit(rows.select("x", "y", (F.xxhash64(id_col) % 2 == 0).cast("int").alias("fold")))


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the calibrated score from 0 to 1 of the whole text; null texts count as empty. Only the text
    is an input. A column ``out`` is replaced."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField(out, T.DoubleType())])
    source = docs.select(*kept, F.col(text).cast("string").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(len(kept))):
                score = shared.value.score(statistics_of(block))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(score)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)
