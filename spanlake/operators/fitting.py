"""Fitting a top-k sparse autoencoder on a vector table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import matrix, vectors_column
from spanlake.functions.vectors import dense, largest, row_blocks
from spanlake.operators.index import train_val_split
from spanlake.operators.pooling import sum_vectors
from spanlake.operators.latent_blocks import FIT_COPIES, LatentTable, Shelf, codes_of, gradient_rows, groups_of, packed, residuals_of, squared_error
from spanlake.operators.sae import MAX_PARAM_BYTES, SaeParams
from spanlake.session import remove, scratch_dir


@dataclass(frozen=True)
class FitConfig:
    """Settings of a fit: an epoch takes ``steps`` Adam steps, each over one part of the rows (by a hash of their ids)."""

    n_latents: int
    k: int = 3
    seed: int = 0
    steps: int = 8
    max_epochs: int = 300
    patience: int = 10
    val_frac: float = 0.05
    lr: float | None = None
    split_seed: int = 0
    min_gain: float = 1e-8

    @property
    def rate(self) -> float:
        return 2e-4 / (self.n_latents / 2**14) ** 0.5 if self.lr is None else self.lr


@dataclass
class FitResult:
    """``params`` of the best epoch: arrays, or a table of latents where they are more than one process takes."""

    params: SaeParams | LatentTable
    history: list[dict] = field(default_factory=list)
    fired: np.ndarray | None = None
    early_stopped: bool = False
    n_train: int = 0

    @property
    def best_val_loss(self) -> float:
        return min(h["val_loss"] for h in self.history)

    @property
    def dead_latents(self) -> list[int]:
        """Latents that never fired in training."""
        return np.flatnonzero(~self.fired).tolist()


def start_params(d_in: int, n_latents: int, seed: int) -> SaeParams:
    """Random directions; the encoder starts as the decoder's transpose, biases at 0, the decoder at unit length."""
    w = np.random.default_rng(seed).standard_normal((n_latents, d_in))
    return unit_decoder(SaeParams(w.copy(), w, np.zeros(n_latents), np.zeros(d_in)))


def unit_decoder(p: SaeParams) -> SaeParams:
    length = np.maximum(np.linalg.norm(p.w_dec, axis=1, keepdims=True), 1e-8)
    return replace(p, w_dec=p.w_dec / length)


def gradients(p: SaeParams, x: np.ndarray, k: int) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Summed gradients of ``Σ‖x̂ - x‖²``, which latents fired, and that sum; divide by ``x.size`` for the mean."""
    shifted = x - p.b_dec
    ids, values = largest(shifted @ p.w_enc.T + p.b_enc, k)
    z = dense(ids, values, p.n_latents)
    off = z @ p.w_dec + p.b_dec - x
    slope = 2 * off
    dz = (slope @ p.w_dec.T) * (z > 0)
    grads = {
        "w_enc": dz.T @ shifted,
        "w_dec": z.T @ slope,
        "b_enc": dz.sum(axis=0),
        "b_dec": slope.sum(axis=0) - dz.sum(axis=0) @ p.w_enc,
    }
    return grads, (z > 0).any(axis=0), float((off**2).sum())


def moved(p: np.ndarray, g: np.ndarray, m: np.ndarray | float, v: np.ndarray | float, t: int, lr: float) -> tuple:
    """Parameter and moments after Adam's step number ``t``, with the usual constants."""
    m = 0.9 * m + 0.1 * g
    v = 0.999 * v + 0.001 * g * g
    return p - lr * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v


class Whole:
    """A model that driver and tasks hold as one: a step is one job."""

    def __init__(self, parts: dict[int, DataFrame], params: SaeParams, cfg: FitConfig):
        self.parts, self.params, self.cfg = parts, params, cfg
        self.t, self.m, self.v = 0, {}, {}
        self.fired = np.zeros(params.n_latents, bool)
        self.best = params

    def step(self, part: int) -> None:
        grads, fired, _ = full_gradient(self.parts[part], self.params, self.cfg.k)
        self.fired |= fired
        self.t += 1
        new = {}
        for name, g in grads.items():
            new[name], self.m[name], self.v[name] = moved(getattr(self.params, name), g, self.m.get(name, 0.0), self.v.get(name, 0.0), self.t, self.cfg.rate)
        self.params = unit_decoder(SaeParams(**new))

    def loss(self, part: int) -> float:
        return reconstruction_loss(self.parts[part], self.params, self.cfg.k)

    def keep(self) -> None:
        self.best = self.params

    def close(self) -> None:
        """Nothing is left behind."""


#: One latent while it is fitted: encoder, decoder and encoder bias end to end, and both moments of that.
_FITTED = T.StructType([T.StructField("latent_id", T.IntegerType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("p", "m", "v"))])


class InBlocks:
    """A model of any size: latents and their Adam state lie in tables by group, and a step takes one group at a time.

    The steps are those of :class:`Whole`; driver and tasks hold a group of at most ``max_bytes`` and vectors of length d.
    """

    def __init__(self, parts: dict[int, DataFrame], start: SaeParams | None, cfg: FitConfig, d: int, max_bytes: int):
        self.spark = next(iter(parts.values())).sparkSession
        self.shelf, self.data, self.cfg, self.d = Shelf(self.spark), Shelf(self.spark), cfg, d
        self.parts, self.chunks = parts, {}
        self.groups = groups_of(cfg.n_latents, d, max_bytes, FIT_COPIES)
        self.t, self.fired = 0, np.zeros(cfg.n_latents, bool)
        self.b_dec = np.zeros(d) if start is None else start.b_dec
        self.moments = np.zeros((2, d))
        self.tables, self.numbers, self.kept = [], [], []
        rng = np.random.default_rng(cfg.seed)
        for a, b in self.groups:
            if start is None:  # the same numbers as one draw of the whole
                w = rng.standard_normal((b - a, d))
                own = np.hstack([w, w / np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-8), np.zeros((b - a, 1))])
            else:
                own = np.hstack([start.w_enc[a:b], start.w_dec[a:b], start.b_enc[a:b, None]])
            self.tables.append(self._table(a, own, np.zeros_like(own), np.zeros_like(own)))
            self.numbers.append(self.shelf.n)
        self.keep()

    def _table(self, first: int, *columns: np.ndarray) -> DataFrame:
        ids = pa.array(np.arange(first, first + len(columns[0]), dtype=np.int32))
        table = pa.Table.from_arrays([ids, *map(vectors_column, columns)], names=_FITTED.fieldNames())
        return self.shelf.put(self.spark.createDataFrame(table, _FITTED))

    def _latents(self, tables: list[DataFrame], b_dec: np.ndarray) -> LatentTable:
        d, rows = self.d, tables[0]
        for table in tables[1:]:
            rows = rows.unionByName(table)
        latents = rows.select("latent_id", F.slice("p", 1, d).alias("w_enc"), F.slice("p", d + 1, d).alias("w_dec"), F.element_at("p", 2 * d + 1).alias("b_enc"))
        model = LatentTable(latents, b_dec)
        model.groups = self.groups
        return model

    def _residuals(self, shelf: Shelf, part: int) -> DataFrame:
        if part not in self.chunks:
            self.chunks[part] = packed(self.data, self.parts[part], "vector")
        model = self._latents(self.tables, self.b_dec)
        return residuals_of(shelf, self.chunks[part], codes_of(shelf, self.chunks[part], model, self.cfg.k), model)

    def step(self, part: int) -> None:
        d = self.d
        self.t += 1
        tables, numbers, slope, n = [], [], np.zeros(d), 0
        with Shelf(self.spark) as shelf:
            off = self._residuals(shelf, part)
            for (a, b), table in zip(self.groups, self.tables):
                state = table.toArrow().sort_by("latent_id")  # one group
                p, m, v = (matrix(state[c]) for c in ("p", "m", "v"))
                rows, shared = gradient_rows(off, p[:, d : 2 * d], self.b_dec, a)
                total, n = _collect_sums(rows)
                shared.destroy()
                grads = total[:-1, : 2 * d + 1]
                self.fired[a:b] |= total[:-1, -1] > 0
                slope -= grads[:, -1] @ p[:, :d]
                if a == 0:
                    slope += total[-1, :d]
                p, m, v = moved(p, grads / (n * d), m, v, self.t, self.cfg.rate)
                p[:, d : 2 * d] /= np.maximum(np.linalg.norm(p[:, d : 2 * d], axis=1, keepdims=True), 1e-8)
                tables.append(self._table(a, p, m, v))
                numbers.append(self.shelf.n)
        self.b_dec, *self.moments = moved(self.b_dec, slope / (n * d), *self.moments, self.t, self.cfg.rate)
        self.tables, self.numbers = tables, numbers
        self.shelf.clear({*self.numbers, *self.kept})

    def loss(self, part: int) -> float:
        with Shelf(self.spark) as shelf:
            return squared_error(self._residuals(shelf, part), self.d)

    def keep(self) -> None:
        self.best, self.kept = self._latents(self.tables, self.b_dec), self.numbers
        self.best.shelf = self.shelf

    def close(self) -> None:
        self.data.close()
        self.shelf.clear({*self.kept})


def _pack(p: SaeParams, fired: np.ndarray) -> np.ndarray:
    """One row per latent (encoder, decoder, encoder bias, fired) and a last one for the decoder bias."""
    d = p.w_enc.shape[1]
    rows = np.hstack([p.w_enc, p.w_dec, p.b_enc[:, None], fired.astype(float)[:, None]])
    return np.vstack([rows, np.concatenate([p.b_dec, np.zeros(d + 2)])])


def _unpack(rows: np.ndarray, d: int) -> tuple[SaeParams, np.ndarray]:
    body = rows[:-1]
    params = SaeParams(body[:, :d].copy(), body[:, d : 2 * d].copy(), body[:, 2 * d].copy(), rows[-1, :d].copy())
    return params, body[:, 2 * d + 1] > 0


_PART = T.StructType(
    [
        T.StructField("latent_id", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("vector", T.ArrayType(T.DoubleType())),
    ]
)


def _part(rows: np.ndarray, n: int) -> pa.RecordBatch:
    ids = pa.array(np.arange(len(rows), dtype=np.int32))
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(np.full(len(rows), n, np.int64)), vectors_column(rows)], names=["latent_id", "n", "vector"]
    )


def _collect_sums(parts: DataFrame) -> tuple[np.ndarray, int]:
    """Parameter-sized sums over all parts, of which each task has made one; they are added up by latent on the executors."""
    rows = sum_vectors(parts, ["latent_id"], "vector", "n", folded=True).toArrow().sort_by("latent_id")
    return matrix(rows["_total"]), rows["_n"][0].as_py()


def full_gradient(rows: DataFrame, p: SaeParams, k: int) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
    """Gradient of the mean squared error over all rows, which latents fired, and the error before the step."""
    shared = rows.sparkSession.sparkContext.broadcast(p.arrays)
    d = p.w_enc.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            x = matrix(batch.column(batch.num_columns - 1), d)
            for at in row_blocks(len(x), len(shared.value[0])):
                grads, fired, loss = gradients(SaeParams(*shared.value), x[at], k)
                part = _pack(SaeParams(**grads), fired)
                part[-1, d] = loss
                total, n = part if total is None else total + part, n + len(x[at])
        if n:
            yield _part(total, n)

    total, n = _collect_sums(rows.mapInArrow(run, _PART))
    shared.destroy()
    grads, fired = _unpack(total / (n * d), d)
    return {f: getattr(grads, f) for f in ("w_enc", "w_dec", "b_enc", "b_dec")}, fired, total[-1, d] / (n * d)


def reconstruction_loss(rows: DataFrame, p: SaeParams, k: int, vector_col: str = "vector") -> float:
    """Mean squared error per element over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(p.arrays)

    @F.arrow_udf("double")
    def row_error(column: pa.Array) -> pa.Array:
        params = SaeParams(*shared.value)
        x = matrix(column, params.w_enc.shape[1])
        errors = [np.zeros(0)]
        for at in row_blocks(len(x), params.n_latents):
            ids, values = largest((x[at] - params.b_dec) @ params.w_enc.T + params.b_enc, k)
            off = dense(ids, values, params.n_latents) @ params.w_dec + params.b_dec - x[at]
            errors.append((off**2).mean(axis=1))
        return pa.array(np.concatenate(errors))

    found = rows.select(row_error(vector_col).alias("e")).agg(F.avg("e")).first()[0]
    shared.destroy()
    return found


def fit_topk_sae(
    df: DataFrame,
    cfg: FitConfig,
    id_col: str = "global_idx",
    vector_col: str = "vector",
    start: SaeParams | None = None,
    max_bytes: int = MAX_PARAM_BYTES,
) -> FitResult:
    """Fits on the training share, stops when the validation loss has not improved for ``patience`` epochs, and
    returns the parameters of the best epoch. ``start`` replaces the random start.

    A step adds up the gradients of its part of the rows in the tasks and moves the one model on the driver, whose Adam
    state lasts for the whole fit. Parts depend on ids only and their number is a setting, so neither the number of rows,
    partitions or cores nor the storage layout changes the method. The rows are written once, by part, to the shared
    folder; a step reads its part there, in tasks as large as the scan makes them, and a lost executor costs a repeated
    read. A model that takes more than ``max_bytes`` with its state is fitted by groups of latents (:class:`InBlocks`), in the
    same steps; its table lies in the scratch folder until it is written elsewhere.
    """
    spark = df.sparkSession
    rows = train_val_split(df.select(F.col(id_col).alias("_id"), F.col(vector_col).alias("vector")), cfg.val_frac, ["_id"], cfg.split_seed)
    part = F.when(F.col("is_val"), -1).otherwise(F.pmod(F.xxhash64("_id"), F.lit(cfg.steps))).cast("int")
    folder = scratch_dir(spark)
    try:
        rows.select(part.alias("_part"), "vector").write.partitionBy("_part").parquet(folder)
        parts = {r["_part"]: r for r in _sizes(spark.read.parquet(folder))}
        order = sorted(p for p in parts if p >= 0)
        if not order:
            raise ValueError("no training rows")
        d = parts[order[0]]["d"]
        schema = rows.select("vector").schema
        of = {p: spark.read.schema(schema).parquet(f"{folder}/_part={p}") for p in parts}
        if 8 * FIT_COPIES * cfg.n_latents * d <= max_bytes:
            model = Whole(of, start_params(d, cfg.n_latents, cfg.seed) if start is None else start, cfg)
        else:
            model = InBlocks(of, start, cfg, d, max_bytes)
        result = FitResult(model.best, n_train=sum(parts[p]["n"] for p in order))
        best, stale = float("inf"), 0
        for epoch in range(cfg.max_epochs):
            for p in np.random.default_rng([cfg.seed, epoch]).permutation(order):
                model.step(p)
            loss = model.loss(-1)
            result.history.append({"epoch": epoch + 1, "val_loss": loss})
            if loss < best - cfg.min_gain:
                best, stale = loss, 0
                model.keep()
            else:
                stale += 1
                if stale >= cfg.patience:
                    result.early_stopped = True
                    break
        result.params, result.fired = model.best, model.fired
        model.close()
    finally:
        remove(spark, folder)
    return result


def _sizes(rows: DataFrame) -> list:
    """Rows and vector length of each part."""
    return rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).collect()
