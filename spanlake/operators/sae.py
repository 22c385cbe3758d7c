"""Sparse autoencoder: parameters, encoding, decoding and what is read off the codes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions import vectors
from spanlake.functions.arrays import matrix, vectors_column
from spanlake.functions.spans import once
from spanlake.schemas import CODE, SAE_PARAMS

#: Parameters are sent to the executors in pieces of at most this size.
MAX_PARAM_BYTES = 256 << 20
#: The largest model (encoder and decoder) that the driver takes in as arrays; larger ones stay tables (``latent_blocks``).
MAX_MODEL_BYTES = 512 << 20


@dataclass
class SaeParams:
    """Parameters of a sparse autoencoder with one row per latent."""

    w_enc: np.ndarray
    w_dec: np.ndarray
    b_enc: np.ndarray
    b_dec: np.ndarray

    @property
    def n_latents(self) -> int:
        return self.w_enc.shape[0]

    @property
    def d_in(self) -> int:
        return self.w_enc.shape[1]

    @property
    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The plain arrays, which is what tasks are sent."""
        return self.w_enc, self.w_dec, self.b_enc, self.b_dec

    @property
    def nbytes(self) -> int:
        return self.w_enc.nbytes + self.w_dec.nbytes

    def blocks(self, max_bytes: int) -> list[tuple[int, int]]:
        """Ranges of latents whose encoder rows stay below ``max_bytes``."""
        step = max(1, int(max_bytes // (self.w_enc.shape[1] * 8)))
        return [(a, min(a + step, self.n_latents)) for a in range(0, self.n_latents, step)]

    @staticmethod
    def from_table(latents: DataFrame, b_dec: Sequence[float] | None = None, max_bytes: int = MAX_MODEL_BYTES) -> SaeParams:
        """Parameters from a latent table; raises before reading when the table is larger than a model can be."""
        size = latents.agg(
            F.count(F.lit(1)).alias("n"), F.max(F.size("w_enc")).alias("d"), F.max("latent_id").alias("last")
        ).first()
        if size["n"] * (size["d"] or 0) * 16 > max_bytes:
            raise ValueError(f"{size['n']} x {size['d']} latents are too many for arrays; use latent_blocks.LatentTable")
        if size["n"] and size["last"] != size["n"] - 1:
            raise ValueError("latent ids must be 0..n-1")
        table = latents.select("latent_id", "w_enc", "w_dec", F.col("b_enc").cast("double").alias("b_enc")).toArrow().sort_by("latent_id")
        w_enc, w_dec = matrix(table["w_enc"]), matrix(table["w_dec"])
        bias = table["b_enc"].to_numpy()
        shift = np.zeros(w_enc.shape[1]) if b_dec is None else np.asarray(b_dec, dtype=np.float64)
        return SaeParams(w_enc, w_dec, bias, shift)

    def to_table(self, spark: SparkSession) -> DataFrame:
        ids = pa.array(np.arange(self.n_latents, dtype=np.int32))
        columns = [ids, vectors_column(self.w_enc), vectors_column(self.w_dec), pa.array(self.b_enc)]
        return spark.createDataFrame(pa.Table.from_arrays(columns, names=SAE_PARAMS.fieldNames()), SAE_PARAMS)


def centroid_latents(df: DataFrame, label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """A dictionary from labelled vectors: one latent per label, the unit-length mean of its vectors."""
    from spanlake.operators.pooling import mean_vectors

    means = mean_vectors(df, [label_col], vector_col)
    direction = vectors.unit(F.col("vector"))
    return means.select(
        F.col(label_col).cast("int").alias("latent_id"),
        direction.alias("w_enc"),
        direction.alias("w_dec"),
        F.lit(0.0).alias("b_enc"),
    )


def center(df: DataFrame, center_df: DataFrame | None, vector_col: str = "vector") -> DataFrame:
    """Vectors minus the one-row center; unchanged when there is none."""
    if center_df is None:
        return df
    origin = center_df.first()[0]  # one vector
    return df.withColumn(vector_col, vectors.shifted(df.sparkSession, F.col(vector_col), origin))


def preactivations(
    df: DataFrame, params: SaeParams, vector_col: str = "vector", out: str = "z_pre", max_bytes: int = MAX_PARAM_BYTES
) -> DataFrame:
    """Adds all encoder outputs before the mask; the encoder is sent in blocks of at most ``max_bytes``."""
    parts = [
        vectors.project(df.sparkSession, F.col(vector_col), params.w_enc[a:b], params.b_enc[a:b], params.b_dec)
        for a, b in params.blocks(max_bytes)
    ]
    return df.withColumn(out, parts[0] if len(parts) == 1 else F.concat(*parts))


def latent_preact(df: DataFrame, params: SaeParams, latent: int, vector_col: str = "vector") -> DataFrame:
    """Adds the pre-activation of one latent."""
    one = slice(latent, latent + 1)
    z = vectors.project(df.sparkSession, F.col(vector_col), params.w_enc[one], params.b_enc[one], params.b_dec)
    return df.withColumn("z_pre", F.element_at(z, 1))


def topk_mask(z: Column, k: int) -> Column:
    """Sparse code from an array of pre-activations: the ``k`` largest positive ones, ties to the lower id."""
    entries = F.transform(z, lambda x, i: F.struct((-x).alias("m"), i.alias("i")))
    top = F.slice(F.array_sort(F.filter(entries, lambda e: e["m"] < 0)), 1, k)
    return F.transform(top, lambda e: F.struct(e["i"].cast("int").alias("latent_id"), (-e["m"]).alias("strength")))


def encode(
    df: DataFrame, params: SaeParams, k: int, vector_col: str = "vector", out: str = "code", max_bytes: int = MAX_PARAM_BYTES
) -> DataFrame:
    """Adds the sparse code of each vector: at most ``k`` firing latents, strongest first.

    The encoder is sent in blocks of latents of at most ``max_bytes``; the best ``k`` of all blocks of a row are its best
    ``k``, so the size of the blocks does not show. The codes are computed once, whatever is filtered or read from them.
    """
    parts = []
    for a, b in params.blocks(max_bytes):
        part = slice(a, b)
        parts.append(vectors.top_codes(df.sparkSession, F.col(vector_col), params.w_enc[part], params.b_enc[part], params.b_dec, k, a))
    if len(parts) == 1:
        return once(df.drop(out), **{out: parts[0]})
    entries = F.transform(F.flatten(F.array(*parts)), lambda e: F.struct((-e["strength"]).alias("m"), e["latent_id"].alias("i")))
    best = F.transform(
        F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["i"].alias("latent_id"), (-e["m"]).alias("strength"))
    )
    return once(df.drop(out), **{out: best.cast(CODE)})


def decode(df: DataFrame, params: SaeParams, code_col: str = "code", out: str = "xhat", max_bytes: int = MAX_PARAM_BYTES) -> DataFrame:
    """Adds the reconstruction of each code; the decoder is sent in blocks like the encoder, whose parts add up in the row."""
    none = np.zeros_like(params.b_dec)
    parts = [
        vectors.rebuild(df.sparkSession, F.col(code_col), params.w_dec[a:b], none if a else params.b_dec, a)
        for a, b in params.blocks(max_bytes)
    ]
    return df.withColumn(out, reduce(lambda x, y: F.zip_with(x, y, lambda p, q: p + q), parts))


def normalize_decoder(latents: DataFrame, col: str = "w_dec") -> DataFrame:
    """Decoder directions scaled to unit length."""
    return latents.withColumn(col, vectors.unit(F.col(col)))


def assign_topk(code: Column, k: int) -> Column:
    """Latent ids of a code, strongest first, padded with -1 to ``k``."""
    ids = F.transform(code, lambda e: e["latent_id"])
    return F.slice(F.concat(ids, F.array_repeat(F.lit(-1), k)), 1, k)


def assign_top1(code: Column) -> Column:
    """``(latent_id, strength)`` of the strongest latent; ``(-1, 0)`` when none fires."""
    first = F.get(code, F.lit(0))
    return F.struct(
        F.coalesce(first["latent_id"], F.lit(-1)).alias("latent_id"),
        F.coalesce(first["strength"], F.lit(0.0)).alias("strength"),
    )


def assignments(codes: DataFrame, k: int, id_cols: Sequence[str] = ("global_idx",), code_col: str = "code") -> DataFrame:
    """``id, latent_id, strength, topk`` for every row, also those without a firing latent."""
    top = assign_top1(F.col(code_col))
    return codes.select(
        *id_cols,
        top["latent_id"].alias("latent_id"),
        top["strength"].alias("strength"),
        assign_topk(F.col(code_col), k).alias("topk"),
    )


def top_dims(df: DataFrame, id_cols: Sequence[str], vector_col: str = "vector", n: int = 10) -> DataFrame:
    """The ``n`` dimensions with the largest absolute value of each vector, cut inside the row."""
    entries = F.transform(
        F.col(vector_col).cast("array<double>"),
        lambda x, i: F.struct((-F.abs(x)).alias("m"), i.alias("dim"), x.alias("value")),
    )
    top = F.slice(F.array_sort(entries), 1, n)
    rows = df.select(*id_cols, F.posexplode(top).alias("rank", "e"))
    return rows.select(*id_cols, "rank", F.col("e.dim").alias("dim"), F.col("e.value").alias("value"))


def vector_diff(df: DataFrame, base: DataFrame, vector_col: str = "vector") -> DataFrame:
    """Each vector against one base vector: exactly equal, and largest absolute difference."""
    held = df.withColumn("_b", base.select(vector_col).scalar())
    largest = vectors.max_abs_diff(F.col(vector_col), F.col("_b"))
    return held.select(df["*"], (F.col(vector_col) == F.col("_b")).alias("exact_equal"), largest.alias("max_abs_diff"))


def cosine_matrix(
    latents: DataFrame, top_n: int, size_col: str, keys: Sequence[str], vector_col: str = "w_dec", block: int = 512
) -> DataFrame:
    """Cosine of each pair among the ``top_n`` largest latents: ``i, j, cosine``, by rank in size.

    The report is ``top_n`` squared by nature. Ranks are given to narrow rows; the vectors meet in pairs of blocks of
    ``block`` ranks, so a task holds two blocks and their product, and none of them reaches the driver. ``keys`` tell the
    latents apart.
    """
    order = Window.orderBy(F.col(size_col).desc(), *keys)  # over top_n narrow rows
    best = latents.select(*keys, size_col).orderBy(F.col(size_col).desc(), *keys).limit(top_n)
    ranked = best.select(*keys, (F.row_number().over(order) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy()).alias("_n"))
    placed = ranked.join(latents.select(*keys, vectors.unit(F.col(vector_col)).alias("_v")), list(keys))
    placed = placed.withColumns({"_own": F.floor(F.col("i") / block), "_blocks": F.ceil(F.col("_n") / block)})
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)).alias("_other"))
    left = dealt.select("i", *keys, "_v", F.col("_own").alias("_a"), F.col("_other").alias("_b"))
    right = dealt.select(F.col("i").alias("j"), F.col("_v").alias("_w"), F.col("_other").alias("_a"), F.col("_own").alias("_b"))
    schema = T.StructType([*(left.schema[c] for c in ("i", *keys)), T.StructField("j", T.IntegerType()), T.StructField("cosine", T.DoubleType())])

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        x, y = (matrix(v.combine_chunks(), len(v[0])) for v in (a.column("_v"), b.column("_w")))  # no block is empty
        row, column = np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
        made = a.select(["i", *keys]).take(pa.array(row))
        return made.append_column("j", b.column("j").take(pa.array(column))).append_column("cosine", pa.array((x @ y.T).ravel()))

    return left.groupBy("_a", "_b").cogroup(right.groupBy("_a", "_b")).applyInArrow(product, schema)
