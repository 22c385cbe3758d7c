"""Dictionaries of any size: encoding, decoding and gradients with the latents as a table, a group of latents at a time.

Vectors are packed into chunks of bounded size. A pass sends one group of latents, of at most ``max_bytes``, to the tasks:

* encoding keeps the group's best ``k`` per vector, and the groups' codes of a chunk are merged in one sorted stream;
* decoding gives a chunk's partial sums for groups it fires in, and the same kind of stream adds them up;
* a gradient pass reads chunks with codes and residuals and adds up what belongs to the group's latents, each task by itself
  first, so that a latent that very many vectors fire is no larger a group than another.

No process holds more than one group. What passes give is written to the shared folder, so a lost executor repeats its tasks
of one pass, and each pass's broadcast is destroyed after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import list_parts, matrix, vectors_column
from spanlake.functions.vectors import codes_column, largest, row_blocks
from spanlake.session import remove, scratch_dir

#: Bytes of the vectors of one chunk; a pass widens a chunk's rows to several matrices of ``k`` times that size.
CHUNK_BYTES = 1 << 20
#: A latent's numbers while it is fitted: encoder, decoder and two moments of each.
FIT_COPIES = 6

_ROW = "chunk long, part int, n int, a binary, b binary"
_NAMES = ["chunk", "part", "n", "a", "b"]
#: ``part`` of a chunk's vectors and of its code; groups of latents count from 0.
_VECTORS, _CODE = -2, -1


class Shelf:
    """Tables in a scratch folder of their own, removed together."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n, self.first = spark, scratch_dir(spark), 0, 1

    def put(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, keep: set[int]) -> None:
        """Removes all tables but those with these numbers (``n`` right after they were put)."""
        for i in range(self.first, self.n + 1):
            if i not in keep:
                remove(self.spark, f"{self.folder}/{i}")
        self.first = min([*keep, self.n + 1])

    def close(self) -> None:
        remove(self.spark, self.folder)

    def __enter__(self) -> Shelf:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def _emit(chunk: int, part: int, n: int, a: np.ndarray, b: np.ndarray | bytes | None = None) -> pa.RecordBatch:
    cells = [pa.array([chunk], pa.int64()), pa.array([part], pa.int32()), pa.array([n], pa.int32())]
    cells += [pa.array([np.ascontiguousarray(v).tobytes() if isinstance(v, np.ndarray) else v], pa.binary()) for v in (a, b)]
    return pa.RecordBatch.from_arrays(cells, names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes, bytes | None]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(j)[i].as_py() for j in range(5))


def packed(shelf: Shelf, df: DataFrame, vector_col: str, id_cols: Sequence[str] = ()) -> DataFrame:
    """``chunk, part, n, a`` and a list column per id: the vectors as matrices of at most ``CHUNK_BYTES``."""
    kept = list(id_cols)
    schema = T.StructType(
        [T.StructField("n", T.IntegerType()), T.StructField("a", T.BinaryType())]
        + [T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in kept]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(len(kept)))
            step = max(1, CHUNK_BYTES // max(8 * x.shape[1], 1))
            for at in range(0, len(x), step):
                part = x[at : at + step]
                ends = pa.array([0, len(part)], pa.int32())
                ids = [pa.ListArray.from_arrays(ends, batch.column(i).slice(at, len(part))) for i in range(len(kept))]
                cells = [pa.array([len(part)], pa.int32()), pa.array([part.tobytes()], pa.binary()), *ids]
                yield pa.RecordBatch.from_arrays(cells, names=schema.fieldNames())

    made = df.select(*kept, vector_col).mapInArrow(run, schema)
    made = made.withColumns({"chunk": F.monotonically_increasing_id(), "part": F.lit(_VECTORS), "b": F.lit(None).cast("binary")})
    return shelf.put(made.select(*_NAMES, *kept))


class LatentTable:
    """A dictionary as a table ``latent_id, w_enc, w_dec, b_enc`` (ids 0..n-1) and the decoder's bias; read by groups."""

    def __init__(self, latents: DataFrame, b_dec: Sequence[float] | None = None, max_bytes: int = 256 << 20):
        self.latents = latents
        size = latents.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("w_enc")).alias("d"), F.max("latent_id").alias("last")).first()
        if size["n"] and size["last"] != size["n"] - 1:
            raise ValueError("latent ids must be 0..n-1")
        self.n_latents, self.d_in = size["n"], size["d"] or 0
        self.b_dec = np.zeros(self.d_in) if b_dec is None else np.asarray(b_dec, dtype=np.float64)
        self.groups = groups_of(self.n_latents, self.d_in, max_bytes, 2)

    def group(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Encoder, decoder and encoder biases of the latents from ``a`` up to ``b``."""
        rows = self.latents.where(F.col("latent_id").between(a, b - 1)).select("latent_id", "w_enc", "w_dec", F.col("b_enc").cast("double").alias("b_enc"))
        table = rows.toArrow().sort_by("latent_id")  # one group
        return matrix(table["w_enc"]), matrix(table["w_dec"]), table["b_enc"].to_numpy()

    #: Where a fit left the table, if one did.
    shelf: Shelf | None = None

    def close(self) -> None:
        """Removes the table of a fit, once it is written elsewhere."""
        if self.shelf:
            self.shelf.close()

    def to_table(self, spark: SparkSession) -> DataFrame:
        return self.latents.select("latent_id", "w_enc", "w_dec", "b_enc")


def groups_of(n: int, d: int, max_bytes: int, copies: int) -> list[tuple[int, int]]:
    step = max(1, int(max_bytes // max(8 * copies * d, 1)))
    return [(a, min(a + step, n)) for a in range(0, n, step)]


def _pass(shelf: Shelf, rows: DataFrame, arrays: tuple, run: Callable) -> DataFrame:
    """``run(arrays, batches)`` over the rows, stored; the arrays are sent for this pass only."""
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    out = shelf.put(rows.select(*_NAMES).mapInArrow(lambda batches: run(shared.value, batches), _ROW))
    shared.destroy()
    return out


def _stream(rows: DataFrame, fold: Callable) -> DataFrame:
    """Chunks' rows side by side, vectors first, then the code, then groups in order; ``fold`` keeps one chunk open."""
    return rows.repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(fold, _ROW)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0].select(*_NAMES)
    for df in frames[1:]:
        out = out.unionByName(df.select(*_NAMES))
    return out


def codes_of(shelf: Shelf, rows: DataFrame, model: LatentTable, k: int) -> DataFrame:
    """One row per chunk: ids (``a``, int32, -1 for none) and values (``b``) of the ``k`` largest positive pre-activations of each
    vector, in descending order, equal ones by the lower id."""
    parts = []
    for g, (first, last) in enumerate(model.groups):
        w_enc, _, b_enc = model.group(first, last)

        def run(arrays, batches, g=g, first=first):
            w, bias, shift = arrays
            for chunk, _, n, a, _ in _rows(batches):
                x = np.frombuffer(a).reshape(n, -1) - shift
                ids, values = np.full((n, k), -1, np.int32), np.zeros((n, k))
                for at in row_blocks(n, len(w)):
                    i, v = largest(x[at] @ w.T + bias, k)
                    ids[at, : i.shape[1]], values[at, : i.shape[1]] = np.where(i >= 0, i + first, i), v
                yield _emit(chunk, g, n, ids, values)

        parts.append(_pass(shelf, rows, (w_enc, b_enc, model.b_dec), run))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for chunk, _, n, a, b in _rows(batches):
            ids, values = np.frombuffer(a, np.int32).reshape(n, k), np.frombuffer(b).reshape(n, k)
            if held is not None and held[0] == chunk:
                ids, values = np.hstack([held[2], ids]), np.hstack([held[3], values])
                order = np.argsort(-values, axis=1, kind="stable")[:, :k]
                ids, values = np.take_along_axis(ids, order, axis=1), np.take_along_axis(values, order, axis=1)
            elif held is not None:
                yield _emit(held[0], _CODE, *held[1:])
            held = (chunk, n, ids, values)
        if held is not None:
            yield _emit(held[0], _CODE, *held[1:])

    return shelf.put(_stream(_union(parts), merge))


def _entries(n: int, a: bytes, b: bytes, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, latent (from 0 in the group) and value of a chunk's firing entries within a group, by latent."""
    ids, values = np.frombuffer(a, np.int32).reshape(n, -1), np.frombuffer(b).reshape(n, -1)
    row, place = np.nonzero((ids >= first) & (ids < last))
    latent = ids[row, place] - first
    order = np.argsort(latent, kind="stable")
    return row[order], latent[order], values[row, place][order]


def residuals_of(shelf: Shelf, rows: DataFrame, codes: DataFrame, model: LatentTable) -> DataFrame:
    """A row per chunk: its vectors and, below them, its reconstruction less its vectors (``a``), and its code (``b``)."""
    parts = [rows, codes]
    for g, (first, last) in enumerate(model.groups):
        _, w_dec, _ = model.group(first, last)

        def run(arrays, batches, g=g, first=first, last=last):
            w = arrays[0]
            for chunk, _, n, a, b in _rows(batches):
                row, latent, value = _entries(n, a, b, first, last)
                if len(row):
                    part = np.zeros((n, w.shape[1]))
                    np.add.at(part, row, value[:, None] * w[latent])
                    yield _emit(chunk, g, n, part)

        parts.append(_pass(shelf, codes, (w_dec,), run))
    bias = model.b_dec

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = x = total = None
        code = b""
        for of, part, n, a, b in _rows(batches):
            if part == _VECTORS:
                if total is not None:
                    yield _emit(chunk, 0, len(x), np.vstack([x, total]), code)
                chunk, x = of, np.frombuffer(a).reshape(n, -1)
                total = bias - x
            elif part == _CODE:
                code = a + b
            else:
                total += np.frombuffer(a).reshape(n, -1)
        if total is not None:
            yield _emit(chunk, 0, len(x), np.vstack([x, total]), code)

    return shelf.put(_stream(_union(parts), add))


def encode(df: DataFrame, model: LatentTable, k: int, id_cols: Sequence[str], vector_col: str = "vector", shelf: Shelf | None = None) -> DataFrame:
    """``id_cols, code`` for every vector, the same codes as :func:`sae.encode` gives. The result reads tables of ``shelf``, or
    of a new folder beside the checkpoints."""
    shelf = shelf or Shelf(df.sparkSession)
    rows = packed(shelf, df, vector_col, id_cols)
    codes = codes_of(shelf, rows, model, k)
    return _per_vector(rows, codes, id_cols, "code", lambda n, a, b: codes_column(np.frombuffer(a, np.int32).reshape(n, k), np.frombuffer(b).reshape(n, k)))


def coded(df: DataFrame, model: LatentTable, k: int, id_cols: Sequence[str], vector_col: str = "vector", shelf: Shelf | None = None) -> DataFrame:
    """``id_cols, vector, code, xhat`` for every vector; ids have to tell the vectors apart."""
    shelf = shelf or Shelf(df.sparkSession)
    rows = packed(shelf, df, vector_col, id_cols)
    codes = codes_of(shelf, rows, model, k)
    off = residuals_of(shelf, rows, codes, model)
    code = _per_vector(rows, codes, id_cols, "code", lambda n, a, b: codes_column(np.frombuffer(a, np.int32).reshape(n, k), np.frombuffer(b).reshape(n, k)))
    difference = _per_vector(rows, off, id_cols, "__off", lambda n, a, b: vectors_column(np.frombuffer(a).reshape(2 * n, -1)[n:]))
    rebuilt = F.zip_with(F.col("__off"), F.col(vector_col), lambda o, x: o + x)
    return df.select(*id_cols, vector_col).join(code, list(id_cols)).join(difference, list(id_cols)).withColumn("xhat", rebuilt).drop("__off")


def _per_vector(rows: DataFrame, made: DataFrame, id_cols: Sequence[str], out: str, column: Callable) -> DataFrame:
    kept = list(id_cols)
    kind = "array<struct<latent_id:int,strength:double>>" if out == "code" else "array<double>"
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType.elementType) for c in kept]).add(out, T.ArrayType(T.DoubleType()))
    schema = T.StructType([*schema.fields[:-1], T.StructField(out, T._parse_datatype_string(kind))])
    # chunks meet their ids only, not their vectors
    joined = rows.select("chunk", *kept).join(made.select("chunk", "n", "a", "b"), "chunk").select(*kept, "n", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(kept)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = [list_parts(batch.column(j).slice(i, 1))[0] for j in range(m)]
                n, a, b = (batch.column(m + j)[i].as_py() for j in range(3))
                yield pa.RecordBatch.from_arrays([*ids, column(n, a, b)], names=schema.fieldNames())

    return joined.mapInArrow(run, schema)


def gradient_rows(off: DataFrame, w_dec: np.ndarray, b_dec: np.ndarray, first: int) -> tuple[DataFrame, Broadcast]:
    """``latent_id, n, vector`` parts to be added up, from the rows of :func:`residuals_of`, for the latents from ``first`` on whose
    decoder is given: gradients of encoder, decoder and encoder bias, and how often the latent fired. The row one past the
    last latent holds the sums of the slopes and of the squared residuals. The broadcast is to be destroyed afterwards."""
    shared = off.sparkSession.sparkContext.broadcast((w_dec, b_dec))
    size, d = w_dec.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shift = shared.value
        total, n = np.zeros((size + 1, 2 * d + 2)), 0
        for _, _, m, a, b in _rows(batches):
            x, o = np.split(np.frombuffer(a).reshape(2 * m, d), 2)
            k = len(b) // (12 * m)
            row, latent, value = _entries(m, b[: 4 * k * m], b[4 * k * m :], first, first + size)
            slope = 2 * o
            if len(row):
                dz = np.einsum("ij,ij->i", slope[row], w[latent])
                at = np.flatnonzero(np.concatenate([[True], latent[1:] != latent[:-1]]))
                hit = latent[at]
                total[hit, :d] += np.add.reduceat(dz[:, None] * (x[row] - shift), at, axis=0)
                total[hit, d : 2 * d] += np.add.reduceat(value[:, None] * slope[row], at, axis=0)
                total[hit, 2 * d] += np.add.reduceat(dz, at)
                total[hit, 2 * d + 1] += np.diff(np.append(at, len(latent)))
            total[size, :d] += slope.sum(axis=0)
            total[size, d] += (o * o).sum()
            n += m
        if n:
            ids = pa.array(np.arange(size + 1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(size + 1, n, np.int64)), vectors_column(total)], names=["latent_id", "n", "vector"])

    return off.select(*_NAMES).mapInArrow(run, "latent_id int, n long, vector array<double>"), shared


def squared_error(off: DataFrame, d: int) -> float:
    """Mean over all entries of the squared residuals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, n, a, _ in _rows(batches):
            o = np.frombuffer(a).reshape(2 * n, -1)[n:]
            yield pa.RecordBatch.from_arrays([pa.array([float((o * o).sum())]), pa.array([n], pa.int64())], names=["e", "n"])

    row = off.select(*_NAMES).mapInArrow(run, "e double, n long").agg(F.sum("e").alias("e"), F.sum("n").alias("n")).first()
    return row["e"] / (row["n"] * d) if row["n"] else None
