"""Exact top-k by inner product with vector-approximation files.

A stored block holds its vectors as integers and, per dimension, the cell (one of ``CELLS``) each lies in. The cells give
an upper and a lower bound of every product; exact vectors are read in the order of upper bounds until the k-th
result is certain.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from spanlake.llm.storage import stored

CELLS = 16
#: Vectors of a block, queries compared with it at a time, bytes of queries in one broadcast.
BLOCK_ROWS, QUERY_ROWS, QUERY_BYTES = 4096, 256, 16 << 20
#: Products below this are exact in doubles.
EXACT = float(1 << 53)


def build(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The stored blocks: ``dim``, ``n`` and packed ``row`` (a key of each row), ``id``, ``exact`` (floor(scale * x)),
    ``cell``, ``low`` and ``width`` (of the cells per dimension).

    Rows whose id or vector is null, or whose vector is empty or holds null or non-finite components, are left out.
    Components must stay below 2^52 / scale in size; others raise.
    """
    x = F.transform(vector, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector) > 0) & fine).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), x.alias("x")
    )
    names = ("row", "id", "exact", "cell", "low", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            start = np.concatenate([[0], np.cumsum(size)])
            flat = np.floor(scale * lists.flatten().to_numpy())
            if len(flat) and np.abs(flat).max() >= 1 << 52:
                raise ValueError("a component is too large for exact products")
            for dim in np.unique(size):
                own = np.flatnonzero(size == dim)
                for at in range(0, len(own), BLOCK_ROWS):
                    pick = own[at : at + BLOCK_ROWS]
                    exact = flat[start[pick][:, None] + np.arange(dim)].astype(np.int64)
                    low = exact.min(0)
                    width = -(-(exact.max(0) - low + 1) // CELLS)
                    cell = ((exact - low) // width).astype(np.uint8)
                    packed = (batch.column(0).to_numpy()[pick], batch.column(1).to_numpy()[pick], exact, cell, low, width)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32()), pa.array([len(pick)], pa.int32()), *(pa.array([p.tobytes()], pa.binary()) for p in packed)],
                        names=["dim", "n", *names],
                    )

    return stored(rows.mapInArrow(run, "dim int, n int, " + ", ".join(f"{c} binary" for c in names)))


def _unpack(batch: pa.RecordBatch, i: int) -> dict:
    dim = batch.column("dim")[i].as_py()
    get = lambda c, t: np.frombuffer(batch.column(c)[i].as_py(), t)
    out = {c: get(c, np.int64) for c in ("row", "id", "low", "width")}
    return out | {"dim": dim, "exact": get("exact", np.int64).reshape(-1, dim), "cell": get("cell", np.uint8).reshape(-1, dim)}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers, exactly: in doubles where they suffice."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if exact.size and max(exact.max(), -exact.min()) >= 1 << 63:
        raise OverflowError("a product does not fit into a long")
    return exact.astype(np.int64)


def _bounds(queries: np.ndarray, block: dict) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the products of every query with every vector of the block, from its cells."""
    low = block["low"] + block["cell"].astype(np.int64) * block["width"]
    high = low + block["width"] - 1
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return _product(up, low) + _product(down, high), _product(up, high) + _product(down, low)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


class Running:
    """The k best of each query so far in a task."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.read = 0

    def visit(self, numbers: np.ndarray, rows: np.ndarray, queries: np.ndarray, block: dict) -> None:
        lower, upper = _bounds(queries, block)
        k, n = self.k, upper.shape[1]
        floor = np.partition(lower, n - k - 1, axis=1)[:, n - k - 1] if n > k else np.full(len(queries), np.iinfo(np.int64).min)
        for j, q in enumerate(numbers):
            have = self.score[q]
            least = max(floor[j], have[-1]) if len(have) == k else floor[j]
            own = np.flatnonzero(upper[j] >= least)
            own = own[block["row"][own] != rows[j]]
            own = own[np.argsort(-upper[j][own], kind="stable")]
            at, step = 0, 4 * k
            while at < len(own):
                if len(self.score[q]) == k and self.score[q][-1] > upper[j][own[at]]:
                    break
                pick = own[at : at + step]
                exact = _product(queries[j : j + 1], block["exact"][pick])[0]
                self.read += len(pick)
                score, ids = np.concatenate([self.score[q], exact]), np.concatenate([self.ids[q], block["id"][pick]])
                keep = _best(score, ids, k)
                self.score[q], self.ids[q] = score[keep], ids[keep]
                at, step = at + step, 4 * step


def query_rows(blocks: DataFrame, every: int) -> DataFrame:
    """``(row, id, dim, q)`` of the rows whose id is divisible by ``every``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = _unpack(batch, i)
                pick = np.flatnonzero(b["id"] % every == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["row"][pick]), pa.array(b["id"][pick]), pa.array(np.full(len(pick), b["dim"], np.int32)), pa.array([b["exact"][p].tobytes() for p in pick], pa.binary())],
                    names=["row", "id", "dim", "q"],
                )

    return blocks.mapInArrow(run, "row long, id long, dim int, q binary")


def top_k(blocks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best other rows of each query, ties to the smaller id; all if fewer.

    ``queries`` is a frame of :func:`query_rows`. They are broadcast in parts of bounded size, one pass over the blocks
    each; a task keeps k rows per query, and the tasks' rows meet by query. Vectors of another length are no candidates.
    """
    spark = blocks.sparkSession
    queries = stored(queries)
    size = queries.agg(F.sum(F.octet_length("q") + 64)).first()[0] or 0
    parts = max(1, math.ceil(size / QUERY_BYTES))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_row", "query_id", "vec_id", "score")])

    def part(n: int) -> DataFrame:
        own = queries if parts == 1 else queries.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == n)
        rows = [(r.row, r.id, r.dim, r.q) for r in own.toLocalIterator()]
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            given = shared.value
            row, ids, dims = (np.array([r[i] for r in given], np.int64) for i in range(3))
            tables = {d: np.frombuffer(b"".join(r[3] for r in given if r[2] == d), np.int64).reshape(-1, d) for d in set(dims.tolist())}
            running = Running(len(given), k)
            for batch in batches:
                for i in range(batch.num_rows):
                    block = _unpack(batch, i)
                    who = np.flatnonzero(dims == block["dim"])
                    for at in range(0, len(who), QUERY_ROWS):
                        pick = who[at : at + QUERY_ROWS]
                        running.visit(pick, row[pick], tables[block["dim"]][at : at + QUERY_ROWS], block)
            count = np.fromiter(map(len, running.ids), np.int64, len(given))
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(row, count)), pa.array(np.repeat(ids, count)), pa.array(np.concatenate(none + running.ids)), pa.array(np.concatenate(none + running.score))],
                names=schema.fieldNames(),
            )

        return blocks.mapInArrow(run, schema)

    found = part(0)
    for n in range(1, parts):
        found = found.unionAll(part(n))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Top ``k`` of the rows whose id is divisible by ``every`` among all rows."""
    blocks = build(vectors, id_col, vector, scale)
    return top_k(blocks, query_rows(blocks, every), k)
