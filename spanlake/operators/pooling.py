"""Sums and means of vectors per key, over token spans, over whole tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import codes, list_column, list_parts, matrix, vectors_column, whole_groups
from spanlake.functions.vectors import doubles

_N, _TOTAL = "_n", "_total"
#: Partial sums of a task that are kept open together.
MAX_OPEN_BYTES = 64 << 20
#: Neighbouring places of a response whose vectors are packed into one row.
PACKED = 64


def _runs(keys: Sequence[str], regroup: bool = False):
    """Sums of adjacent rows with equal keys, over the batches of one task; only one open run is kept.

    With ``regroup``, for input that is not sorted, each key has one sum per task, as long as the sums of all keys stay
    below ``MAX_OPEN_BYTES``; they are given out and begun anew each time they would pass it.
    """

    def fold_any(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def folded() -> pa.RecordBatch:
            together = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return next(fold_batch(together))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(next(fold_batch(batch)))
            size += held[-1].nbytes
            if size > MAX_OPEN_BYTES:
                held = [folded()]
                size = held[0].nbytes
                if size > MAX_OPEN_BYTES // 2:
                    yield held.pop()
                    size = 0
        if held:
            yield folded()

    def fold_batch(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        code = codes(batch, keys)
        order = np.argsort(code, kind="stable")
        batch = batch.take(pa.array(order))
        x = matrix(batch.column(batch.schema.get_field_index(_TOTAL)))
        n = batch.column(batch.schema.get_field_index(_N)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], np.diff(code[order]) != 0]))
        heads = [batch.column(batch.schema.get_field_index(k)).take(pa.array(starts)) for k in keys]
        totals = [pa.array(np.add.reduceat(n, starts), pa.int64()), vectors_column(np.add.reduceat(x, starts, axis=0))]
        yield pa.RecordBatch.from_arrays([*heads, *totals], names=[*keys, _N, _TOTAL])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n, open_total = None, 0, None

        def sums_of(heads: list[pa.Array], counts, totals) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [*heads, pa.array(np.atleast_1d(counts), pa.int64()), vectors_column(np.atleast_2d(totals))],
                names=[*keys, _N, _TOTAL],
            )

        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = codes(batch, keys)
            x = matrix(batch.column(batch.schema.get_field_index(_TOTAL)))
            n = batch.column(batch.schema.get_field_index(_N)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            totals, counts = np.add.reduceat(x, starts, axis=0), np.add.reduceat(n, starts)
            heads = [batch.column(batch.schema.get_field_index(k)).take(pa.array(starts)) for k in keys]
            if open_key is not None:
                if [h[0].as_py() for h in heads] == [h[0].as_py() for h in open_key]:
                    totals[0] += open_total
                    counts[0] += open_n
                else:
                    yield sums_of(open_key, open_n, open_total)
            last = len(starts) - 1
            if last:
                yield sums_of([h.slice(0, last) for h in heads], counts[:last], totals[:last])
            open_key, open_n, open_total = [h.slice(last) for h in heads], counts[last], totals[last].copy()
        if open_key is not None:
            yield sums_of(open_key, open_n, open_total)

    return fold_any if regroup else fold


def sum_vectors(df: DataFrame, keys: Sequence[str], vector_col: str = "vector", n_col: str | None = None, folded: bool = False) -> DataFrame:
    """``keys, _n, _total``: number and sum of the vectors of each key.

    Each task first folds its own rows, so a key with very many rows reaches the shuffle as one partial sum per task.
    The second fold reads rows sorted by key and keeps one running sum, so no group is ever held as a whole.
    Null vectors are left out. ``folded`` says that a task gives a key once at most, so that there is nothing to fold before.
    """
    n = F.col(n_col).cast("long") if n_col else F.lit(1).cast("long")
    rows = df.filter(F.col(vector_col).isNotNull()).select(
        *keys, n.alias(_N), doubles(F.col(vector_col)).alias(_TOTAL)
    )
    schema = T.StructType(
        [T.StructField(k, rows.schema[k].dataType) for k in keys]
        + [T.StructField(_N, T.LongType()), T.StructField(_TOTAL, T.ArrayType(T.DoubleType()))]
    )
    partial = rows if folded else rows.mapInArrow(_runs(keys, regroup=True), schema)
    if not keys:
        # one partial sum per task: add them up by dimension, with partial aggregation in the JVM
        long = partial.select(_N, F.posexplode(_TOTAL).alias("_i", "_x"))
        by_dim = long.groupBy("_i").agg(F.sum("_x").alias("_x"), F.sum(_N).alias(_N))
        pairs = F.array_sort(F.collect_list(F.struct("_i", "_x")))  # one entry per dimension
        return by_dim.agg(F.max(_N).alias(_N), F.transform(pairs, lambda p: p["_x"]).alias(_TOTAL))
    return partial.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_runs(keys), schema)


def mean_vectors(df: DataFrame, keys: Sequence[str], vector_col: str = "vector", out: str = "vector") -> DataFrame:
    """``keys, n, vector``: the mean vector of each key."""
    sums = sum_vectors(df, keys, vector_col)
    return sums.select(
        *keys, F.col(_N).alias("n"), F.transform(_TOTAL, lambda x: x / F.col(_N)).alias(out)
    )


def global_center(response_vectors: DataFrame, vector_col: str = "vector", out: str = "center") -> DataFrame:
    """One row: the unweighted mean of the response means."""
    return mean_vectors(response_vectors, [], vector_col, out).select(out)


def _vectors_where(there: np.ndarray, block: np.ndarray) -> pa.Array:
    """A list column with the rows of ``block`` where ``there`` is true, in order, and nulls elsewhere."""
    size = np.concatenate([[0], np.cumsum(np.where(there, block.shape[1], 0))])
    offsets = pa.array(size.astype(np.int32), mask=np.append(~there, False))  # a null offset marks a null list
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(block).reshape(-1)))


def _prefix_sums(groups: Sequence[str], response_cols: Sequence[str], span_cols: Sequence[str], width: int):
    """Vector sums of span pieces, a null one where a piece has no vector, over packed rows: those of a group adjacent.

    A running sum over the vectors gives each piece as the difference of two of its rows. Only the rows of the last group of
    a batch, of at most ``width`` places, are held until the next one.
    """

    def pooled(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        numbers = lambda v: v.to_numpy(zero_copy_only=False).astype(np.int64)
        at, bounds = list_parts(column("_at"))
        key = np.repeat(group, np.diff(bounds)) * (width + 1) + numbers(at)
        vectors = list_parts(column(_TOTAL))[0]
        if (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, vectors = key[order], vectors.take(pa.array(order))
        pieces, bounds = list_parts(column("_pieces"))
        row = np.repeat(np.arange(len(group)), np.diff(bounds))
        low = np.searchsorted(key, group[row] * (width + 1) + numbers(pieces.field("_from")))
        high = np.searchsorted(key, group[row] * (width + 1) + numbers(pieces.field("_to")))
        n = np.maximum(high - low, 0)
        there = n > 0
        sums = np.zeros((0, 0))
        if there.any():
            x = matrix(vectors)
            running = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)])
            sums = running[high[there]] - running[low[there]]
        fields = {c: pieces.field(c) for c in span_cols}
        fields |= {c: column(c).take(pa.array(row)) for c in response_cols}
        keys = [response_cols[0], *span_cols, *response_cols[1:]]
        return pa.RecordBatch.from_arrays([*(fields[c] for c in keys), pa.array(n), _vectors_where(there, sums)], names=[*keys, _N, _TOTAL])

    return whole_groups(groups, pooled)


def _fold_sums(keys: Sequence[str]):
    """Means of adjacent rows with equal keys from their sums and numbers; rows without a sum count for nothing, and keys
    without any have a null mean. One open key is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_n, open_total = None, 0, None

        def out(heads: list[pa.Array], n: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            full = n > 0
            means = _vectors_where(full, sums / n[full][:, None])
            return pa.RecordBatch.from_arrays([*heads, means, pa.array(n, pa.int64())], names=[*keys, "vector", "n_vectors"])

        def opened() -> pa.RecordBatch:
            return out(open_key, np.array([open_n]), np.zeros((0, 0)) if open_total is None else open_total[None])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = codes(batch, keys)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            n = np.add.reduceat(batch.column(len(keys)).to_numpy(zero_copy_only=False), starts)
            column = batch.column(len(keys) + 1)
            there = column.is_valid().to_numpy(zero_copy_only=False)
            x = matrix(column.take(pa.array(np.flatnonzero(there))))
            place = np.concatenate([[0], np.cumsum(there)])[np.append(starts, len(there))]
            full = place[1:] > place[:-1]
            # keys without a sum have no rows in x, so each sum ends where the next one begins
            sums = np.add.reduceat(x, place[:-1][full], axis=0) if full.any() else x
            heads = [batch.column(i).take(pa.array(starts)) for i in range(len(keys))]
            if open_key is not None:
                if [h[0].as_py() for h in heads] == [h[0].as_py() for h in open_key]:
                    n[0] += open_n
                    if open_total is not None:
                        if full[0]:
                            sums[0] += open_total
                        else:
                            sums = np.vstack([open_total[None], sums]) if len(sums) else open_total[None]
                            full[0] = True
                else:
                    yield opened()
            last = len(starts) - 1
            if last:
                yield out([h.slice(0, last) for h in heads], n[:last], sums[: int(full[:last].sum())])
            open_key, open_n, open_total = [h.slice(last) for h in heads], int(n[last]), sums[-1].copy() if full[last] else None
        if open_key is not None:
            yield opened()

    return run


def mean_pool(
    token_vectors: DataFrame,
    spans: DataFrame,
    response_col: str = "response_id",
    span_cols: Sequence[str] = ("sent_idx",),
    extra_keys: Sequence[str] = ("layer",),
    width: int = 1024,
) -> DataFrame:
    """Mean of the token vectors in ``[tok_start, tok_end)`` of each span, per layer, and ``n_vectors``, how many were there.

    Every span has a row for each layer of its response, or one with null keys when the response has no vector at all;
    without a vector in the span the mean is null and ``n_vectors`` 0. Null vectors count as not there.

    Token positions are cut into runs of ``width``; each run's vectors come together in one sorted stream, whose running sum
    gives any span as a difference, so no vector is copied or joined, and a long response is shared by several tasks. A span
    over several runs has a piece in each, and the pieces' sums are added up. Both tables are dealt out as rows, then packed:
    a row that goes to Python holds the vectors, or the pieces, of ``PACKED`` neighbouring places.
    """
    keys = [response_col, *span_cols, *extra_keys]
    every = spans.select(response_col, *span_cols, "tok_start", "tok_end")
    if extra_keys:
        # which layers a response has; of the vectors only the keys are read
        every = every.join(token_vectors.select(response_col, *extra_keys).distinct(), response_col, "left")
    start, end = F.col("tok_start").cast("long"), F.col("tok_end").cast("long")
    runs = F.sequence(F.floor(start / width), F.floor((end - 1) / width))
    # a span without a place stands in the first run as an empty piece, so that none is missing below
    none = F.array(F.lit(0).cast("long"))
    pieces = every.select("*", F.explode(F.when(end > start, runs).otherwise(none)).alias("_run"))
    base = F.col("_run") * width
    low = F.when(end > start, F.greatest(start - base, F.lit(0))).otherwise(0)
    high = F.when(end > start, F.least(end - base, F.lit(width))).otherwise(0)
    pieces = pieces.select(
        response_col,
        *extra_keys,
        "_run",
        F.lit(None).cast("int").alias("_at"),
        F.lit(None).cast("array<double>").alias(_TOTAL),
        F.struct(*span_cols, low.cast("int").alias("_from"), high.cast("int").alias("_to")).alias("_piece"),
    )
    place = F.col("tok_idx").cast("long")
    tokens = token_vectors.filter(F.col("vector").isNotNull() & place.isNotNull()).select(
        response_col,
        *extra_keys,
        F.floor(place / width).alias("_run"),
        F.pmod(place, F.lit(width)).cast("int").alias("_at"),
        doubles(F.col("vector")).alias(_TOTAL),
        F.lit(None).cast(pieces.schema["_piece"].dataType).alias("_piece"),
    )
    groups = [response_col, *extra_keys, "_run"]
    dealt = tokens.unionByName(pieces).repartition(*groups)
    # Spark measures the open Arrow batch anew for each row it writes, which costs more than the few numbers of a row
    part = F.coalesce(F.floor(F.col("_at") / PACKED), -1 - F.floor(F.col("_piece._from") / PACKED))
    lists = [F.collect_list("_at").alias("_at"), F.collect_list(_TOTAL).alias(_TOTAL), F.collect_list("_piece").alias("_pieces")]
    packed = dealt.groupBy(*groups, part.alias("_part")).agg(*lists).sortWithinPartitions(*groups, "_part")
    schema = T.StructType(
        [T.StructField(k, every.schema[k].dataType) for k in keys]
        + [T.StructField(_N, T.LongType()), T.StructField(_TOTAL, T.ArrayType(T.DoubleType()))]
    )
    sums = packed.mapInArrow(_prefix_sums(groups, groups[:-1], span_cols, width), schema)
    merged = sums.repartition(*keys).sortWithinPartitions(*keys)
    out = T.StructType([*schema.fields[: len(keys)], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("n_vectors", T.LongType())])
    return merged.mapInArrow(_fold_sums(keys), out)


def pool_nested(df: DataFrame, vectors_col: str, spans_col: str, out: str = "pooled") -> DataFrame:
    """Span means where each row holds all token vectors of a response, ``ARRAY<ARRAY<FLOAT>>``, and its spans.

    The form to use right after a model has produced the vectors: nothing is exploded, joined or shuffled.
    """

    @F.arrow_udf("array<array<double>>")
    def pool(vectors: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        tokens, tok_bounds = list_parts(vectors)
        x = matrix(tokens)
        s, span_bounds = list_parts(starts)
        e, _ = list_parts(ends)
        base = np.repeat(tok_bounds[:-1], np.diff(span_bounds))
        lo = base + s.to_numpy(zero_copy_only=False).astype(np.int64)
        hi = base + e.to_numpy(zero_copy_only=False).astype(np.int64)
        n = hi - lo
        full = n > 0
        # every second range is a span's own rows; the one more row lets a span end at the last token
        ends = np.column_stack([lo[full], hi[full]]).ravel()
        rows = np.vstack([x, np.zeros((1, x.shape[1]))])
        sums = np.add.reduceat(rows, ends, axis=0)[::2] if len(ends) else np.zeros((0, x.shape[1]))
        means = sums / n[full][:, None]
        size = np.concatenate([[0], np.cumsum(np.where(full, x.shape[1], 0))])
        values = pa.array(np.ascontiguousarray(means).reshape(-1))
        # a null offset marks a null list
        offsets = pa.array(size.astype(np.int32), mask=np.append(~full, False))
        return list_column(pa.ListArray.from_arrays(offsets, values), span_bounds)

    return df.withColumn(out, pool(F.col(vectors_col), F.col(f"{spans_col}.tok_start"), F.col(f"{spans_col}.tok_end")))
