"""Arrow helpers for list columns: rows become NumPy blocks without a per-row loop."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stream that are unpacked together.
UNPACKED = 1 << 17


def codes(batch: pa.RecordBatch, keys: Sequence[str]) -> np.ndarray:
    """A number per row that is equal where all keys are equal (nulls are equal to nulls)."""
    found = np.zeros(batch.num_rows, np.int64)
    for k in keys:
        encoded = batch.column(batch.schema.get_field_index(k)).dictionary_encode(null_encoding="encode")
        pair = found * len(encoded.dictionary) + encoded.indices.to_numpy(zero_copy_only=False)
        found = np.unique(pair, return_inverse=True)[1]
    return found


def whole_groups(groups: Sequence[str], fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], least_bytes: int = 1 << 20):
    """For ``mapInArrow`` over rows sorted by ``groups``: ``fn`` gets rows of whole groups with the number of each row's group,
    counted from 0. Batches are taken together up to ``least_bytes``; beyond that only the rows of the last group are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        fresh = 0

        def together() -> tuple[pa.RecordBatch, np.ndarray]:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            code = codes(rows, groups)
            return rows, np.cumsum(np.concatenate([[0], code[1:] != code[:-1]]))

        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            fresh += batch.nbytes
            if fresh >= least_bytes:
                rows, group = together()
                last = int(np.searchsorted(group, group[-1]))
                if last:
                    yield fn(rows.slice(0, last), group[:last])
                held, fresh = [rows.slice(last)], 0
        if held:
            yield fn(*together())

    return run


def packed_groups(groups: Sequence[str]):
    """For ``mapInArrow``: neighbours with equal ``groups`` become one row, whose other columns hold lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = codes(batch, groups)
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            bounds, at = np.append(starts, len(code)), pa.array(starts)
            cells = [v.take(at) if c in groups else list_column(v, bounds) for c, v in zip(batch.schema.names, batch.columns)]
            yield pa.RecordBatch.from_arrays(cells, names=batch.schema.names)

    return run


def unpacked(groups: Sequence[str], order: Sequence[str], fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], most: int = UNPACKED):
    """For :func:`whole_groups` over what :func:`packed_groups` gave: ``fn`` gets the single rows, sorted by ``order`` within each
    group, of as many groups at a time as begin within ``most`` rows."""

    def run(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        names = batch.schema.names
        lists = [c for c in names if c not in groups]
        size = pc.list_value_length(batch.column(names.index(lists[0]))).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))  # packed rows
        before = np.concatenate([[0], np.cumsum(size)])[first]
        out, at = [], 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(before, before[at] + most)))
            a, b = first[at], first[to] if to < len(first) else len(group)
            part = batch.slice(a, b - a)
            row = np.repeat(np.arange(b - a), size[a:b])
            cells = {c: part.column(i).take(pa.array(row)) if c in groups else part.column(i).flatten() for i, c in enumerate(names)}
            code = group[a:b][row]
            by = np.lexsort([*(cells[c].to_numpy(zero_copy_only=False) for c in reversed(order)), code])
            flat = pa.RecordBatch.from_arrays(list(cells.values()), names=names)
            if (np.diff(by) != 1).any():
                flat, code = flat.take(pa.array(by)), code[by]
            out.append(fn(flat, code - code[0]))
            at = to
        whole = pa.Table.from_batches(out).combine_chunks().to_batches()
        return whole[0] if whole else out[0]

    return run


def group_stream(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], fn: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: T.StructType
) -> DataFrame:
    """``fn`` over the rows of whole groups, sorted by ``groups`` and ``order``, with the number of each row's group.

    Neighbours of a group are packed into one row before they are dealt out, so the shuffle sorts groups rather than rows. A
    task holds the rows of one group, and of a few where they are small."""
    kept = [T.StructField(f.name, f.dataType if f.name in groups else T.ArrayType(f.dataType)) for f in df.schema]
    packed = df.mapInArrow(packed_groups(groups), T.StructType(kept))
    dealt = packed.repartition(*groups).sortWithinPartitions(*groups)
    return dealt.mapInArrow(whole_groups(groups, unpacked(groups, order, fn)), schema)


def list_parts(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Flat values and row boundaries (starting at 0) of a list column; a null list has no values."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten(), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def row_parts(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lists have at most ``UNPACKED`` values in all, one row at least."""
    ends = np.cumsum(sum(np.diff(list_parts(c)[1]) for c in columns))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + UNPACKED, "right")))
        yield at, to
        at = to


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of equally long vectors as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column holds nulls")
    values, bounds = list_parts(column)
    if len(column) == 0:
        return np.zeros((0, width or 0))
    lengths = np.diff(bounds)
    width = int(lengths[0]) if width is None else width
    if not (lengths == width).all():
        raise ValueError(f"vectors differ in length: expected {width}, found {sorted(set(lengths.tolist()))}")
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def list_column(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """A list column from flat values and row boundaries."""
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)


def vectors_column(block: np.ndarray) -> pa.Array:
    """A matrix as a list column of doubles."""
    n, width = block.shape
    return list_column(pa.array(np.ascontiguousarray(block, dtype=np.float64).reshape(-1)), np.arange(n + 1) * width)


def running_total(lengths: Column) -> Column:
    """Running sum inside each array of ints, row by row.

    Only the ints travel to Python; the text they measure stays in the JVM. A window over exploded pieces
    gives the same numbers but moves every piece through a shuffle keyed by the document.
    """

    @F.arrow_udf("array<int>")
    def totals(column: pa.Array) -> pa.Array:
        parts = [inside(column.slice(a, b - a)) for a, b in row_parts(column)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    def inside(column: pa.Array) -> pa.Array:
        values, bounds = list_parts(column)
        sums = np.concatenate([[0], np.cumsum(values.to_numpy(zero_copy_only=False), dtype=np.int64)])
        total = sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))
        return list_column(pa.array(total.astype(np.int32)), bounds)

    return totals(lengths)
