"""Joins of intervals by a sweep over sorted streams: no pair is formed and nothing is compared but neighbours in the order."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.arrays import group_stream

#: Positions of a document that are swept together.
STRETCH = 1 << 16
#: Below all stretches: those of spans without a place.
_APART = -(1 << 62)


def _stretches(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor(F.greatest(end - 1, start) / width))


def extremes(values: np.ndarray, ends: np.ndarray, floor: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest of ``values[low:high]`` whose ``ends`` lie above ``floor``, for each range, and whether there is any.

    ``low`` is the first place up to which some end lies above ``floor``. Where ends never fall, that holds for all of the
    range; only ranges with an end below one before it are looked at one by one.
    """
    there = low < high
    least, most = np.zeros(len(low), np.int64), np.zeros(len(low), np.int64)
    if not there.any():
        return least, most, there
    pairs = np.column_stack([low[there], high[there]]).ravel()
    padded = np.append(values, values[-1:])  # a range may end behind the last value
    least[there] = np.minimum.reduceat(padded, pairs)[::2]
    most[there] = np.maximum.reduceat(padded, pairs)[::2]
    fallen = np.concatenate([[0], np.cumsum(ends < np.maximum.accumulate(ends))])
    for i in np.flatnonzero(there & (fallen[np.where(there, high, 0)] > fallen[np.where(there, low, 0)])):
        kept = values[low[i] : high[i]][ends[low[i] : high[i]] > floor[i]]
        least[i], most[i] = kept.min(), kept.max()
    return least, most, there


def _sweep(heads: Sequence[str]):
    """For each range of a group the least and greatest index of the points that overlap it; ranges are the rows without an
    index."""

    def swept(batch: pa.RecordBatch, group: np.ndarray) -> pa.RecordBatch:
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        is_point = column("_idx").is_valid().to_numpy(zero_copy_only=False)
        span, point = np.flatnonzero(~is_point), np.flatnonzero(is_point)  # points are sorted by start
        start, end = (column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("_start", "_end"))
        # one axis for all groups of the batch: those of a later group lie behind all of an earlier one
        least = min(start.min(), end.min())
        size = max(start.max(), end.max()) - least + 2
        start, end = start - least + group * size, end - least + group * size
        low = np.searchsorted(np.maximum.accumulate(end[point]), start[span], "right")
        high = np.searchsorted(start[point], end[span], "left")
        idx = column("_idx").take(pa.array(point)).to_numpy(zero_copy_only=False)
        first, last, there = extremes(idx, end[point], start[span], low, high)
        kept = [column(c).take(pa.array(span)) for c in heads]
        ranges = [pa.array(first, mask=~there), pa.array(last, mask=~there)]
        return pa.RecordBatch.from_arrays([*kept, *ranges], names=[*heads, "_first", "_last"])

    return swept


def range_of_points(
    spans: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    span_cols: Sequence[str],
    span: tuple[str, str],
    point: tuple[str, str],
    idx: str,
    width: int = STRETCH,
) -> DataFrame:
    """``keys, span_cols, span``, ``first`` and ``last``: the least and greatest ``idx`` of the points that overlap each span.

    ``[start, end)`` of a point overlaps that of a span if it begins before the span's end and ends behind its start; points
    may overlap, lie in each other and come in any order. A span without a point has nulls, as has one with a null key or
    a null end. Points with a null, or that end where they begin, are left out. Equal spans are one row.

    Spans and points meet in one stream by stretches of ``width`` positions, so a long document is shared by many tasks and a
    row is copied only where it reaches over the border of a stretch. Neighbours of a stretch are dealt out as one row. A task holds the rows of one stretch, as
    numbers; spans over several stretches are put together by their least and greatest.
    """
    heads, moved = [*keys, *span_cols, *span], [*keys, *span_cols]
    slim = spans.select(*heads)
    known = F.lit(True)
    for c in (*keys, *span):
        known = known & F.col(c).isNotNull()
    none = F.lit(None).cast("long")
    start, end = (F.col(c).cast("long") for c in span)
    # spans that meet no point stand apart, dealt out by what they hold, so that the table is read once
    apart = F.array(F.lit(_APART) + F.pmod(F.xxhash64(*heads), F.lit(1 << 12)))
    stretches = F.when(known, _stretches(start, end, width)).otherwise(apart)
    pieces = slim.select(*moved, F.explode(stretches).alias("_stretch"), start.alias("_start"), end.alias("_end"), none.alias("_idx"))
    a, b = (F.col(c).cast("long") for c in point)
    whole = F.col(idx).isNotNull() & (a < b)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    blank = [F.lit(None).cast(slim.schema[c].dataType).alias(c) for c in span_cols]
    placed = points.where(whole).select(
        *keys, *blank, F.explode(_stretches(a, b, width)).alias("_stretch"), a.alias("_start"), b.alias("_end"), F.col(idx).cast("long").alias("_idx")
    )
    groups = [*keys, "_stretch"]
    out = [*moved, "_start", "_end"]
    long = [T.StructField(c, T.LongType()) for c in ("_start", "_end", "_first", "_last")]
    schema = T.StructType([T.StructField(c, slim.schema[c].dataType) for c in moved] + long)
    swept = group_stream(pieces.unionByName(placed), groups, ["_start"], _sweep(out), schema)
    places = [F.col(made).cast(slim.schema[c].dataType).alias(c) for made, c in zip(("_start", "_end"), span)]
    kind = points.schema[idx].dataType
    found = swept.groupBy(*out).agg(F.min("_first").cast(kind).alias("first"), F.max("_last").cast(kind).alias("last"))
    return found.select(*moved, *places, "first", "last")
