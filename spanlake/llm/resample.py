"""Importance resampling towards a target distribution: hashed n-gram weights, Gumbel noise, and ranks by a radix sort.

A feature is a run of consecutive words; its bucket is a CRC-32 modulo a fixed number. The two corpora are counted by
bucket; the log ratios form one array of gains, with which every document is scored by array look-ups. Gumbel top-k draws
without replacement in proportion to the exponentiated weights: noise that depends on the seed and the id is added, and the
highest scores win. The winners' ranks come from :mod:`spanlake.llm.radix`.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.blocks import LOWER, Block, blocks, byte_class, sums
from spanlake.llm.radix import nth_largest, with_position
from spanlake.llm.storage import stored

WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Words of more bytes are hashed one by one by the library.
LONGEST = 64


@dataclass(frozen=True)
class Draw:
    """Parameters: longest run of words, number of buckets, scale of the gains, seed, fewest words of a document that can be
    drawn, and the percentage of those that are."""

    most_words: int = 1
    buckets: int = 10_000
    scale: int = 1000
    seed: int = 2024
    fewest_words: int = 20
    percent: int = 10


def _crc_table() -> np.ndarray:
    """CRC-32 of every byte, by the reversed polynomial 0xEDB88320 (fixed value)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1).astype(np.uint32)
    return table


_TABLE = _crc_table()


def crc_feed(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The running CRC-32 state (inverted, as between bytes) after each byte range."""
    size = end - start
    order = np.argsort(-np.minimum(size, LONGEST + 1), kind="stable")
    state, at, size = state[order], start[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, LONGEST + 1), side="right")
    long = int(np.searchsorted(-size, -LONGEST, side="left"))
    for i in range(long):
        state[i] = zlib.crc32(data[at[i] : at[i] + size[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    for step, n in enumerate(live):
        if n <= long:
            break
        now = state[long:n]
        state[long:n] = (now >> np.uint32(8)) ^ _TABLE[(now ^ data[at[long:n] + step]) & np.uint32(255)]
    out = np.empty_like(state)
    out[order] = state
    return out


def features_of(block: Block, draw: Draw) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of runs: the buckets of all runs in order, and the bounds of each text among them."""
    data = LOWER[block.data]
    start, end = block.runs(WORD)
    bounds = block.of_text(start)
    text_end = np.repeat(bounds[1:], np.diff(bounds))
    first = np.arange(len(start))
    state = np.full(len(start), 0xFFFFFFFF, np.uint32)
    for length in range(1, draw.most_words + 1):
        keep = first + length <= text_end[first] if len(first) else np.zeros(0, bool)
        first, state = first[keep], state[keep]
        if length > 1:
            state = (state >> np.uint32(8)) ^ _TABLE[(state ^ np.uint32(32)) & np.uint32(255)]
        word = first + length - 1
        state = crc_feed(state, data, start[word], end[word])
        yield (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(draw.buckets), np.searchsorted(first, bounds)


def bucket_counts(docs: DataFrame, draw: Draw, text: str = "text") -> np.ndarray:
    """Features per bucket over all whole texts. Tasks add up their own first; ``draw.buckets`` numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(draw.buckets, np.int64)
        for batch in batches:
            for _, _, block in blocks(batch.column(0)):
                for bucket, _ in features_of(block, draw):
                    total += np.bincount(bucket, minlength=draw.buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(draw.buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[row.bucket] = row.n
    return out


def gains(source: np.ndarray, target: np.ndarray, draw: Draw) -> np.ndarray:
    """The scaled, rounded-down log ratio of the target's to the source's smoothed share, by bucket."""
    big_s, big_t = int(source.sum()) + draw.buckets, int(target.sum()) + draw.buckets
    ratio = (((t + 1) * big_s) / ((s + 1) * big_t) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(draw.scale * math.log(r)) for r in ratio], np.int64)


def with_weight(docs: DataFrame, gain: np.ndarray, draw: Draw, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, n_words, n_features, weight)`` of every row: the gains of its features, added up."""
    schema = T.StructType([docs.schema[id_col], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(1)):
                n_words = np.diff(block.of_text(block.runs(WORD)[0]))
                n, weight = np.zeros(to - at, np.int64), np.zeros(to - at, np.int64)
                for bucket, bounds in features_of(block, draw):
                    n += np.diff(bounds)
                    weight += sums(shared.value[bucket], bounds)
                columns = [batch.column(0).slice(at, to - at), *map(pa.array, (n_words.astype(np.int64), n, weight))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)


def noise(id_col: str, draw: Draw) -> Column:
    """Gumbel noise from the seed and the id, scaled and rounded down; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{draw.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-float(draw.scale)) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, draw: Draw = Draw(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id_col, n_words, n_features, weight, score, rank)`` of every row of ``docs``; the drawn ones have ranks 1, 2, 3, …

    Ids are integers; ties go to the smaller id, null ids last, then to fewer features; each row of a repeated id is ranked
    by itself, with the same noise. Null and empty texts have no words, the weight 0 and no rank where ``fewest_words`` is
    above 0. An empty target gives every bucket that is rare in ``docs`` a higher gain; empty ``docs`` give no rows. Other
    columns are not read.
    """
    gain = gains(bucket_counts(docs, draw, text), bucket_counts(target, draw, text), draw)
    weighted = with_weight(docs, gain, draw, id_col, text)
    scored = stored(weighted.withColumn("score", F.col("weight") + noise(id_col, draw)))
    able = F.col("n_words") >= draw.fewest_words
    size = scored.where(able).agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    n = size.n * draw.percent // 100
    no_rank = scored.withColumn("rank", F.lit(None).cast("long"))
    if not n:
        return no_rank
    height = F.col("score") - F.lit(size.low)
    least = nth_largest(scored.where(able), height, (size.high - size.low).bit_length(), n) + size.low
    # at most the drawn rows and those that tie with the last of them
    first = scored.where(able & (F.col("score") >= least))
    sign = F.lit(-(1 << 63))
    unsigned = F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).bitwiseXOR(sign)
    seen = first.agg(
        F.count("*").alias("n"), F.max("n_features").alias("f"), F.bit_or(unsigned).alias("some"), F.bit_and(unsigned).alias("all")
    ).first()
    differ = ((seen.some ^ seen.all) & ((1 << 64) - 1)).bit_length()
    key = [
        (F.col("n_features"), seen.f.bit_length()),
        (unsigned, differ),
        (F.col(id_col).isNull().cast("long"), 1),
        (F.lit(size.high) - F.col("score"), (size.high - least).bit_length()),
    ]
    ranked = with_position(first, key, seen.n, "rank")
    drawn = F.when(F.col("rank") < n, F.col("rank") + 1)
    rest = no_rank.where(~(able & (F.col("score") >= least)))
    return ranked.select(*scored.columns, drawn.alias("rank")).unionByName(rest)
