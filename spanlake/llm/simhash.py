"""SimHash near-duplicates with covering locality-sensitive hashing.

A fingerprint is 64 bits, a bit being set when more than half of the text's shingle hashes have it. Two fingerprints
link when at most ``RADIUS`` bits differ. Candidates come from covering masks: bits are assigned to the non-zero
vectors of GF(2)^(RADIUS+1), and table ``v`` keeps the bits whose vector has an odd product with ``v``. For any
RADIUS differing bits some ``v`` is orthogonal to all of theirs, so the pair agrees in that table: no link is missed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.blocks import LOWER, Block, blocks, byte_class, xxh64
from spanlake.llm.graph import components
from spanlake.session import cut_lineage

SHINGLE = 3
RADIUS = 3
#: Every byte but space and the controls 9 to 13.
WORD = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Members of a bucket that are compared in one piece; larger buckets are dealt out as pairs of pieces.
PIECE = 4096


def shingles_of(block: Block, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts that have words, how many shingles each has, the hashes of all of them, and a hash of each text's words."""
    data = LOWER[block.data]
    start, end = block.runs(WORD)
    # words with one blank behind each: a shingle is then a contiguous range
    word = WORD[data[:-8]]
    keep = word.copy()
    keep[1:] |= word[:-1]
    new_at = np.cumsum(keep) - 1
    lean = np.append(np.where(word, data[:-8], 32)[keep], np.full(8, 32, np.uint8)).astype(np.uint8)
    word_bounds = block.of_text(start)
    start, end = new_at[start], new_at[end - 1] + 1
    n_words = np.diff(word_bounds)
    n_shingles = np.where(n_words >= shingle, n_words - shingle + 1, np.minimum(n_words, 1))
    has = np.flatnonzero(n_shingles)
    if not len(has):
        return has, has, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = n_shingles[has]
    offset = np.concatenate([[0], np.cumsum(sizes)])
    first = np.repeat(word_bounds[has] - offset[:-1], sizes) + np.arange(offset[-1])
    last = first + np.repeat(np.minimum(n_words[has], shingle) - 1, sizes)
    whole = xxh64(lean, start[word_bounds[has]], end[word_bounds[has + 1] - 1])
    return has, sizes, xxh64(lean, start[first], end[last]), whole


def fingerprints_of(block: Block, shingle: int = SHINGLE) -> np.ndarray:
    """The fingerprint of each text of a block."""
    out = np.zeros(len(block), np.uint64)
    has, sizes, hashes, _ = shingles_of(block, shingle)
    if not len(has):
        return out
    offset = np.concatenate([[0], np.cumsum(sizes)])
    # counts of eight bits at a time in the bytes of a 64-bit sum, over at most 255 hashes
    pieces = -(-sizes // 255)
    piece_of = np.concatenate([[0], np.cumsum(pieces)])
    cut = np.repeat(offset[:-1], pieces) + 255 * (np.arange(piece_of[-1]) - np.repeat(piece_of[:-1], pieces))
    ones = np.uint64(0x0101010101010101)
    result = np.zeros(len(has), np.uint64)
    for low in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(low)) & ones, cut)
        for byte in range(8):
            counts = np.add.reduceat(((packed >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), piece_of[:-1])
            result |= (2 * counts > sizes).astype(np.uint64) << np.uint64(8 * byte + low)
    out[has] = result
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """All columns of ``docs`` but the text, and ``out``: the fingerprint as a long (its 64 bits).

    Letters A-Z are lowered, words are runs without blanks, shingles are ``shingle`` words, repeats included; fewer
    words are one shingle. Null and empty texts have fingerprint 0. A column named ``out`` is replaced.
    """
    others = [c for c in docs.columns if c not in (text, out)]
    fields = [docs.schema[c] for c in others]
    source = docs.select(*others, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.concatenate([fingerprints_of(b, shingle) for _, _, b in blocks(batch.column(len(others)))] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(others)], pa.array(made.view(np.int64))], names=[*others, out]
            )

    return source.mapInArrow(run, schema)


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """Signed 64-bit masks of the 2^(radius+1) - 1 tables.

    Bit ``i`` belongs to vector ``1 + i mod (2^(radius+1) - 1)``, so all vectors have about as many bits.
    """
    n = (1 << (radius + 1)) - 1
    masks = []
    for v in range(1, n + 1):
        mask = sum(1 << i for i in range(bits) if (v & (1 + i % n)).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among the values: a search that compares each value it reaches with those
    not reached yet. A dense group costs little more than its size; memory is linear."""
    left = np.arange(len(values))
    ends: list[tuple[int, np.ndarray]] = []
    while len(left) > 1:
        stack = [left[0]]
        left = left[1:]
        while stack and len(left):
            at = stack.pop()
            near = popcount(values[left] ^ values[at]) <= radius
            if near.any():
                reached = left[near]
                ends.append((at, reached))
                stack.extend(reached)
                left = left[~near]
    if not ends:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([np.full(len(r), a) for a, r in ends]), np.concatenate([r for _, r in ends])


def _links_in_runs(key: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (spanning forests for longer runs) among values whose sorted keys are equal."""
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    left, right = [], []
    short = np.repeat(size <= 16, size)
    for d in range(1, 16):
        if len(key) <= d:
            break
        i = np.flatnonzero((key[d:] == key[:-d]) & short[d:])
        if not len(i):
            break
        i = i[popcount(values[i] ^ values[i + d]) <= radius]
        left.append(values[i])
        right.append(values[i + d])
    for c, n in zip(cut[size > 16], size[size > 16]):
        a, b = forest(values[c : c + n], radius)
        left.append(values[c : c + n][a])
        right.append(values[c : c + n][b])
    none = np.zeros(0, values.dtype)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fingerprints: DataFrame, col: str, radius: int = RADIUS, piece: int = PIECE) -> DataFrame:
    """``(a, b)``: links among distinct fingerprints that connect exactly those that links of at most ``radius`` bits connect.

    ``fingerprints`` holds each value once. A bucket larger than ``piece`` is dealt out as pairs of pieces, each a task's
    share of bounded size, and each share gives at most one edge per member.
    """
    masks = covering_masks(radius)
    tables = fingerprints.select(
        F.col(col).alias("f"),
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(col).bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks)])).alias("e"),
    ).select("f", "e.t", "e.k")
    shared = tables.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    pieces = F.ceil(F.col("n") / piece).cast("int")
    own = F.pmod(F.xxhash64("f"), F.col("pieces")).cast("int")
    members = tables.join(shared, ["t", "k"]).withColumn("pieces", pieces).withColumn("own", own)
    other: Column = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    shares = members.select("t", "k", "f", "own", other.alias("other")).select(
        F.xxhash64("t", "k", F.least("own", "other"), F.greatest("own", "other")).alias("share"), "f"
    )
    spread = shares.repartition("share").sortWithinPartitions("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush(upto: int | None) -> Iterator[pa.RecordBatch]:
            nonlocal held, waiting
            if not held:
                return
            keys, vals = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            stop = len(keys) if upto is None else int(np.searchsorted(keys, keys[-1]))
            held = [(keys[stop:], vals[stop:])]
            waiting = len(keys) - stop
            if stop:
                a, b = _links_in_runs(keys[:stop], vals[:stop], radius)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            keys, vals = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            held.append((keys, vals))
            waiting += len(keys)
            if waiting >= 4 * PIECE:
                yield from flush(0)
        yield from flush(None)

    return spread.mapInArrow(run, "a long, b long")


def with_component(
    docs: DataFrame, id_col: str = "doc_id", fingerprint: str = "fingerprint", radius: int = RADIUS, root: str | None = None
) -> DataFrame:
    """``docs`` with ``component_id``: the smallest id among documents reachable over links, itself included.

    Equal fingerprints are folded to one before any comparison and the result is joined back by fingerprint, a join that
    Spark splits when one fingerprint has most rows. Null ids count for no minimum; a component of null ids only has
    a null component. A column ``component_id`` that ``docs`` has is replaced. ``root`` names one more column that tells
    components apart even then: the smallest fingerprint of each.
    """
    docs = docs.drop("component_id")
    base = cut_lineage(docs.groupBy(F.col(fingerprint).alias("__f")).agg(F.min(id_col).alias("least")))
    roots = components(links(base.select("__f"), "__f", radius), "a", "b")
    rooted = base.join(roots, F.col("__f") == F.col("node"), "left").select(
        "__f", "least", F.coalesce("root", "__f").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("__f", "component_id", *([F.col("root").alias(root)] if root else []))
    return docs.join(found, F.col(fingerprint) == F.col("__f"), "left").drop("__f")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, root: str | None = None
) -> DataFrame:
    """``docs`` without its text, with ``fingerprint`` (long) and ``component_id``, one row per row of ``docs``."""
    marked = cut_lineage(with_fingerprint(docs, text, "fingerprint", shingle))
    return with_component(marked, id_col, "fingerprint", radius, root)


def hex_fingerprint(c: str = "fingerprint") -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", mark: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """``docs`` with one row of every component: that of its smallest id, null ids last; columns as they were.

    Rows with equal id and text are copies of each other and leave one, whatever their other columns hold. Of rows with
    equal ids and different texts in one component, the one with the smallest text hash stays. ``mark`` adds another
    notion of components: it gets ``__id``, ``__h`` (text hash) and ``__text`` and keeps the first two, with ``__root``.
    """
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    narrow = docs.select(F.col(id_col).alias("__id"), hashed.alias("__h"), F.col(text).alias("__text"))
    marked = mark(narrow) if mark else near_duplicates(narrow, "__id", "__text", root="__root")
    single = marked.groupBy("__id", "__h").agg(F.min("__root").alias("__root"), F.count("*").alias("__n"))
    order = F.struct(F.col("__id").isNull().alias("last"), "__id", "__h", "__n")
    kept = cut_lineage(single.groupBy("__root").agg(F.min(order).alias("f")).select("f.__id", "f.__h", "f.__n"))
    found = docs.withColumn("__key", hashed).join(kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h")))
    once = found.where("__n = 1")
    repeated = found.where("__n > 1").dropDuplicates(["__id", "__h"])
    return once.unionByName(repeated).select(*docs.columns)
