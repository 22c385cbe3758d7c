"""Near copies of documents: SimHash groups and MinHash bands of word shingles, exact Jaccard, components.

Texts are compared by the set of their ``SHINGLE``-word shingles, A-Z lowered (as 64-bit hashes). Two texts link when
the Jaccard similarity of their sets is at least ``ALIKE``. Candidates share a group of :func:`simhash.near_duplicates`
over the same shingles, whose radius reaches the closest copies, or one of ``BANDS`` buckets of ``ROWS`` minima: a pair
at 0.8 shares one with a chance of 1 - (1 - 0.8^4)^24 = 0.999997. In a group or bucket all links count; the sets
themselves decide. Equal texts are folded to one before any comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm import simhash
from spanlake.llm.blocks import Block, blocks
from spanlake.llm.graph import components
from spanlake.llm.storage import stored

#: Words of a shingle, and the similarity from which texts link (a fraction).
SHINGLE, ALIKE = 5, (4, 5)
BANDS, ROWS, SEED = 24, 4, 11
#: Members of a bucket, and shingles of them in all, that are compared in one piece; larger buckets become pairs of pieces.
PIECE, PIECE_SHINGLES = 256, 1 << 20
#: Text that signatures are made of at a time.
PART_BYTES = 2 << 20


def signatures(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of bucket keys per text, from the hashes of its shingles (at least one each)."""
    rng = np.random.default_rng(SEED)
    turn = rng.integers(0, 1 << 31, (BANDS, ROWS, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    out = np.empty((len(sizes), BANDS), np.int64)
    for band in range(BANDS):
        key = np.zeros(len(sizes), np.uint64)
        for row in range(ROWS):
            least = np.minimum.reduceat(short * turn[band, row, 0] + turn[band, row, 1], first)
            key = (key ^ least) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = (band << 32) | (key >> np.uint64(32)).astype(np.int64)
    return out


def _sketches(narrow: DataFrame) -> DataFrame:
    """``(__id, __h, key, size, bands)``: a hash of the words (0 without any), the number of shingles, and the buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(2), PART_BYTES):
                key, size = np.zeros(to - at, np.int64), np.zeros(to - at, np.int32)
                ends = np.zeros(to - at + 1, np.int32)
                has, sizes, hashes, whole = simhash.shingles_of(block, SHINGLE)
                bands = np.zeros(0, np.int64)
                if len(has):
                    key[has], size[has] = whole.view(np.int64), sizes
                    ends[has + 1] = BANDS
                    bands = signatures(hashes, sizes).ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(bands))
                ids = [batch.column(i).slice(at, to - at) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(key), pa.array(size), lists], names=["__id", "__h", "key", "size", "bands"])

    kind = narrow.schema["__id"].dataType.simpleString()
    return narrow.select("__id", "__h", F.col("__text").cast("string")).mapInArrow(run, f"__id {kind}, __h long, key long, size int, bands array<long>")


def shingle_sets(block: Block) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a block."""
    out = [np.zeros(0, np.uint64)] * len(block)
    has, sizes, hashes, _ = simhash.shingles_of(block, SHINGLE)
    for i, own in zip(has, np.split(hashes, np.cumsum(sizes)[:-1])):
        out[i] = np.unique(own)
    return out


def _sets(texts: DataFrame) -> DataFrame:
    """``(key, shingles)`` of ``(key, __text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(1), PART_BYTES):
                sets = pa.array([s.tobytes() for s in shingle_sets(block)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), sets], names=["key", "shingles"])

    return texts.select("key", F.col("__text").cast("string")).mapInArrow(run, "key long, shingles binary")


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets: each set reached is compared with those not reached yet, so
    a dense bucket costs little more than its size."""
    top, bottom = ALIKE
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) < 2:
        return []
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    coded = np.split(flat, np.cumsum(size)[:-1])
    has = np.zeros(int(flat.max()) + 1, bool)
    inside, alive = np.arange(len(sets)), np.ones(len(sets), bool)
    first = np.cumsum(size) - size
    edges: list[tuple[int, int]] = []
    stack: list[int] = []
    while alive.any():
        if not stack:
            start = int(np.argmax(alive))
            alive[start] = False
            stack.append(int(inside[start]))
            continue
        at = stack.pop()
        has[coded[at]] = True
        both = np.add.reduceat(has[flat], first, dtype=np.int64)
        has[coded[at]] = False
        near = alive & (bottom * both >= top * (size[inside] + size[at] - both))
        reached = inside[near].tolist()
        edges += [(at, i) for i in reached]
        stack += reached
        alive &= ~near
        if 2 * alive.sum() < len(inside) and alive.any():
            inside = inside[alive]
            alive = np.ones(len(inside), bool)
            flat = np.concatenate([coded[i] for i in inside])
            first = np.cumsum(size[inside]) - size[inside]
    return edges


def _groups(narrow: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(key, size, bucket)``: the SimHash group of every text with words, as one more bucket beside the bands."""
    alike = simhash.near_duplicates(narrow, "__id", "__text", SHINGLE, root="__alike").select("__h", "__alike").distinct()
    texts = sketches.where("size > 0").select("__h", "key", "size").distinct()
    bucket = F.lit(BANDS << 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64("__alike"), 32))
    return texts.join(alike, "__h").select("key", "size", bucket.alias("bucket"))


def links(narrow: DataFrame, sketches: DataFrame) -> DataFrame:
    """``(a, b)``: keys of texts that link, a spanning forest per bucket and pair of pieces."""
    buckets = sketches.select("key", "size", F.explode("bands").alias("bucket")).unionByName(_groups(narrow, sketches))
    once = buckets.repartition("bucket").dropDuplicates(["bucket", "key"])
    own = Window.partitionBy("bucket")
    # similar texts share many buckets: of buckets with the same members (told by two hashes of all of them) one is enough
    same = {"n": F.count("*").over(own), "x": F.bit_xor("key").over(own), "y": F.bit_xor(F.xxhash64("key")).over(own)}
    found = stored(once.withColumns(same | {"shingles": F.sum(F.col("size").cast("long")).over(own)}).where("n > 1"))
    chosen = found.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = stored(found.join(chosen, "bucket", "left_semi").select("bucket", "key", "n", "shingles"))
    # one row of each text that is compared
    place = F.struct(F.col("__id").isNull().alias("last"), "__id", "__h")
    named = sketches.join(members.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.min(place).alias("at"))
    named = named.select("key", F.col("at.__id").alias("__i"), F.col("at.__h").alias("__k"))
    held = narrow.join(named, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__h") == F.col("__k")))
    sets = stored(_sets(held).dropDuplicates(["key"]))
    pieces = F.greatest(F.ceil(F.col("n") / PIECE), F.ceil(F.col("shingles") / PIECE_SHINGLES)).cast("int")
    placed = members.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("key", F.lit(1)), F.col("pieces")).cast("int"))
    shares = placed.select("bucket", "key", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    shares = shares.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("share"), "key")
    spread = shares.join(sets, "key").select("share", "key", "shingles").repartition("share").sortWithinPartitions("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, keys, held = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            edges = forest(held)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i, _ in edges]), pa.array([keys[j] for _, j in edges])], names=["a", "b"])

        for batch in batches:
            for s, k, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != share:
                    yield from flush()
                    share, keys, held = s, [], []
                keys.append(k)
                held.append(np.frombuffer(raw, np.uint64))
        yield from flush()

    return spread.mapInArrow(run, "a long, b long")


def with_root(narrow: DataFrame) -> DataFrame:
    """``(__id, __h, __root)`` of every row ``(__id, __h, __text)``: equal roots are one component."""
    sketches = stored(_sketches(narrow))
    roots = components(links(narrow, sketches), "a", "b")
    found = sketches.select("__id", "__h", "key").join(roots, F.col("key") == F.col("node"), "left")
    return found.select("__id", "__h", F.coalesce("root", "key").alias("__root"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component of near copies, chosen as in :func:`simhash.keep_one`. Texts without
    words are one component."""
    return simhash.keep_one(docs, id_col, text, with_root)
