"""Fuzzy line deduplication: MinHash of character shingles, banding, exact Jaccard, union-find over lines.

Lines are compared in lower case (A-Z) with white space runs as one blank and none at the ends. Equal lines are one line.
Signatures of ``BANDS`` x ``ROWS`` minima give each line its buckets; a pair at the threshold shares one with a chance
of 1 - (1 - 0.8^4)^12 = 0.998, a pair at 0.9 with 0.999997. In a bucket the exact Jaccard similarity of the shingle
sets decides; large buckets are dealt out as pairs of pieces. All links become components, of which the first line stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.spans import once
from spanlake.llm.blocks import LOWER, blocks
from spanlake.llm.graph import components
from spanlake.llm.storage import stored

#: Characters of a shingle, and the similarity from which lines link (a fraction).
SHINGLE, ALIKE = 7, (4, 5)
BANDS, ROWS, SEED = 12, 4, 11
#: Lines of a bucket that are compared in one piece.
PIECE = 1024
#: Up to so many lines are compared set by set.
FEW = 8
#: Text that signatures are made of at a time.
PART_BYTES = 2 << 20
#: Characters whose shingles are hashed together, so that they stay in the processor's cache.
SIGNED = 1 << 16


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def normal(line: bytes) -> bytes:
    """The form in which lines are compared, of a line in which A-Z are lowered."""
    return b" ".join(line.split())  # splits at blanks and the controls 9 to 13


def cut_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """Row, position, compared form and XXH64 of the non-blank lines of the texts."""
    lower = LOWER.tobytes()
    rows, places, lines = [], [], []
    for i, raw in enumerate(texts.cast(pa.binary()).to_pylist()):
        for pos, part in enumerate(raw.translate(lower).split(b"\n") if raw else ()):
            line = normal(part)
            if line:
                rows.append(i)
                places.append(pos)
                lines.append(line)
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in lines), np.uint64, len(lines)).view(np.int64)
    return np.array(rows, np.int64), np.array(places, np.int32), lines, hashes


def cut(docs: DataFrame, text: str, id_col: str | None = None) -> DataFrame:
    """``(id, key, pos, h, keys)``: where the non-blank lines of all texts are, by the hash of their compared form. ``keys`` are
    the buckets of the line; null for a line that its block has named before, and for one shorter than a shingle."""
    own = F.col(id_col) if id_col else F.lit(None).cast("long")
    source = docs.select(own.alias("id"), text_key(text).alias("key"), F.col(text).cast("string").alias("text"))
    more = [T.StructField("pos", T.IntegerType()), T.StructField("h", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([*source.schema.fields[:2], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, to, _ in blocks(whole.column(2), PART_BYTES):
                batch = whole.slice(at, to - at)
                rows, pos, lines, hashes = cut_lines(batch.column(2))
                ids = [batch.column(i).take(pa.array(rows)) for i in (0, 1)]
                first = np.unique(hashes, return_index=True)[1]
                named = {int(i): s for i, s in zip(first, (lines[i].decode() for i in first)) if len(s) >= SHINGLE}
                signed = np.zeros(len(lines), bool)
                signed[list(named)] = True
                keys = signatures([named[i] for i in np.flatnonzero(signed).tolist()])
                ends = np.concatenate([[0], np.cumsum(signed * BANDS)]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(~signed, False)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([*ids, pa.array(pos), pa.array(hashes), column], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def line_texts(docs: DataFrame, text: str) -> DataFrame:
    """``(h, line)`` of all texts; a line found twice in a block comes once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, _ in blocks(batch.column(0), PART_BYTES):
                _, _, lines, hashes = cut_lines(batch.column(0).slice(at, to - at))
                hashes, first = np.unique(hashes, return_index=True)
                found = pa.array([lines[i] for i in first], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(hashes), found], names=["h", "line"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "h long, line string")


def signatures(lines: list[str]) -> np.ndarray:
    """A row of bucket keys per line; every line must have a shingle."""
    ends = np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)))
    out = np.empty((len(lines), BANDS), np.int64)
    at = 0
    while at < len(lines):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SIGNED, side="right")))
        _sign(lines[at:to], out[at:to])
        at = to
    return out


def _sign(lines: list[str], out: np.ndarray) -> None:
    rng = np.random.default_rng(SEED)
    spread = rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    turn = rng.integers(0, 1 << 31, (BANDS, ROWS), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    inside = np.ones(len(points), bool)
    end = np.cumsum(size)
    for back in range(1, SHINGLE):
        inside[end - back] = False
    n = len(points) - SHINGLE + 1
    rolled = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        rolled += points[j : n + j] * spread[j]
    shingles = (rolled[inside[:n]] >> np.uint64(32)).astype(np.uint32)
    first = np.cumsum(size - SHINGLE + 1) - (size - SHINGLE + 1)
    turned = np.empty_like(shingles)
    for band in range(BANDS):
        key = np.zeros(len(lines), np.uint64)
        for row in range(ROWS):
            np.multiply(shingles, turn[band, row], out=turned)
            key = (key ^ np.minimum.reduceat(turned, first)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, band] = (band << 32) | (key >> np.uint64(32)).astype(np.int64)


def shingle_sets(lines: list[str]) -> list[np.ndarray]:
    """The shingles of each line as sorted distinct numbers, equal exactly for equal shingles of these lines.

    Seven characters of 8 bits, or of 9 bits where at most 512 different ones occur, are one number; with more of them
    the shingles are numbered. A line shorter than a shingle is one of its own kind (highest bit, length, characters).
    """
    whole = "".join(lines)
    n = len(whole)
    if whole.isascii():
        # the eight bytes from each place on, as one number, without the last
        bits, points = 8, np.frombuffer(whole.encode() + bytes(8), np.uint8)
        codes = np.ndarray((n,), np.dtype("<u8"), points, strides=(1,)) & np.uint64((1 << 8 * SHINGLE) - 1)
    else:
        bits, points = 9, np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if points.max() >= 512:
            alphabet, points = np.unique(points, return_inverse=True)
            if len(alphabet) > 512:
                number: dict[str, int] = {}
                spelled = ((line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))) for line in lines)
                return [np.unique(np.fromiter((number.setdefault(s, len(number)) for s in own), np.uint64)) for own in spelled]
        points = np.concatenate((points, np.zeros(SHINGLE, points.dtype))).astype(np.uint64)
        codes = points[:n].copy()
        for j in range(1, SHINGLE):
            codes |= points[j : n + j] << np.uint64(bits * j)
    out, at = [], 0
    for line in lines:
        if len(line) >= SHINGLE:
            own = codes[at : at + len(line) - SHINGLE + 1]
            own.sort()
            repeated = own[1:] == own[:-1]
            out.append(np.delete(own, np.flatnonzero(repeated)) if repeated.any() else own)
        else:
            value = sum(int(p) << (bits * j) for j, p in enumerate(points[at : at + len(line)]))
            out.append(np.array([1 << 63 | len(line) << 54 | value], np.uint64))
        at += len(line)
    return out


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold, exactly."""
    top, bottom = ALIKE
    if bottom * min(len(a), len(b)) < top * max(len(a), len(b)):
        return False
    merged = np.concatenate((a, b))
    merged.sort(kind="stable")
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return bottom * both >= top * (len(a) + len(b) - both)


def forest(lines: list[str]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the lines: each line reached is compared with those not reached yet, so a
    dense bucket costs little more than its size."""
    sets = shingle_sets(lines)
    if len(lines) > FEW:
        return _forest_of_many(sets)
    left = list(range(len(lines)))
    edges = []
    while len(left) > 1:
        stack = [left.pop(0)]
        while stack and left:
            at = stack.pop()
            reached = [i for i in left if alike(sets[at], sets[i])]
            if reached:
                edges += [(at, i) for i in reached]
                stack += reached
                near = set(reached)
                left = [i for i in left if i not in near]
    return edges


def _forest_of_many(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """The same search with the shingles numbered, so that one line is compared with all others in a few array steps."""
    top, bottom = ALIKE
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    found, flat = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    coded = np.split(flat, first[1:])
    has = np.zeros(len(found), bool)
    inside, alive = np.arange(len(sets)), np.ones(len(sets), bool)
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


def links(docs: DataFrame, text: str = "text", piece: int = PIECE, cuts: DataFrame | None = None) -> DataFrame:
    """``(a, b)``: hashes of lines that link, a spanning forest per bucket and piece. ``cuts`` may hold :func:`cut` of ``docs``."""
    cuts = cut(docs, text) if cuts is None else cuts
    single = cuts.where(F.col("keys").isNotNull()).select(F.explode("keys").alias("bucket"), "h").repartition("bucket").dropDuplicates(["bucket", "h"])
    own = Window.partitionBy("bucket")
    # similar lines share many buckets: of buckets with the same members (told by two hashes of all of them) one is enough
    same = {"n": F.count("*").over(own), "x": F.bit_xor("h").over(own), "y": F.bit_xor(F.xxhash64("h")).over(own)}
    found = stored(single.withColumns(same).where("n > 1"))
    chosen = found.groupBy("n", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket")
    members = stored(found.join(chosen, "bucket", "left_semi").select("bucket", "h", "n"))
    wanted = stored(members.select("h").distinct())
    texts = stored(line_texts(docs, text).join(wanted, "h", "left_semi").dropDuplicates(["h"]))
    pieces = F.ceil(F.col("n") / piece).cast("int")
    placed = members.withColumn("pieces", pieces).withColumn("own", F.pmod(F.xxhash64("h", F.lit(1)), F.col("pieces")).cast("int"))
    shares = placed.select("bucket", "h", "own", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("other"))
    shares = shares.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("share"), "h")
    spread = shares.join(texts, "h").select("share", "h", "line").repartition("share").sortWithinPartitions("share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        share, hashes, lines = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            edges = forest(lines)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([hashes[i] for i, _ in edges]), pa.array([hashes[j] for _, j in edges])], names=["a", "b"])

        for batch in batches:
            for s, h, line in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if s != share:
                    yield from flush()
                    share, hashes, lines = s, [], []
                hashes.append(h)
                lines.append(line)
        yield from flush()

    return spread.mapInArrow(run, "a long, b long")


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, key, dropped)``: the positions (from 0) of the lines of a text that an earlier line stands for.

    The first line of a component is that of the smallest id (null ids last), then text hash, then position. Rows with
    equal ids and texts are one. Blank lines are never dropped; lines shorter than a shingle only for equal ones.
    """
    cuts = stored(cut(docs, text, id_col))
    roots = components(links(docs, text, cuts=cuts), "a", "b")
    rooted = cuts.select("id", "key", "pos", "h").join(roots, F.col("h") == F.col("node"), "left").select("id", "key", "pos", F.coalesce("root", "h").alias("root"))
    rooted = stored(rooted)
    place = F.struct(F.col("id").isNull().alias("n"), "id", "key", "pos")
    first = rooted.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").select("root", "first")
    later = rooted.join(first, "root").where(place != F.col("first"))
    return later.groupBy("id", "key").agg(F.collect_set("pos").alias("dropped"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one line of every component left in its text, and ``n_lines`` and ``n_kept`` (blank lines count).

    Null texts stay null with no lines; columns of these two names are replaced.
    """
    out = [c for c in docs.columns if c not in ("n_lines", "n_kept")]
    found = dropped_lines(docs, id_col, text).select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.col("dropped").alias("__dropped"))
    joined = docs.select(*out).join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key")), "left")
    ends = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    n_lines = F.coalesce(ends + 1, F.lit(0)).cast("long")
    # only texts that lose a line are split, and those once
    joined = once(joined, __lines=F.when(F.col("__dropped").isNotNull(), F.split(F.col(text), "\n", -1)))
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__dropped"))
    left = F.array_join(F.transform(keep, lambda i: F.element_at("__lines", i + 1)), "\n")
    return joined.select(
        *(F.when(F.col("__dropped").isNull(), F.col(c)).otherwise(left).alias(c) if c == text else F.col(c) for c in out),
        n_lines.alias("n_lines"),
        (n_lines - F.coalesce(F.size("__dropped"), F.lit(0)) * F.col("__dropped").isNotNull().cast("int")).cast("long").alias("n_kept"),
    )
