"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of blocks: a block holds the sorted term hashes of some whole texts and, per term, the gaps between
its word positions. A search meets each block once: it starts from the rarest term of a phrase there and intersects the
offset-adjusted position lists of its other terms in order of rarity. Blocks are independent, so a very frequent term or
source is spread over all of them, and a lost task repeats its own blocks only.

Terms are 64-bit hashes; a phrase of n words is confused with another with a chance of 2^-64 to the power n per position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.llm.blocks import LOWER, Block, blocks, byte_class, xxh64
from spanlake.llm.storage import stored
from spanlake.session import cut_lineage

WINDOW = 10
#: Digits, letters and every byte of a character beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes of benchmark text whose windows go to the executors in one broadcast; more text is searched in several passes.
PASS_BYTES = 4 << 20
#: Candidate positions looked at together.
MOST_CANDIDATES = 2_000_000


def words_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a block's words, and the bounds of each text among them."""
    start, end = block.runs(WORD)
    return xxh64(LOWER[block.data], start, end), block.of_text(start)


class Postings:
    """Position lists of a block. A position is a word's place plus its text's place, so texts never adjoin."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, positions: np.ndarray, text_start: np.ndarray):
        self.terms, self.first, self.positions, self.text_start = terms, first, positions, text_start
        self.span = int(text_start[-1]) + 1
        self.keys = np.repeat(np.arange(len(terms)), np.diff(first)) * self.span + positions

    @classmethod
    def of(cls, hashes: np.ndarray, bounds: np.ndarray) -> Postings:
        text_start = bounds + np.arange(len(bounds))
        order = np.argsort(hashes, kind="stable")
        ordered = hashes[order]
        cut = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        return cls(ordered[cut], np.append(cut, len(ordered)), (np.arange(len(hashes)) + text)[order], text_start)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        gaps = np.diff(self.positions, prepend=0).astype(np.int32)
        heads = self.first[:-1]
        gaps[heads] = self.positions[heads]
        return self.terms.astype("<u8").tobytes(), self.first.astype("<i4").tobytes(), gaps.astype("<i4").tobytes()

    @classmethod
    def unpacked(cls, terms: bytes, first: bytes, gaps: bytes, n_words: np.ndarray) -> Postings:
        terms, first = np.frombuffer(terms, "<u8"), np.frombuffer(first, "<i4").astype(np.int64)
        run = np.concatenate([[0], np.cumsum(np.frombuffer(gaps, "<i4"), dtype=np.int64)])
        positions = run[1:] - np.repeat(run[first[:-1]], np.diff(first))
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        return cls(terms, first, positions, bounds + np.arange(len(bounds)))

    def rows_of(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among the terms, or -1."""
        if not len(self.terms):
            return np.full(hashes.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def has(self, row: np.ndarray, position: np.ndarray) -> np.ndarray:
        key = row * self.span + position
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return (self.keys[at] == key) & (position >= 0) & (position < self.span)

    def _by_rarity(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose terms all occur here, their term rows, and the order of their terms by frequency."""
        rows = self.rows_of(windows)
        inside = np.arange(windows.shape[1]) < sizes[:, None]
        alive = np.flatnonzero(((rows >= 0) | ~inside).all(axis=1))
        rows = rows[alive]
        often = np.where(inside[alive], np.diff(self.first)[rows], np.iinfo(np.int64).max) if len(alive) else rows
        return alive, rows, np.argsort(often, axis=1, kind="stable")

    def _anchors(self, rows: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index of window, position) of the rarest terms, in bounded pieces of windows."""
        rarest = np.take_along_axis(rows, order[:, :1], axis=1)[:, 0]
        count = np.diff(self.first)[rarest]
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(total, total[at] + MOST_CANDIDATES, side="right")) - 1)
            which = np.repeat(np.arange(at, to), count[at:to])
            place = np.arange(total[at], total[to]) - np.repeat(total[at:to], count[at:to])
            yield which, self.positions[self.first[rarest[which]] + place]
            at = to

    def phrases(self, windows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its first word) of every occurrence."""
        alive, rows, order = self._by_rarity(windows, sizes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for which, position in self._anchors(rows, order) if len(alive) else ():
            start = position - order[which, 0]
            for rank in range(1, windows.shape[1]):
                offset = order[which, rank]
                beyond = offset >= sizes[alive[which]]
                keep = beyond | self.has(rows[which, offset], start + offset)
                which, start = which[keep], start[keep]
            found.append((alive[which], start))
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *(w for w, _ in found)]), np.concatenate([none, *(s for _, s in found)])

    def near(self, windows: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, start): stretches of ``width`` words of one text that hold all words of a window, in any order."""
        alive, rows, order = self._by_rarity(windows, sizes)
        found = set()
        for which, position in self._anchors(rows, order) if len(alive) else ():
            text = np.searchsorted(self.text_start, position, side="right") - 1
            low, high = self.text_start[text], self.text_start[text + 1] - 1
            for back in range(width):
                start = np.maximum(position - back, low)
                end = np.minimum(start + width, high)
                ok = np.ones(len(which), bool)
                for k in range(windows.shape[1]):
                    row = np.maximum(rows[which, k], 0)
                    at = np.searchsorted(self.keys, row * self.span + start)
                    inside = (at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] < row * self.span + end)
                    ok &= inside | (k >= sizes[alive[which]])
                found |= set(zip(alive[which[ok]].tolist(), start[ok].tolist()))
        pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The index of whole texts: one row per block with ``id``, ``key`` (hash of the text) and ``n_words`` of its texts
    in order, and ``terms``, ``first``, ``gaps`` (packed little-endian arrays). Null texts have no words."""
    id_type = docs.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("id", T.ArrayType(id_type)),
            T.StructField("key", T.ArrayType(T.LongType())),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            *(T.StructField(c, T.BinaryType()) for c in ("terms", "first", "gaps")),
        ]
    )
    source = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, block in blocks(batch.column(2)):
                hashes, bounds = words_of(block)
                one = lambda array: pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), array)
                packed = Postings.of(hashes, bounds).packed()
                yield pa.RecordBatch.from_arrays(
                    [
                        one(batch.column(0).slice(at, to - at)),
                        one(batch.column(1).slice(at, to - at)),
                        one(pa.array(np.diff(bounds), pa.int64())),
                        *(pa.array([p], pa.binary()) for p in packed),
                    ],
                    names=["id", "key", "n_words", "terms", "first", "gaps"],
                )

    return source.mapInArrow(run, schema)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def windows_of(items: list[tuple[str | None, str | None]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, list]:
    """Distinct (window, item) rows: term hashes padded to ``window``, the number of terms, the item's id."""
    seen: dict[tuple, None] = {}
    for at, _, block in blocks(pa.array([t for _, t in items], pa.string())):
        hashes, bounds = words_of(block)
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            for s in range(a, max(b - window, a) + 1) if b > a else ():
                seen.setdefault((items[at + i][0], tuple(hashes[s : min(s + window, b)].tolist())))
    table = np.zeros((len(seen), window), np.uint64)
    sizes = np.zeros(len(seen), np.int64)
    for i, (_, terms) in enumerate(seen):
        table[i, : len(terms)] = terms
        sizes[i] = len(terms)
    return table, sizes, [item for item, _ in seen]


def _passes(benchmark: DataFrame, item_col: str, text: str) -> Iterator[list[tuple]]:
    """The benchmark's items in parts of about ``PASS_BYTES`` of text."""
    items = cut_lineage(benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text).cast("string").alias("text")))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / PASS_BYTES))
    for part in range(n):
        own = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == part)
        yield [(r.item, r.text) for r in own.toLocalIterator()]


def search(index: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text: str = "text", window: int = WINDOW, width: int | None = None) -> DataFrame:
    """``(id, key, n_words, n_hit, items)`` for every text of the index.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one window. ``n_hit``
    counts the words inside any occurrence of a window, ``items`` are the distinct ids (as strings) of items with an
    occurring window; windows of an item without an id count for ``n_hit`` only. With ``width`` a window also occurs where
    all its words lie in any order within so many words, and those words' stretch is hit.

    Windows are broadcast in passes of bounded size; each pass adds to the hits of a block within its row.
    """
    spark = index.sparkSession
    fields = [f for f in index.schema.fields if f.name not in ("hits", "pairs")]
    packed = T.StructType([*fields, T.StructField("hits", T.BinaryType()), T.StructField("pairs", T.ArrayType(T.ArrayType(T.StringType())))])
    now = index.withColumns({"hits": F.lit(None).cast("binary"), "pairs": F.lit(None).cast("array<array<string>>")})

    def searcher(shared):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, sizes, items = shared.value
            for whole in batches:
                for i in range(whole.num_rows):
                    batch = whole.slice(i, 1)
                    row = {c: batch.column(c)[0] for c in ("terms", "first", "gaps", "hits", "pairs")}
                    n_words = batch.column("n_words")[0].values.to_numpy()
                    posts = Postings.unpacked(row["terms"].as_py(), row["first"].as_py(), row["gaps"].as_py(), n_words)
                    which, start = posts.phrases(table, sizes)
                    length = sizes[which]
                    if width:
                        more, place = posts.near(table, sizes, width)
                        text_end = posts.text_start[np.searchsorted(posts.text_start, place, side="right")] - 1
                        which, start = np.concatenate([which, more]), np.concatenate([start, place])
                        length = np.concatenate([length, np.minimum(width, text_end - place)])
                    step = np.zeros(posts.span + 1, np.int32)
                    np.add.at(step, start, 1)
                    np.add.at(step, start + length, -1)
                    hit = np.cumsum(step)[: posts.span] > 0
                    if row["hits"].is_valid:
                        hit |= np.unpackbits(np.frombuffer(row["hits"].as_py(), np.uint8))[: posts.span].astype(bool)
                    pairs = row["pairs"].as_py() or [[] for _ in n_words]
                    text = np.searchsorted(posts.text_start, start, side="right") - 1
                    for t, w in set(zip(text.tolist(), which.tolist())):
                        if items[w] is not None and items[w] not in pairs[t]:
                            pairs[t].append(items[w])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(batch.column(f.name) for f in fields),
                            pa.array([np.packbits(hit).tobytes()], pa.binary()),
                            pa.array([pairs], pa.list_(pa.list_(pa.string()))),
                        ],
                        names=packed.fieldNames(),
                    )

        return run

    for items in _passes(benchmark, item_col, text):
        now = now.mapInArrow(searcher(spark.sparkContext.broadcast(windows_of(items, window))), packed)
    id_type = index.schema["id"].dataType.elementType
    out = T.StructType(
        [
            T.StructField("id", id_type),
            *(T.StructField(c, T.LongType()) for c in ("key", "n_words", "n_hit")),
            T.StructField("items", T.ArrayType(T.StringType())),
        ]
    )

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, keys, n_words, pairs = (batch.column(c)[i].values for c in ("id", "key", "n_words", "pairs"))
                n = n_words.to_numpy()
                bounds = np.concatenate([[0], np.cumsum(n)]) + np.arange(len(n) + 1)
                hit = np.concatenate([[0], np.cumsum(np.unpackbits(np.frombuffer(batch.column("hits")[i].as_py(), np.uint8)).astype(np.int64))])
                n_hit = hit[bounds[1:] - 1] - hit[bounds[:-1]]
                yield pa.RecordBatch.from_arrays([ids, keys, n_words, pa.array(n_hit), pairs], names=out.fieldNames())

    return now.select("id", "key", "n_words", "hits", "pairs").mapInArrow(unfold, out)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows whose text holds a window of the benchmark; columns as they were.

    Null and empty texts stay. The index is stored in the shared folder; the decision is joined back by id and text hash.
    """
    bad = search(stored(build_index(docs, id_col, text)), benchmark, window=window).where("n_hit > 0")
    # stored, so that its size is known and Spark joins it without a shuffle of the documents where it is small
    bad = stored(bad.select(F.col("id").alias("__id"), F.col("key").alias("__key")).distinct())
    return docs.join(bad, F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key")), "left_anti")
