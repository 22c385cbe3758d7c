"""Texts of an Arrow column as byte blocks, their words, and XXH64 of many byte ranges at once (NumPy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Texts are taken together up to so many bytes; one longer text is a block of its own.
BLOCK_BYTES = 8 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the bytes in the ranges (inclusive)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


class Block:
    """Texts laid out one after another, each followed by a newline byte; a null text counts as empty."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        n = len(texts)
        size = int(offsets[-1] - offsets[0])
        self.start = offsets[:-1] - offsets[0] + np.arange(n)
        self.end = offsets[1:] - offsets[0] + np.arange(n)
        # eight more bytes, so that a word's last bytes can be read as one 64-bit lane
        self.data = np.full(size + n + 8, 10, dtype=np.uint8)
        if size:
            inside = np.ones(size + n, dtype=bool)
            inside[self.end] = False
            self.data[: size + n][inside] = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]

    def __len__(self) -> int:
        return len(self.start)

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the maximal runs of member bytes; the newlines between texts must not be members."""
        flags = np.zeros(len(self.data) - 6, dtype=np.int8)
        flags[1:-1] = member[self.data[:-8]]
        edges = np.flatnonzero(np.diff(flags))
        return edges[::2], edges[1::2]

    def of_text(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions lie before each text, and in all: bounds for per-text reductions."""
        return np.append(np.searchsorted(positions, self.start), len(positions))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """Row ranges of the column with their blocks, cut by bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield at, to, Block(texts.slice(at, to - at))
        at = to


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]


_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
)  # fixed values: the primes of XXH64
SEED = 42
#: Longer ranges are hashed one by one by the library.
LONGEST_LANES = 512


def _rotl(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def _hash_equal_lengths(data: np.ndarray, start: np.ndarray, size: int, seed: int) -> np.ndarray:
    n = len(data)
    wide = np.ndarray((n - 7,), np.dtype("<u8"), data, strides=(1,))
    half = np.ndarray((n - 3,), np.dtype("<u4"), data, strides=(1,))
    at = 0
    with np.errstate(over="ignore"):
        s = np.uint64(seed)
        if size >= 32:
            v = [np.full(len(start), x, np.uint64) for x in (s + _P1 + _P2, s + _P2, s, s - _P1)]
            while at + 32 <= size:
                v = [_round(acc, wide[start + (at + 8 * i)]) for i, acc in enumerate(v)]
                at += 32
            h = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
            for acc in v:
                h = (h ^ _round(np.uint64(0), acc)) * _P1 + _P4
        else:
            h = np.full(len(start), s + _P5, np.uint64)
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _rotl(h ^ _round(np.uint64(0), wide[start + at]), 27) * _P1 + _P4
            at += 8
        if at + 4 <= size:
            h = _rotl(h ^ (half[start + at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at += 4
        while at < size:
            h = _rotl(h ^ (data[start + at].astype(np.uint64) * _P5), 11) * _P1
            at += 1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range. ``data`` must have eight bytes behind the last range."""
    out = np.empty(len(start), np.uint64)
    size = end - start
    long = np.flatnonzero(size > LONGEST_LANES)
    for i in long:
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]].tobytes(), seed)
    order = np.argsort(np.minimum(size, LONGEST_LANES + 1).astype(np.uint16), kind="stable")
    cuts = np.searchsorted(size[order], np.arange(LONGEST_LANES + 2))
    for length in np.flatnonzero(np.diff(cuts)):
        rows = order[cuts[length] : cuts[length + 1]]
        out[rows] = _hash_equal_lengths(data, start[rows], int(length), seed)
    return out
