"""Token counts of byte-level BPE at every prefix, by dynamic programming over bytes.

The encoding of a prefix ends with the one vocabulary entry that ends there and whose pair with the last token of what
stands before it is left alone by the merges. So one pass over the bytes of a piece (what the tokenizer's splitting
pattern cuts out) gives the count at each of its prefixes, and counts of whole pieces add up along the text. The passes
of all distinct pieces of a block run side by side in NumPy. Pieces of a block are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from spanlake.llm.blocks import blocks, sums, xxh64

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Texts are counted together up to so many bytes.
PART_BYTES = 2 << 20
#: Longer pieces are counted one by one.
LONGEST = 64


@lru_cache(maxsize=4)
def char_classes(spec: str) -> np.ndarray:
    """Letter, number, other or space for every code point, as the tokenizer itself tells them apart.

    A sign behind a letter, a digit or an exclamation mark starts a piece of its own unless it is of that class.
    """
    split = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
    out = np.full(0x110000, OTHER, np.uint8)
    # planes without letters, numbers or blanks are left out
    left = np.array([c for c in range(0x40000) if not 0xD800 <= c < 0xE000])
    for kind, before in ((OTHER, "!"), (LETTER, "x"), (NUMBER, "1")):
        text = "".join(before + chr(c) for c in left)
        starts = np.zeros(len(text), bool)
        starts[[a for _, (a, _) in split(text)]] = True
        same = ~starts[1::2]
        out[left[same]] = kind
        left = left[~same]
    out[left] = SPACE
    return out


def piece_starts(points: np.ndarray, text_start: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True where a piece of the splitting pattern begins; texts follow each other without a separator.

    The pattern is that of byte-level BPE: contractions, then runs of letters, numbers or other signs with one blank
    before them, then white space, which leaves its last character alone when something follows.
    """
    kind = classes[points]
    first = np.zeros(len(points) + 1, bool)
    first[text_start[text_start < len(points)]] = True
    cut = first.copy()
    cut[1:-1] |= kind[1:] != kind[:-1]
    cut[-1] = True
    runs = np.flatnonzero(cut[:-1])
    size = np.diff(np.append(runs, len(points)))
    run_kind = kind[runs]
    after = runs + size
    followed = (after < len(points)) & ~first[after]
    space = run_kind == SPACE
    last = points[after - 1]
    gives = space & followed & (last == 32)
    at = after[gives]
    cut[at] = False
    cut[at - 1] = True
    cut[after[space & followed & (last != 32)] - 1] = True
    # a lone apostrophe with no blank before it takes s, t, m, d, re, ve or ll from the letters behind it
    given_to = np.zeros(len(runs), bool)
    given_to[1:] = gives[:-1]
    quote = np.flatnonzero((run_kind == OTHER) & (size == 1) & (points[runs] == 39) & followed & ~given_to)
    quote = quote[run_kind[quote + 1] == LETTER] if len(quote) else quote
    if len(quote):
        a = runs[quote + 1]
        one = points[a]
        two = np.where(size[quote + 1] > 1, points[np.minimum(a + 1, len(points) - 1)], 0)
        taken = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for pair in ("re", "ve", "ll"):
            taken = np.where((one == ord(pair[0])) & (two == ord(pair[1])), 2, taken)
        a, taken = a[taken > 0], taken[taken > 0]
        cut[a] = False
        cut[a + taken] = True
    return cut[:-1]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for the 256 bytes in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts of one tokenizer (byte-level BPE without normalizer and prefix space), from the text of its JSON file."""

    def __init__(self, spec: str, classes: np.ndarray):
        spec = json.loads(spec)
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE")
        self.classes = classes
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        # tokens are numbered by the merge that makes them, bytes first
        self.ids = {bytes([b]): b for b in range(256)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        n = 256 + len(merges)
        self.left, self.right = np.arange(n), np.arange(n)
        for i, (a, b) in enumerate(merges, 256):
            a, b = raw(a), raw(b)
            self.left[i], self.right[i] = self.ids[a], self.ids[b]
            if self.ids.setdefault(a + b, i) != i:
                raise ValueError("two merges make one token")
        key = self.left[256:] << 32 | self.right[256:]
        order = np.argsort(key)
        self.pair_key, self.pair_id = key[order], order + 256
        if not self._stay(self.left[256:], self.right[256:], np.arange(256, n)).all():
            raise ValueError("a token's own bytes are encoded otherwise")
        self.longest = max(map(len, self.ids))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, added))) if added else None
        self._make_trie()
        self._memo_key = np.full(1 << 20, -1, np.int64)
        self._memo = np.zeros(1 << 20, bool)

    def _make_trie(self) -> None:
        children: dict[bytes, None] = {b"": None}
        nodes: dict[bytes, None] = {b"": None}
        for token in self.ids:
            for i in range(1, len(token) + 1):
                nodes.setdefault(token[:i])
                if i < len(token):
                    children.setdefault(token[:i])
        inner = {p: i for i, p in enumerate(children)}
        self.dead = len(inner)
        number = inner | {p: self.dead + 1 + i for i, p in enumerate(p for p in nodes if p not in inner)}
        self.next = np.full((self.dead + 1, 256), self.dead, np.int32)
        self.token = np.full(len(nodes) + 1, -1, np.int64)
        for p, i in number.items():
            if p:
                self.next[inner[p[:-1]], p[-1]] = i
                self.token[i] = self.ids.get(p, -1)

    def _stay(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether merges leave each pair of adjacent tokens as it is: both are taken apart again, latest merge first,
        and no pair that meets at the border may have an earlier merge than what was still to come."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), 1 << 40) if limit is None else limit.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, most = a[live], b[live], limit[live]
            key = x << 32 | y
            at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
            bad = (self.pair_key[at] == key) & (self.pair_id[at] < most)
            out[live[bad]] = False
            live, x, y = live[~bad], x[~bad], y[~bad]
            # single bytes cannot be taken apart; the other side then is
            from_left = ((x > y) & (x >= 256)) | (y < 256)
            done = from_left & (x < 256)
            limit[live] = np.where(from_left, x, y + 1)
            a[live] = np.where(from_left, self.right[x], x)
            b[live] = np.where(from_left, y, self.left[y])
            live = live[~done]
        return out

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """:meth:`_stay` with a memory of recent pairs."""
        key = a << 32 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        new = np.flatnonzero(self._memo_key[slot] != key)
        out = self._memo[slot]
        if len(new):
            distinct, inverse = np.unique(key[new], return_inverse=True)
            known = self._stay(distinct >> 32, distinct & 0xFFFFFFFF)
            out[new] = known[inverse]
            self._memo_key[slot[new]] = key[new]
            self._memo[slot[new]] = out[new]
        return out

    def prefixes(self, pieces: np.ndarray) -> np.ndarray:
        """Token counts of the prefixes of pieces of one length: rows of bytes give rows of counts, one column more."""
        n, size = pieces.shape
        counts = np.zeros((size + 1, n), np.int32)
        last = np.full((size + 1, n), -1, np.int64)
        columns = np.ascontiguousarray(pieces.T)
        for start in range(size):
            who = np.arange(n) if start == 0 else np.flatnonzero(counts[start] > 0)
            node = np.zeros(len(who), np.int32)
            for end in range(start + 1, min(size, start + self.longest) + 1):
                node = self.next[node, columns[end - 1, who]]
                token = self.token[node]
                good = np.flatnonzero(token >= 0)
                if start:
                    good = good[self.stay(last[start, who[good]], token[good])]
                counts[end, who[good]] = counts[start, who[good]] + 1
                last[end, who[good]] = token[good]
                more = node < self.dead
                if not more.any():
                    break
                who, node = who[more], node[more]
        return counts.T

    def long_prefixes(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, byte by byte."""
        counts, last, known = [0], [-1], {}
        for end in range(1, len(piece) + 1):
            for start in range(max(0, end - self.longest), end):
                token = self.ids.get(piece[start:end])
                if token is None:
                    continue
                pair = (last[start], token)
                if start and pair not in known:
                    known[pair] = bool(self._stay(np.array(pair[:1]), np.array(pair[1:]))[0])
                if not start or known[pair]:
                    counts.append(counts[start] + 1)
                    last.append(token)
                    break
        return np.array(counts)

    def of_pieces(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each byte range that is a piece."""
        _, at, inverse = np.unique(xxh64(data, start, end), return_index=True, return_inverse=True)
        begin, size = start[at], end[at] - start[at]
        found = np.zeros(len(at), np.int64)
        order = np.argsort(np.minimum(size, LONGEST + 1), kind="stable")
        cuts = np.searchsorted(size[order], np.arange(LONGEST + 2))
        for length in range(1, LONGEST + 1):
            for low in range(cuts[length], cuts[length + 1], 100_000):
                rows = order[low : min(low + 100_000, cuts[length + 1])]
                found[rows] = self.prefixes(data[begin[rows][:, None] + np.arange(length)])[:, -1]
        for i in order[cuts[LONGEST + 1] :]:
            found[i] = self.long_prefixes(data[begin[i] : begin[i] + size[i]].tobytes())[-1]
        return found[inverse]

    def table(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ends of pieces (characters), tokens of each, and the bounds of each text among the pieces.

        An added token inside a text is a piece with one token.
        """
        parts, special, part_of = [], [], []
        for i, t in enumerate(texts):
            at = 0
            for m in self.special.finditer(t) if self.special else ():
                parts += [t[at : m.start()], m.group()]
                special += [False, True]
                part_of += [i, i]
                at = m.end()
            parts.append(t[at:])
            special.append(False)
            part_of.append(i)
        joined = "".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        part_size = np.fromiter(map(len, parts), np.int64, len(parts))
        part_start = np.cumsum(part_size) - part_size
        cut = piece_starts(points, part_start, self.classes)
        for p in np.flatnonzero(special):
            cut[part_start[p] + 1 : part_start[p] + part_size[p]] = False
        begin = np.flatnonzero(cut)
        end = np.append(begin[1:], len(points))[: len(begin)]
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        byte = np.concatenate([[0], np.cumsum(width)])
        data = np.append(np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8), np.zeros(8, np.uint8))
        counts = self.of_pieces(data, byte[begin], byte[end]) if len(begin) else np.zeros(0, np.int64)
        counts[np.searchsorted(begin, part_start[np.array(special, bool)])] = 1
        text_size = np.fromiter(map(len, texts), np.int64, len(texts))
        text_start = np.cumsum(text_size) - text_size
        bounds = np.append(np.searchsorted(begin, text_start), len(begin))
        return end - np.repeat(text_start, np.diff(bounds)), counts, bounds

    def at(self, text: str, ends: list[int], counts: list[int], n: int) -> int:
        """Tokens of ``text[:n]`` from the stored counts: only the piece that is cut, and the one before it, which a cut
        in white space or in a contraction may change, are looked at."""
        k = max(0, bisect_left(ends, n) - 1)
        return (counts[k - 1] if k else 0) + int(self.table([text[ends[k - 1] if k else 0 : n]])[1].sum())

    def within_piece(self, text: str, ends: list[int], counts: list[int], k: int) -> list[int]:
        """Tokens of ``text[:n]`` for every ``n`` behind the start of piece ``k``, up to its end.

        One pass over the bytes of the piece; cuts that change the pieces themselves (in an added token, in a contraction,
        behind white space) are counted by :meth:`at`.
        """
        start, before = (ends[k - 1], counts[k - 1]) if k else (0, 0)
        piece = text[start : ends[k]]
        blank = [self.classes[ord(c)] == SPACE for c in piece]
        added = self.special is not None and self.special.fullmatch(piece)
        run = all(blank) and not (start and self.classes[ord(text[start - 1])] == SPACE)
        if added or len(piece) <= 3 or (all(blank) and not run):
            return [self.at(text, ends, counts, start + i) for i in range(1, len(piece) + 1)]
        raw = piece.encode("utf-8", "surrogatepass")
        found = self.prefixes(np.frombuffer(raw, np.uint8)[None, :])[0] if len(raw) <= LONGEST else self.long_prefixes(raw)
        byte = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in piece])
        made = (before + found[byte]).tolist()
        return [self.at(text, ends, counts, start + i) if blank[i - 1] and not run else n for i, n in enumerate(made, 1)]

    def fit(self, text: str, ends: list[int], counts: list[int], budget: int) -> int:
        """Characters of the longest prefix within ``budget`` tokens.

        Counts inside a piece may fall again, so the last prefix within the budget is taken, not the one before the first
        above it. A cut changes at most the piece before the one it is in, so no prefix beyond the second piece that
        ends above the budget can fit.
        """
        k = bisect_right(counts, budget)
        for i in range(min(k + 1, len(ends) - 1), k - 1, -1):
            start = ends[i - 1] if i else 0
            # of the second piece, only cuts that join it to the piece before can fit
            if i > k and ends[i] - start > 3 and not (self.special and self.special.fullmatch(text, start, ends[i])):
                if self.classes[ord(text[start])] == SPACE and self.at(text, ends, counts, start + 1) <= budget:
                    return start + 1
                continue
            for n, count in reversed(list(enumerate(self.within_piece(text, ends, counts, i), start + 1))):
                if count <= budget:
                    return n
        return ends[k - 1] if k else 0


def _each(docs: DataFrame, tokenizer: str, text: str, made: dict, fn: Callable, keep: bool, extra: tuple[str, ...] = ()) -> DataFrame:
    with open(tokenizer, encoding="utf-8") as f:  # the driver's file; its text travels to the tasks
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, char_classes(spec)))
    passed = [c for c in docs.columns if c not in made and (keep or c != text)]
    schema = T.StructType([*(docs.schema[c] for c in passed), *(T.StructField(k, v) for k, v in made.items())])
    source = docs.select(*passed, F.col(text).cast("string").alias("__text"), *(F.col(c).alias(f"__{c}") for c in extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(*shared.value)
        for batch in batches:
            column = batch.column(len(passed))
            for at, to, _ in blocks(column, PART_BYTES):
                part = batch.slice(at, to - at)
                texts = [t or "" for t in part.column(len(passed)).to_pylist()]
                more = [part.column(i).to_pylist() for i in range(len(passed) + 1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(passed)], *fn(counter, texts, *more)], names=schema.fieldNames())

    return source.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "n_tokens", keep: bool = False) -> DataFrame:
    """``docs`` (without its text unless ``keep``) with ``out``: tokens of the whole text; null and empty texts have 0.

    ``tokenizer`` is the path of a byte-level BPE file on the driver. Added tokens inside a text count as one each; no
    begin or end token is added. A column ``out`` is replaced. One narrow pass.
    """

    def count(counter: PrefixCounter, texts: list[str]):
        _, counts, bounds = counter.table(texts)
        return (pa.array(sums(counts, bounds)),)

    return _each(docs, tokenizer, text, {out: T.LongType()}, count, keep)


def prefix_counts(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ends`` (characters) and ``counts`` (tokens so far) at every piece; both empty without a text.

    Counts inside a piece are made from these when a cut needs them; see :func:`truncate` and ``PrefixCounter.at``.
    """

    def table(counter: PrefixCounter, texts: list[str]):
        ends, counts, bounds = counter.table(texts)
        run = np.concatenate([[0], np.cumsum(counts)])
        so_far = run[1:] - np.repeat(run[bounds[:-1]], np.diff(bounds))
        return tuple(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(v, pa.int32())) for v in (ends, so_far))

    ints = T.ArrayType(T.IntegerType())
    return _each(docs, tokenizer, text, {"ends": ints, "counts": ints}, table, True)


def truncate(tables: DataFrame, tokenizer: str, budget: int, text: str = "text", out: str = "fits") -> DataFrame:
    """``tables`` of :func:`prefix_counts` with ``out``: characters of the prefix within ``budget`` tokens (all of a text
    that fits). The stored counts answer it but for the piece that is cut, whose prefixes are counted in one pass."""

    def fit(counter: PrefixCounter, texts: list[str], ends: list, counts: list):
        return (pa.array([counter.fit(*row, budget) for row in zip(texts, ends, counts)], pa.int32()),)

    return _each(tables, tokenizer, text, {out: T.IntegerType()}, fit, True, ("ends", "counts"))
