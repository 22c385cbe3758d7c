"""Sentence, token and alignment expressions that work on one row at a time.

A text and everything cut from it stay in one row, so none of this shuffles and a repeated or very frequent
document id cannot skew it. Python is used for running sums and searches over ints; text stays in the JVM.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.fixed import SENTENCE_END, TOKEN
from spanlake.functions.arrays import list_column, list_parts, row_parts, running_total

_MARK = "\u0001"
_SPACE = " \t\n\f\r"


def _ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(_SPACE))


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(_SPACE))


def _sentence_pieces(text: Column) -> Column:
    """The text cut after each run of terminators and white space; the pieces concatenate to the text."""
    marked = F.regexp_replace(F.translate(text, _MARK, "\u0002"), SENTENCE_END, f"$1$2{_MARK}")
    return F.split(marked, _MARK, -1)


def token_pieces(text: Column) -> Column:
    """Tokens, each with the white space in front of it."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens of a text."""
    return F.size(token_pieces(text))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each computed exactly once per row.

    Plain projections are merged by the optimizer, which would run a regular expression again for each place
    that uses its result; the optimizer does not merge across a generator.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def with_sentences(df: DataFrame, text: Column, out: str = "sentences") -> DataFrame:
    """Adds the non-blank sentences as ``ARRAY<STRUCT<text, char_start, char_end>>``; outer white space is left out."""
    # the marker never replaces a character of the text, so a text that contains it is read back by offset
    df = once(df, _text=text, _pieces=_sentence_pieces(text), _odd=F.contains(text, F.lit(_MARK)))
    df = df.withColumn("_ends", running_total(F.transform("_pieces", F.length)))

    def span(piece: Column, end: Column) -> Column:
        start = end - F.length(_ltrim(piece))
        trimmed = _trim(piece)
        own = F.when(F.col("_odd"), F.substring(F.col("_text"), start + 1, F.length(trimmed))).otherwise(trimmed)
        return F.struct(
            own.alias("text"),
            start.cast("long").alias("char_start"),
            (start + F.length(trimmed)).cast("long").alias("char_end"),
        )

    rows = F.filter(F.zip_with("_pieces", "_ends", span), lambda s: s["char_end"] > s["char_start"])
    return once(df, **{out: rows}).drop("_text", "_pieces", "_odd", "_ends")


def with_tokens(df: DataFrame, text: Column, out: str = "tokens") -> DataFrame:
    """Adds character offsets of the tokens as ``ARRAY<STRUCT<start, end>>``."""
    df = once(df, _pieces=token_pieces(text))
    df = df.withColumn("_ends", running_total(F.transform("_pieces", F.length)))
    rows = F.zip_with(
        "_pieces",
        "_ends",
        lambda piece, end: F.struct(
            (end - F.length(_ltrim(piece))).cast("long").alias("start"), end.cast("long").alias("end")
        ),
    )
    return once(df, **{out: rows}).drop("_pieces", "_ends")


def _ints(values: pa.Array) -> np.ndarray:
    return values.to_numpy(zero_copy_only=False).astype(np.int64)


def _inner_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Running sums that start anew in each row."""
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[1:] - np.repeat(sums[bounds[:-1]], np.diff(bounds))


def _row_of(bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


class _TokenAxis:
    """The tokens of a batch of rows on one sorted axis, so that one binary search serves all rows."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, reach: int):
        wide = ends > starts
        row = _row_of(bounds)
        self.index = (np.arange(len(starts)) - np.repeat(bounds[:-1], np.diff(bounds)))[wide]
        self.stride = 2 + max(reach, int(ends.max()) if len(ends) else 0)
        self.starts = (row * self.stride + starts)[wide]
        self.ends = (row * self.stride + ends)[wide]
        if (np.diff(self.starts) < 0).any() or (np.diff(self.ends) < 0).any():
            raise ValueError("token offsets decrease within a row; use the relational align_spans")

    def _indices(self, first: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = first >= after
        if not len(self.index):
            return np.zeros(len(first), np.int64), np.zeros(len(first), np.int64), none
        lo = self.index[np.where(none, 0, first)]
        hi = self.index[np.where(none, 0, after - 1)] + 1
        return lo, hi, none

    def overlapping(self, row: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Range of the tokens that end after ``start`` and begin before ``end``, and where there is none."""
        first = np.searchsorted(self.ends, row * self.stride + start, side="right")
        after = np.searchsorted(self.starts, row * self.stride + end, side="left")
        return self._indices(first, after)

    def starting_from(self, row: np.ndarray, start: np.ndarray):
        """Range of the tokens of a row that begin at ``start`` or later, and where there is none."""
        first = np.searchsorted(self.starts, row * self.stride + start, side="left")
        after = np.searchsorted(self.starts, (row + 1) * self.stride, side="left")
        return self._indices(first, after)


def align_in_row(span_starts: Column, span_ends: Column, tok_starts: Column, tok_ends: Column) -> Column:
    """Token range of each span of a row: ``ARRAY<STRUCT<tok_start, tok_end>>``, both null when no token overlaps.

    A token belongs to a span when it ends after the span's start and begins before the span's end; zero-width
    tokens are passed over. Offsets of the other tokens must not decrease within a row, as tokenizers give them.
    """

    @F.arrow_udf("array<struct<tok_start:bigint,tok_end:bigint>>")
    def align(s0: pa.Array, s1: pa.Array, t0: pa.Array, t1: pa.Array) -> pa.Array:
        starts, bounds = list_parts(s0)
        ends, _ = list_parts(s1)
        tok_a, tok_bounds = list_parts(t0)
        tok_b, _ = list_parts(t1)
        starts, ends = _ints(starts), _ints(ends)
        axis = _TokenAxis(_ints(tok_a), _ints(tok_b), tok_bounds, int(ends.max()) if len(ends) else 0)
        lo, hi, none = axis.overlapping(_row_of(bounds), starts, ends)
        columns = [pa.array(v, pa.int64(), mask=none) for v in (lo, hi)]
        return list_column(pa.StructArray.from_arrays(columns, ["tok_start", "tok_end"]), bounds)

    return align(span_starts, span_ends, tok_starts, tok_ends)


_CUT = (
    "struct<sents:array<struct<char_start:bigint,char_end:bigint,tok_start:bigint,tok_end:bigint>>,"
    "n_tokens:bigint,resp_start:bigint,resp_end:bigint>"
)


_CUT_ARROW = pa.struct(
    [
        ("sents", pa.list_(pa.struct([(c, pa.int64()) for c in ("char_start", "char_end", "tok_start", "tok_end")]))),
        *((c, pa.int64()) for c in ("n_tokens", "resp_start", "resp_end")),
    ]
)


def _cut(piece: tuple[Column, Column, Column], tokens: tuple[Column, Column], measured: bool, shift: Column) -> Column:
    """All offsets of a row in one pass over ints: sentences in the response, tokens in prefix + response.

    ``piece`` holds length, length without leading and length without outer white space of each sentence piece.
    ``tokens`` holds the same first two of each token piece when ``measured``, else start and end offsets.
    """

    @F.arrow_udf(_CUT)
    def cut(*columns: pa.Array) -> pa.Array:
        # whole, left, core, t0, t1, at: an Arrow batch may hold very many offsets, which a few rows at a time are widened and searched
        parts = [cut_rows(*(c.slice(a, b - a) for c in columns)) for a, b in row_parts(columns[0], columns[3])]
        return pa.concat_arrays(parts) if parts else pa.array([], _CUT_ARROW)

    def cut_rows(whole: pa.Array, left: pa.Array, core: pa.Array, t0: pa.Array, t1: pa.Array, at: pa.Array) -> pa.Array:
        lengths, bounds = list_parts(whole)
        row = _row_of(bounds)
        start = _inner_sums(_ints(lengths), bounds) - _ints(list_parts(left)[0])
        end = start + _ints(list_parts(core)[0])
        first, tok_bounds = list_parts(t0)
        first, second = _ints(first), _ints(list_parts(t1)[0])
        if measured:
            tok_end = _inner_sums(first, tok_bounds)
            tok_start = tok_end - second
        else:
            tok_start, tok_end = first, second
        offset = _ints(at)
        reach = int((end + offset[row]).max()) if len(end) else 0
        axis = _TokenAxis(tok_start, tok_end, tok_bounds, max(reach, int(offset.max()) if len(offset) else 0))
        lo, hi, none = axis.overlapping(row, start + offset[row], end + offset[row])
        kept = end > start
        columns = [pa.array(start[kept]), pa.array(end[kept])]
        columns += [pa.array(v[kept], pa.int64(), mask=none[kept]) for v in (lo, hi)]
        names = ["char_start", "char_end", "tok_start", "tok_end"]
        kept_bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
        sents = list_column(pa.StructArray.from_arrays(columns, names), kept_bounds)
        n = np.diff(tok_bounds)
        a, b, nothing = axis.starting_from(np.arange(len(n)), offset)
        a, b = np.where(nothing, n, a), np.where(nothing, n, b)
        return pa.StructArray.from_arrays(
            [sents, pa.array(n), pa.array(a), pa.array(b)], ["sents", "n_tokens", "resp_start", "resp_end"]
        )

    return cut(*piece, *tokens, shift)


def with_cut(
    df: DataFrame, response: Column, prefix: Column, max_length: int, token_col: str | None = None, out: str = "cut"
) -> DataFrame:
    """Adds the sentences of the response with their token ranges in prefix + response, the number of tokens and
    the token range of the response. Sentence offsets count in the response. ``<out>.sents`` is empty when the
    text has more than ``max_length`` tokens.
    """
    full = F.concat(prefix, response)
    tokens = F.col(token_col) if token_col else token_pieces(full)
    df = once(df, _text=response, _tokens=tokens, _shift=F.length(prefix), _odd=F.contains(response, F.lit(_MARK)))
    used = F.when(F.size("_tokens") <= max_length, F.col("_text")).otherwise("")
    df = once(df, _pieces=_sentence_pieces(used))
    piece = (
        F.transform("_pieces", F.length),
        F.transform("_pieces", lambda p: F.length(_ltrim(p))),
        F.transform("_pieces", lambda p: F.length(_trim(p))),
    )
    if token_col:
        ends = (F.col("_tokens.start"), F.col("_tokens.end"))
    else:
        ends = (F.transform("_tokens", F.length), F.transform("_tokens", lambda t: F.length(_ltrim(t))))
    df = df.withColumn("_offsets", _cut(piece, ends, not token_col, F.col("_shift")))
    texts = F.filter(F.transform("_pieces", _trim), lambda t: t != "")

    def named(t: Column, o: Column) -> Column:
        own = F.substring(F.col("_text"), o["char_start"].cast("int") + 1, F.length(t))
        return F.struct(
            F.when(F.col("_odd"), own).otherwise(t).alias("text"),
            *[o[c].alias(c) for c in ("char_start", "char_end", "tok_start", "tok_end")],
        )

    made = F.struct(
        F.zip_with(texts, F.col("_offsets.sents"), named).alias("sents"),
        *[F.col(f"_offsets.{c}").alias(c) for c in ("n_tokens", "resp_start", "resp_end")],
    )
    return once(df, **{out: made}).drop("_text", "_tokens", "_shift", "_odd", "_pieces", "_offsets")
