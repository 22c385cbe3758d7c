"""Sentences, tokens, their alignment, and the routing of rows that cannot be used."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.functions import spans, text
from spanlake.operators import intervals


def split_sentences(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per non-blank sentence with its character offsets in the text."""
    nested = spans.with_sentences(df.select(*id_cols, text_col), F.col(text_col), "_s")
    rows = nested.select(*id_cols, F.posexplode("_s").alias("sent_idx", "s"))
    return rows.select(*id_cols, F.col("sent_idx").cast("long").alias("sent_idx"), "s.text", "s.char_start", "s.char_end")


def tokenize(df: DataFrame, text_col: str = "text", id_cols: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row per token: ``tok_idx, start, end`` (character offsets)."""
    nested = spans.with_tokens(df.select(*id_cols, text_col), F.col(text_col), "_t")
    rows = nested.select(*id_cols, F.posexplode("_t").alias("tok_idx", "t"))
    return rows.select(*id_cols, F.col("tok_idx").cast("long").alias("tok_idx"), "t.start", "t.end")


def _buckets(start: Column, end: Column, width: int) -> Column:
    low = F.floor(start / width)
    return F.explode(F.sequence(low, F.floor(F.greatest(end - 1, start) / width)))


def overlap_join(
    spans_df: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    span: tuple[str, str],
    point: tuple[str, str],
    width: int,
    how: str = "left",
) -> DataFrame:
    """Ranges joined to the ranges they overlap, within equal ``keys``.

    Both sides are spread over buckets of ``width`` positions and the bucket joins the keys as an equality, so
    the work per hash key is bounded by the width, one long document is shared by many tasks, and the overlap
    test only runs inside a bucket. A pair that shares several buckets comes out once per shared bucket;
    callers aggregate with functions that do not mind, or ask for the pair's first shared bucket only.
    """
    left = spans_df.withColumn("_bucket", _buckets(F.col(span[0]), F.col(span[1]), width))
    right = points.withColumn("_bucket", _buckets(F.col(point[0]), F.col(point[1]), width))
    same = [left[k] == right[k] for k in (*keys, "_bucket")]
    hit = (right[point[1]] > left[span[0]]) & (right[point[0]] < left[span[1]])
    joined = left.join(right, [*same, hit], how)
    for k in (*keys, "_bucket"):
        joined = joined.drop(right[k])
    return joined


def align_spans(
    spans_df: DataFrame,
    tokens: DataFrame,
    doc_cols: Sequence[str] = ("doc_id",),
    span_cols: Sequence[str] = ("sent_idx",),
    width: int = intervals.STRETCH,
) -> DataFrame:
    """Token range ``[tok_start, tok_end)`` of each character span; null when no token overlaps it.

    For token tables that come from outside: tokens may overlap and come in any order. Zero-width tokens are ignored.
    Both tables are swept in one sorted stream by stretches of ``width`` characters.
    """
    found = intervals.range_of_points(spans_df, tokens, doc_cols, span_cols, ("char_start", "char_end"), ("start", "end"), "tok_idx", width)
    return found.select(*doc_cols, *span_cols, "char_start", "char_end", F.col("first").alias("tok_start"), (F.col("last") + 1).alias("tok_end"))


def align_spans_plain(
    spans_df: DataFrame,
    tokens: DataFrame,
    doc_cols: Sequence[str] = ("doc_id",),
    span_cols: Sequence[str] = ("sent_idx",),
) -> DataFrame:
    """``align_spans`` without a sweep: every pair of a document is tested. Kept as the twin for tests."""
    toks = tokens.filter(F.col("start") < F.col("end")).select(*doc_cols, "tok_idx", "start", "end")
    left = spans_df.select(*doc_cols, *span_cols, "char_start", "char_end")
    same = [left[k] == toks[k] for k in doc_cols]
    joined = left.join(toks, [*same, (toks.end > left.char_start) & (toks.start < left.char_end)], "left")
    return joined.groupBy(*[left[k] for k in doc_cols], *span_cols, "char_start", "char_end").agg(
        F.min("tok_idx").alias("tok_start"), (F.max("tok_idx") + 1).alias("tok_end")
    )


def response_span(
    tokens: DataFrame, prefix_len: str = "prefix_len", doc_cols: Sequence[str] = ("doc_id",), docs: DataFrame | None = None
) -> DataFrame:
    """Token range of the text after the prefix, by token start; ``(n, n)`` when nothing starts there.

    With ``docs`` their documents without any token are there too, as ``(0, 0)``.

    ``tokens`` carries the prefix length of its document in each row. Partial aggregates run before the shuffle.
    """
    inside = (F.col("start") < F.col("end")) & (F.col("start") >= F.col(prefix_len))
    n = F.count(F.lit(1))
    found = tokens.groupBy(*doc_cols).agg(
        F.coalesce(F.min(F.when(inside, F.col("tok_idx"))), n).alias("resp_tok_start"),
        F.coalesce(F.max(F.when(inside, F.col("tok_idx"))) + 1, n).alias("resp_tok_end"),
        n.alias("n_tokens"),
    )
    if docs is None:
        return found
    none = {c: 0 for c in ("resp_tok_start", "resp_tok_end", "n_tokens")}
    return docs.select(*doc_cols).distinct().join(found, list(doc_cols), "left").fillna(none)


def segment(
    df: DataFrame,
    prefix_col: str | None = None,
    text_col: str = "response",
    max_length: int = fixed.MAX_LENGTH,
    token_col: str | None = None,
) -> DataFrame:
    """Each response with its sentences, their token ranges and its skip events, all nested in its own row.

    Adds ``n_tokens_full_text``, ``resp_tok_start``, ``resp_tok_end``, ``spans`` (valid sentences in order) and
    ``skips`` (``reason, detail``). ``token_col`` may hold token offsets of prefix + text from another
    tokenizer as ``ARRAY<STRUCT<start, end>>``. Nothing here shuffles.
    """
    prefix = F.coalesce(F.col(prefix_col), F.lit("")) if prefix_col else F.lit("")
    blank = text.is_blank(F.col(text_col))
    response = F.when(blank, "").otherwise(F.col(text_col))  # a blank response has no sentences
    out = spans.with_cut(df, response, prefix, max_length, token_col, "_cut")
    n = F.col("_cut.n_tokens")

    def event(reason: str, detail: Column) -> Column:
        return F.struct(F.lit(reason).alias("reason"), detail.cast("string").alias("detail"))

    missed = F.filter("_cut.sents", lambda s: s["tok_start"].isNull())
    lost = F.transform(missed, lambda s: event(fixed.DEGENERATE_SPAN, F.substring(s["text"], 1, 80)))
    nothing = F.lit(None)
    any_sentence = F.exists("_cut.sents", lambda s: s["tok_start"].isNotNull())
    whole = (
        F.when(blank, event(fixed.EMPTY_RESPONSE, nothing))
        .when(n > max_length, event(fixed.TOO_LONG, n))
        .when(~any_sentence, event(fixed.NO_VALID_SENTENCES, nothing))
    )
    out = spans.once(
        out,
        n_tokens_full_text=n,
        resp_tok_start=F.col("_cut.resp_start"),
        resp_tok_end=F.col("_cut.resp_end"),
        spans=F.filter("_cut.sents", lambda s: s["tok_start"].isNotNull()),
        skips=F.concat(lost, F.array_compact(F.array(whole))),
    )
    return out.drop("_cut")


def route_skips(segmented: DataFrame, id_col: str = "response_id") -> tuple[DataFrame, DataFrame]:
    """``(valid, skips)`` of a segmented table: responses with at least one sentence, and one row per skip event."""
    valid = segmented.filter(F.size("spans") > 0).drop("skips")
    skips = segmented.select(F.col(id_col).alias("response_id"), F.explode("skips").alias("s"))
    return valid, skips.select("response_id", "s.reason", "s.detail")


def sentence_rows(valid: DataFrame, id_cols: Sequence[str] = ("response_id",)) -> DataFrame:
    """The nested sentences as rows; ``sent_idx`` counts the sentences that were kept."""
    rows = valid.select(*id_cols, F.posexplode("spans").alias("sent_idx", "s"))
    return rows.select(
        *id_cols,
        F.col("sent_idx").cast("long").alias("sent_idx"),
        "s.text",
        "s.char_start",
        "s.char_end",
        "s.tok_start",
        "s.tok_end",
        (F.col("s.tok_end") - F.col("s.tok_start")).alias("n_tokens"),
    )


def spans_by_response(sentences: DataFrame, id_col: str = "response_id") -> DataFrame:
    """Token ranges nested under their response, ordered by ``global_idx``.

    A cell holds ints of one response only, at most one range per token of a text within the length limit.
    """
    entry = F.struct("global_idx", "tok_start", "tok_end")
    return sentences.groupBy(id_col).agg(F.array_sort(F.collect_list(entry)).alias("spans"))


def response_stats(sentences: DataFrame, id_col: str = "response_id") -> DataFrame:
    """Per response: number of sentences, tokens inside sentences, longest sentence in tokens."""
    n_tokens = F.col("tok_end") - F.col("tok_start")
    return sentences.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n_sentences"),
        F.sum(n_tokens).alias("n_span_tokens"),
        F.max(n_tokens).alias("max_span_tokens"),
    )
