"""Quality gates over the tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.functions import vectors
from spanlake.functions.text import normalize_ws
from spanlake.operators.index import sample_n
from spanlake.session import cut_lineage


def check_spans(
    sentences: DataFrame,
    tokens: DataFrame | Callable[[DataFrame], DataFrame],
    texts: DataFrame,
    n: int,
    seed: int = 0,
    doc_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Sampled sentences with the text their token range stands for, and whether the two agree.

    Only the sampled rows are joined, and only the offsets of their first and last token are needed. A tokenizer may stand
    for the token table: it then gets the texts of the sampled sentences only.
    """
    picked = cut_lineage(
        sample_n(sentences.select(doc_col, "sent_idx", "text", "tok_start", "tok_end"), n, seed, [doc_col, "sent_idx"])
    ).withColumnRenamed("text", "_sentence")
    full = texts.select(doc_col, text_col).join(picked.select(doc_col).distinct(), doc_col, "left_semi")
    if callable(tokens):
        tokens = tokens(full)
    at_ends = (F.col("tok_idx") == F.col("tok_start")) | (F.col("tok_idx") == F.col("tok_end") - 1)
    places = picked.drop("_sentence")
    ends = tokens.select(doc_col, "tok_idx", "start", "end").join(places, doc_col).filter(at_ends)
    bounds = ends.groupBy(doc_col, "sent_idx").agg(F.min("start").alias("_a"), F.max("end").alias("_b"))
    # a sentence whose tokens or text are not there stays, and does not agree
    found = picked.join(bounds, [doc_col, "sent_idx"], "left").join(full.withColumnRenamed(text_col, "_full"), doc_col, "left")
    rebuilt = found.withColumn("decoded", F.substring("_full", F.col("_a") + 1, F.col("_b") - F.col("_a")))
    same = F.coalesce(normalize_ws(F.col("decoded")) == normalize_ws(F.col("_sentence")), F.lit(False))
    return rebuilt.select(doc_col, "sent_idx", F.col("_sentence").alias("expected"), "decoded", same.alias("agrees"))


def span_verdict(checked: DataFrame, min_rate: float = fixed.SPAN_PASS_RATE) -> DataFrame:
    """One row: sample size, pass rate, passed; both null for an empty sample."""
    rate = F.avg(F.col("agrees").cast("int"))
    return checked.agg(
        F.count(F.lit(1)).alias("n"), rate.alias("pass_rate"), (rate >= min_rate).alias("passed")
    )


def check_vectors(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("layer", "global_idx"), by: str = "layer", tol: float = fixed.VECTOR_TOLERANCE
) -> DataFrame:
    """Two computations of the same vectors, per layer: largest difference, vectors that only one of them has, and whether
    there are none and the difference stays within ``tol``."""
    left = a.select(*keys, F.col("vector").alias("_a"))
    right = b.select(*keys, F.col("vector").alias("_b"))
    gap = vectors.max_abs_diff(F.col("_a"), F.col("_b")).alias("_d")
    pairs = left.join(right, list(keys), "full").select(by, F.col("_a").isNull().alias("_no_a"), F.col("_b").isNull().alias("_no_b"), gap)
    counted = pairs.groupBy(by).agg(
        F.max("_d").alias("max_abs_diff"), F.count_if("_no_b").alias("only_in_a"), F.count_if("_no_a").alias("only_in_b")
    )
    whole = (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0)
    return counted.withColumn("passed", whole & F.coalesce(F.col("max_abs_diff") <= tol, F.lit(False)))


def check_keys(df: DataFrame, key: str = "global_idx") -> DataFrame:
    """One row: are the keys exactly 0..n-1."""
    facts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(key).alias("n_keys"),
        F.min(key).alias("first"),
        F.max(key).alias("last"),
    )
    n = F.col("n_rows")
    dense = (F.col("n_keys") == n) & (F.col("first") == 0) & (F.col("last") == n - 1)
    return facts.withColumn("dense", F.coalesce(dense, n == 0))


def check_same_keys(a: DataFrame, b: DataFrame, key: str = "global_idx") -> DataFrame:
    """One row: keys that only one of two tables has."""
    left = a.select(key, F.lit(True).alias("_a"))
    right = b.select(key, F.lit(True).alias("_b"))
    both = left.join(right, key, "full")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_in_a"), F.count_if(F.col("_a").isNull()).alias("only_in_b")
    ).withColumn("same", (F.col("only_in_a") == 0) & (F.col("only_in_b") == 0))


def require(report: DataFrame, flag: str) -> None:
    """Raises with the one-row report when its flag is not true."""
    row = report.first()
    if not row or not row[flag]:
        raise ValueError(f"check failed: {row.asDict() if row else 'no rows'}")
