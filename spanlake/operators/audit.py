"""Set operations and audits between prompt tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions import text


def distinct_ids(df: DataFrame, id_col: str) -> DataFrame:
    """Each id once."""
    return df.select(id_col).distinct()


def missing_ids(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """Ids of ``a`` that ``b`` does not have, sorted."""
    return a.select(id_col).subtract(b.select(id_col)).orderBy(id_col)


def is_subset(a: DataFrame, b: DataFrame, id_col: str) -> DataFrame:
    """One row: does ``b`` hold every id of ``a``, and how many are missing."""
    gone = a.select(id_col).subtract(b.select(id_col))
    return gone.agg(F.count(F.lit(1)).alias("n_missing")).select(
        "n_missing", (F.col("n_missing") == 0).alias("is_subset")
    )


def union_runs(frames: Sequence[DataFrame]) -> DataFrame:
    """Tables of several runs in one, all rows kept."""
    return reduce(DataFrame.unionByName, frames)


def id_counts(df: DataFrame, id_col: str) -> DataFrame:
    """One row: number of rows and of different ids."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(id_col).alias("n_ids"))


def sample_counts(prompts: DataFrame, by: str = "dataset", exclude: Sequence[str] = ()) -> DataFrame:
    """Rows per dataset without the excluded ones, and the grand total in a row named ``TOTAL``."""
    kept = prompts.filter(~F.col(by).isin(list(exclude))) if exclude else prompts
    counts = kept.rollup(by).agg(F.count(F.lit(1)).alias("n_samples"), F.grouping(by).alias("_all"))
    return counts.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "n_samples")


def audit_text(c: Column) -> Column:
    """The text as the audit compares it: trimmed, a missing one written ``nan``."""
    return text.strip(F.coalesce(c.cast("string"), F.lit("nan")))


def text_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The set of trimmed texts of each id, as rows (id, text): a set may be larger than a cell should be."""
    return df.select(id_col, audit_text(F.col(text_col)).alias(text_col)).distinct()


def text_mismatches(a: DataFrame, b: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``a`` whose id is in ``b``, but with none of ``b``'s texts for that id; repeated rows stay."""
    digest = F.sha2(audit_text(F.col(text_col)), 256).alias("_digest")  # 64 bytes travel instead of the text
    sets = b.select(id_col, digest).distinct()
    known = a.select(id_col, digest).join(sets.select(id_col).distinct(), id_col, "left_semi")
    return known.join(sets, [id_col, "_digest"], "left_anti").select(id_col)


def verdict(missing: Column, mismatched: Column) -> Column:
    """``PASS`` when nothing is missing and nothing differs."""
    return F.when((missing == 0) & (mismatched == 0), "PASS").otherwise("FAIL")


def coverage_report(a: DataFrame, b: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: sizes of both tables, missing ids, differing texts, verdict.

    Both tables are read once: rows are counted per id and text digest on either side, then per id, then in all. A null
    id counts as an id that can be missing, but not as one of the different ids, and its texts are not compared.
    """

    def side(df: DataFrame, in_a: int) -> DataFrame:
        digest = F.sha2(audit_text(F.col(text_col)), 256).alias("_d")
        return df.select(F.col(id_col).alias("_id"), digest, F.lit(in_a).alias("_a"), F.lit(1 - in_a).alias("_b"))

    texts = side(a, 1).unionAll(side(b, 0)).groupBy("_id", "_d").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    alone = F.sum(F.when(F.col("_b") == 0, F.col("_a")).otherwise(0))
    ids = texts.groupBy("_id").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), alone.alias("_alone"))
    real = F.col("_id").isNotNull()
    zero = F.lit(0)
    report = ids.agg(
        F.coalesce(F.sum("_a"), zero).alias("a_rows"),
        F.count_if((F.col("_a") > 0) & real).alias("a_ids"),
        F.coalesce(F.sum("_b"), zero).alias("b_rows"),
        F.count_if((F.col("_b") > 0) & real).alias("b_ids"),
        F.count_if((F.col("_a") > 0) & (F.col("_b") == 0)).alias("n_missing"),
        F.coalesce(F.sum(F.when((F.col("_b") > 0) & real, F.col("_alone"))), zero).alias("n_mismatched"),
    )
    return report.withColumn("verdict", verdict(F.col("n_missing"), F.col("n_mismatched")))
