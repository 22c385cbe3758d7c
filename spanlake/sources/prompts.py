"""Prompt CSV files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.fixed import MISSING_WORDS, PROMPT_SPECS
from spanlake.operators.prompts import all_prompts, melt_prompts

#: Name that the reader gives to a column without a header: the row index in front.
INDEX_COL = "_c0"

Spec = tuple[str | None, Sequence[str]]


def read_prompt_csv(spark: SparkSession, path: str) -> DataFrame:
    """A prompt file, all columns as strings; the leading column without a name is the row index ``_c0``.

    A malformed record raises. Cells that hold one of ``fixed.MISSING_WORDS`` are null.
    """
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, mode="FAILFAST")
    return rows.select(*(F.when(~F.col(f"`{c}`").isin(*MISSING_WORDS), F.col(f"`{c}`")).alias(c) for c in rows.columns))


def list_prompt_sources(
    spark: SparkSession, folder: str, specs: Mapping[str, Spec] = PROMPT_SPECS, excluded: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """``(known, unknown)`` CSV sources of a folder, ``file_name, path`` sorted by name; excluded ones are in neither.

    A source is a file, or a folder of part files named like one (``x.csv/part-*.csv``, or ``file=x.csv/…`` as Spark's
    partitioned writer leaves it).
    """
    # only the listing is read: no column of the files' content is asked for
    options = {"pathGlobFilter": "*.csv", "recursiveFileLookup": "true"}
    files = spark.read.format("binaryFile").options(**options).load(folder).select("path")
    below = F.regexp_extract("path", f"/{re.escape(folder.rstrip('/').rsplit('/', 1)[-1])}/((?:file=)?[^/]+[.]csv)(?:/part-[^/]*)?$", 1)
    named = files.withColumn("_enc", below).filter("_enc <> ''")
    at = F.regexp_extract("path", "^(.*[.]csv)(?:/part-[^/]*)$", 1)
    decoded = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    named = named.withColumn("path", decoded(F.when(at != "", at).otherwise(F.col("path"))))
    plain = F.regexp_replace(decoded(F.col("_enc")), "^file=", "")
    named = named.select(plain.alias("file_name"), "path").distinct()
    if excluded:
        named = named.filter(~F.col("file_name").isin(list(excluded)))
    has_spec = F.col("file_name").isin(list(specs))
    return named.filter(has_spec).orderBy("file_name"), named.filter(~has_spec).orderBy("file_name")


def read_prompts(
    spark: SparkSession, folder: str, specs: Mapping[str, Spec] = PROMPT_SPECS, excluded: Sequence[str] = ()
) -> DataFrame:
    """The prompts of all known files of a folder."""
    known, _ = list_prompt_sources(spark, folder, specs, excluded)
    found = [(row["file_name"], row["path"]) for row in known.collect()]  # at most one per spec
    frames = []
    for name, path in found:
        id_col, prompt_cols = specs[name]
        csv = read_prompt_csv(spark, path)
        frames.append(melt_prompts(csv, name.removesuffix(".csv"), id_col or INDEX_COL, prompt_cols))
    if not frames:
        raise FileNotFoundError(f"no prompt file with a spec in {folder}")
    return all_prompts(frames)
