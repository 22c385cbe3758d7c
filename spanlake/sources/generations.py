"""Generations as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.schemas import GENERATION


def read_generations(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """All ``*.jsonl`` of a folder; a malformed line raises, blank ones do not.

    ``_place`` (file, block of the file, row) sorts the rows by file name and line, for what depends on input order.
    """
    reader = spark.read.schema(GENERATION).option("mode", "FAILFAST").option("pathGlobFilter", glob)
    place = F.struct(
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),  # grows within a block
    )
    return reader.json(folder).withColumn("_place", place)


def read_generation_sets(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`write_generations` wrote."""
    df = spark.read.schema(GENERATION).option("mode", "FAILFAST").json(folder)
    return df.select(*GENERATION.fieldNames())


def write_generations(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """One set of JSON lines files per dataset."""
    df.select(*GENERATION.fieldNames()).write.mode(mode).partitionBy("dataset").json(folder)
