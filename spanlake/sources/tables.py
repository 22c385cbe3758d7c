"""Parquet and JSON tables of the flows."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from spanlake.schemas import SKIP


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be listed on its file system."""
    try:
        spark.read.format("binaryFile").load(path).limit(1).count()
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def spread(scan: DataFrame) -> DataFrame:
    """A scan with at least one task per core.

    A file with a single row group is read by one task however large the cluster is, so a scan with less than half as
    many partitions as cores is dealt out evenly first. Other scans pass unchanged. Only for scans:
    counting the partitions of a plan with shuffles would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores // 2 else scan.repartition(cores)


def write_tables(sentences: DataFrame, responses: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """The frozen sentence and response tables."""
    sentences.write.mode(mode).parquet(f"{folder}/sentences")
    responses.write.mode(mode).parquet(f"{folder}/responses")


def read_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """What :func:`write_tables` wrote."""
    return spark.read.parquet(f"{folder}/sentences"), spark.read.parquet(f"{folder}/responses")


def write_skips(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Skip events as JSON lines."""
    df.select(*SKIP.fieldNames()).write.mode(mode).json(f"{folder}/skipped")


def read_skips(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`write_skips` wrote."""
    return spark.read.schema(SKIP).json(f"{folder}/skipped")


def write_vectors(df: DataFrame, path: str, batch: int = 0) -> None:
    """Vectors in one folder per layer and batch; writing a batch again replaces it, so a repeated call adds nothing twice.

    All vectors have one length, that of the vectors stored before or else of the first one; another raises while writing.
    """
    spark = df.sparkSession
    size = F.size("vector").alias("n")
    stored = spark.read.parquet(path).select(size).first() if exists(spark, path) else None
    first = stored or df.select(size).first()
    width = first["n"] if first else 0
    wrong = F.raise_error(F.concat(F.lit(f"shape mismatch at {path}: expected {width}, found "), F.size("vector").cast("string")))
    checked = F.when(F.size("vector") == width, F.col("vector").cast("array<float>")).otherwise(wrong)
    rows = df.withColumn("vector", checked).withColumn("batch", F.lit(batch))
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("layer", "batch").parquet(path)


def read_vectors(spark: SparkSession, path: str, layer: int | None = None) -> DataFrame:
    """Vectors, of one layer only when asked; the other folders are then not opened."""
    df = spark.read.parquet(path).drop("batch")
    return df if layer is None else df.filter(F.col("layer") == layer)


def write_probe_cache(acts: DataFrame, labels: DataFrame, folder: str, meta: Mapping[str, Any], mode: str = "errorifexists") -> None:
    """Probe activations by family and layer, their labels and a description."""
    cols = ["family", "layer", "head", "example_id", "vector"]
    acts.select(*cols).write.mode(mode).partitionBy("family", "layer").parquet(f"{folder}/activations")
    labels.write.mode(mode).parquet(f"{folder}/labels")
    write_json(acts.sparkSession, meta, f"{folder}/metadata", mode)


def read_probe_cache(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """What :func:`write_probe_cache` wrote."""
    acts, labels = spark.read.parquet(f"{folder}/activations"), spark.read.parquet(f"{folder}/labels")
    return acts, labels, read_json(spark, f"{folder}/metadata")


def write_json(spark: SparkSession, record: Mapping[str, Any], path: str, mode: str = "overwrite") -> None:
    """One JSON object."""
    import json

    line = spark.createDataFrame([(json.dumps(dict(record), sort_keys=True),)], "value string")
    line.coalesce(1).write.mode(mode).text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    """What :func:`write_json` wrote."""
    import json

    return json.loads(spark.read.text(path).first()["value"])
