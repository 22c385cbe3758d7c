"""Artifacts of fitted runs: one folder per run."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.operators.sae import SaeParams
from spanlake.schemas import LABEL, RUN_CONFIG, RUN_METRICS
from spanlake.session import remove


#: Folder of the documents that runs keep together, and the name there of a run without one (Spark's writer gives it to folders).
TOGETHER, NO_NAME = "together", "__HIVE_DEFAULT_PARTITION__"


def _read_documents(spark: SparkSession, folder: str, name: str, schema: T.StructType, layer: int | None) -> DataFrame:
    # the folders of other layers are not even listed; a document is a file, or what a writer partitioned by run and file left
    prefix = "" if layer is None else _layer_prefix(layer)
    glob = f"{folder}/{{,run=}}{prefix}*/{{,file=}}{name}.json"
    together = _any(spark, f"{folder}/{TOGETHER}")
    if together and not _any(spark, glob):
        return _read_together(spark, folder, name, schema, layer)
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(glob, multiLine=True)
    run = F.regexp_extract("_metadata.file_path", f"([^/=]+)/(?:file=)?{name}[.]json(?:/[^/]+)?$", 1)
    alone = df.select(run.alias("run"), "*")
    return alone.unionByName(_read_together(spark, folder, name, schema, layer)) if together else alone


def _any(spark: SparkSession, glob: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))


def _read_together(spark: SparkSession, folder: str, name: str, schema: T.StructType, layer: int | None) -> DataFrame:
    lines = spark.read.schema("run string, value string, layer string, file string").option("mode", "FAILFAST").json(f"{folder}/{TOGETHER}")
    lines = lines.where(F.col("file") == f"{name}.json")
    if layer is not None:
        lines = lines.where((F.col("layer") == _layer_prefix(layer)[:-1]) & _is_layer(F.col("run"), layer))
    # a document may be one object or an array of them
    found = F.from_json("value", T.ArrayType(schema), {"mode": "FAILFAST"})
    return lines.select("run", F.inline(found))


def write_documents(documents: DataFrame, folder: str) -> None:
    """Appends JSON documents ``run, file, value`` of any number of runs, as lines by layer and file: files grow in size, not
    in number, with the runs."""
    run = F.coalesce("run", F.lit(NO_NAME))
    rows = documents.select(run.alias("run"), "value", F.regexp_extract(run, "^(L[0-9]+)_", 1).alias("layer"), "file")
    rows.write.mode("append").partitionBy("layer", "file").json(f"{folder}/{TOGETHER}")


def read_runs(spark: SparkSession, folder: str, layer: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(config, metrics, labels)`` of all runs of a folder that keeps each as JSON documents, keyed by run.

    A run's documents lie in a folder of its name, as Spark's writer partitions them (``run=.../file=config.json``), or beside
    those of other runs, as :func:`write_documents` leaves them."""
    files = (("config", RUN_CONFIG), ("metrics", RUN_METRICS), ("labels", LABEL))
    return tuple(_read_documents(spark, folder, name, schema, layer) for name, schema in files)


def _layer_prefix(layer: int) -> str:
    return f"L{layer:02d}_"


def _is_layer(run: Column, layer: int) -> Column:
    return run.startswith(_layer_prefix(layer))


def select_runs(runs: DataFrame, configs: DataFrame, layer: int) -> DataFrame:
    """Runs of one layer that have a configuration, in the order of their names."""
    named = runs.filter(_is_layer(F.col("run"), layer))
    return named.join(configs.select("run").distinct(), "run", "left_semi").orderBy("run")


def write_run(
    run: str,
    folder: str,
    assignments: DataFrame,
    latents: DataFrame,
    config: Mapping[str, Any],
    metrics: Mapping[str, Any],
    b_dec: list[float],
) -> None:
    """Writes a fitted run: tables partitioned by run, and its two descriptions. The metrics go last, as the sign
    that the run is complete; those of an earlier fit of the run are removed first."""
    spark = assignments.sparkSession
    remove(spark, f"{folder}/metrics/run={run}")
    for name, df in (("assignments", assignments), ("latents", latents)):
        df.drop("run").write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")
    bias = spark.createDataFrame([(b_dec,)], "b_dec array<double>")
    bias.write.mode("overwrite").parquet(f"{folder}/bias/run={run}")
    _one_row(spark, config, RUN_CONFIG).write.mode("overwrite").json(f"{folder}/config/run={run}")
    _one_row(spark, metrics, RUN_METRICS).write.mode("overwrite").json(f"{folder}/metrics/run={run}")


def _one_row(spark: SparkSession, record: Mapping[str, Any], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([tuple(record.get(f.name) for f in schema)], schema)


def read_run_table(spark: SparkSession, folder: str, name: str, run: str | None = None) -> DataFrame:
    """``assignments``, ``latents``, ``bias``, ``config`` or ``metrics`` as written, of one run when asked."""
    if name in ("config", "metrics"):
        schema = T.StructType([*(RUN_CONFIG if name == "config" else RUN_METRICS).fields, T.StructField("run", T.StringType())])
        df = spark.read.schema(schema).json(f"{folder}/{name}")
    else:
        df = spark.read.parquet(f"{folder}/{name}")
    return df if run is None else df.filter(F.col("run") == run)


def finished_runs(spark: SparkSession, folder: str) -> list[str]:
    """Names of the runs whose metrics are written."""
    from spanlake.sources.tables import exists

    if not exists(spark, f"{folder}/metrics"):
        return []
    return [r["run"] for r in read_run_table(spark, folder, "metrics").select("run").distinct().collect()]


def read_params(spark: SparkSession, folder: str, run: str) -> SaeParams:
    """Parameters of a stored run."""
    bias = read_run_table(spark, folder, "bias", run).first()["b_dec"]
    return SaeParams.from_table(read_run_table(spark, folder, "latents", run).drop("run"), bias)


def write_labels(labels: DataFrame, folder: str, run: str, batch: int) -> None:
    """Appends the labels of one batch; writing the same batch again replaces it, finished ones before stay."""
    labels.drop("run").write.mode("overwrite").parquet(f"{folder}/labels/run={run}/batch={batch}")


def read_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The latest label of each latent of each run."""
    df = spark.read.parquet(f"{folder}/labels")
    rest = [c for c in df.columns if c not in ("run", "latent_id", "batch")]
    latest = df.groupBy("run", "latent_id").agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return latest.select("run", "latent_id", "_r.*")
