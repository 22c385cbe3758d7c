"""Intermediate tables in the shared folder, removed when the session's Python process ends."""

from __future__ import annotations

import atexit
import contextlib

from pyspark.sql import DataFrame

from spanlake.session import scratch_dir

_written: list[tuple] = []


@atexit.register
def _remove() -> None:
    for fs, path in _written:
        with contextlib.suppress(Exception):  # the session may have ended before
            fs.delete(path, True)


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to a new folder beside the checkpoints and read from there."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.option("compression", compression).parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    _written.append((jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path))
    return spark.read.schema(df.schema).parquet(path)
