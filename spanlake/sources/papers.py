"""Published results to compare with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.schemas import PAPER_RESULTS
from spanlake.sources.tables import exists


def read_paper_results(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``model, metric, value`` from the first of the paths that exists; a metric that is left out has no row."""
    for path in paths:
        if exists(spark, path):
            break
    else:
        raise FileNotFoundError(f"no paper results at {list(paths)}")
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.from_json("value", PAPER_RESULTS, {"mode": "FAILFAST"}).alias("m"))
    by_model = parsed.select(F.explode("m").alias("model", "r")).select("model", "r.*")
    long = by_model.unpivot("model", [c for c in by_model.columns if c != "model"], "metric", "value")
    return long.filter(F.col("value").isNotNull())
