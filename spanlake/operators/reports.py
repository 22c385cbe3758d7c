"""Tables across runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanlake import fixed


def join_runs(config: DataFrame, metrics: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the dictionary size of their run and the firing rate of their latent; a label without one raises."""
    rates = metrics.select("run", F.posexplode("firing_rate").alias("latent_id", "firing_rate"))
    joined = labels.join(config.select("run", "n_latents"), "run", "left").join(rates, ["run", "latent_id"], "left")
    for name, table in (("n_latents", "configuration"), ("firing_rate", "firing rate")):
        missing = F.raise_error(F.concat(F.lit(f"a label of run "), F.col("run"), F.lit(f" has no {table}")))
        joined = joined.withColumn(name, F.coalesce(F.col(name), missing))
    return joined


def run_summary(joined: DataFrame) -> DataFrame:
    """The columns of the run report."""
    return joined.select(
        "run", "n_latents", "latent_id", "cluster_size", "firing_rate", "status", "title", "description"
    )


def ok_labels(summary: DataFrame) -> DataFrame:
    """Labels that were made without an error."""
    return summary.filter(F.col("status") == fixed.STATUS_OK)


def top_per_run(summary: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` largest labelled clusters of each run."""
    order = Window.partitionBy("run").orderBy(F.col("cluster_size").desc(), "latent_id")
    return ok_labels(summary).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_overall(summary: DataFrame, n: int = 30) -> DataFrame:
    """The ``n`` largest labelled clusters of all runs."""
    return ok_labels(summary).orderBy(F.col("cluster_size").desc(), "run", "latent_id").limit(n)


def recurring_titles(summary: DataFrame) -> DataFrame:
    """Titles that more than one label has; rows are counted, and the runs they come from."""
    counts = ok_labels(summary).groupBy("title").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("run").alias("n_runs")
    )
    return counts.filter(F.col("n_rows") > 1)
