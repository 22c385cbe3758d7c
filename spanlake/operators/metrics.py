"""Fit metrics over codes and reconstructions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import vectors
from spanlake.operators.pooling import global_center


def explained_variance(df: DataFrame, vector_col: str = "vector", xhat_col: str = "xhat") -> DataFrame:
    """One row: ``1 - Σ‖x̂ - x‖² / Σ‖x - mean‖²`` over all rows."""
    mean = global_center(df, vector_col).first()[0]  # one vector
    err = vectors.squared_distance(F.col(xhat_col), F.col(vector_col))
    var = vectors.squared_distance_to(df.sparkSession, F.col(vector_col), mean)
    return df.select(err.alias("e"), var.alias("v")).agg(
        F.sum("e").alias("recon_error"),
        F.sum("v").alias("total_variance"),
        (1 - F.sum("e") / F.sum("v")).alias("explained_variance"),
    )


def recon_mse(df: DataFrame, vector_col: str = "vector", xhat_col: str = "xhat", by: str | None = None) -> DataFrame:
    """Mean squared error per element, optionally per group such as train / validation."""
    err = vectors.squared_distance(F.col(xhat_col), F.col(vector_col)) / F.size(vector_col)
    rows = df.select(*([by] if by else []), err.alias("e"))
    return rows.groupBy(*([by] if by else [])).agg(F.avg("e").alias("recon_mse"), F.count(F.lit(1)).alias("n"))


def best_loss(history: DataFrame) -> DataFrame:
    """The loss a run reports: its best validation loss, with the epoch it came from, not the last one."""
    return history.groupBy("run").agg(
        F.min("val_loss").alias("final_recon_loss"),
        F.min_by("epoch", F.struct("val_loss", "epoch")).alias("best_epoch"),
        F.max("epoch").alias("n_epochs_trained"),
    )


def latent_counts(codes: DataFrame, n_latents: int, code_col: str = "code") -> DataFrame:
    """Rows in which each latent fires; a silent latent has 0."""
    fired = codes.select(F.explode(F.transform(code_col, lambda e: e["latent_id"])).alias("latent_id"))
    counts = fired.groupBy("latent_id").agg(F.count(F.lit(1)).alias("n_fired"))
    every = codes.sparkSession.range(n_latents).select(F.col("id").cast("int").alias("latent_id"))
    return every.join(counts, "latent_id", "left").select("latent_id", F.coalesce("n_fired", F.lit(0)).alias("n_fired"))


def firing_rate(codes: DataFrame, n_latents: int, code_col: str = "code") -> DataFrame:
    """Share of rows in which each latent fires."""
    n = codes.agg(F.count(F.lit(1)).alias("n"))
    counts = latent_counts(codes, n_latents, code_col)
    return counts.withColumn("_n", n.scalar()).select(
        "latent_id", "n_fired", (F.col("n_fired") / F.col("_n")).alias("firing_rate")
    )


def mean_l0(codes: DataFrame, code_col: str = "code") -> DataFrame:
    """One row: mean number of firing latents per row."""
    return codes.agg(F.avg(F.size(code_col)).alias("mean_l0"))


def dead_latents(fired_in_training: DataFrame, n_latents: int, codes: DataFrame | None = None) -> DataFrame:
    """Latents that never fired in training, each with a flag whether it is silent in ``codes`` too."""
    spark = fired_in_training.sparkSession
    every = spark.range(n_latents).select(F.col("id").cast("int").alias("latent_id"))
    dead = every.join(fired_in_training.select("latent_id").distinct(), "latent_id", "left_anti")
    if codes is None:
        return dead
    now = latent_counts(codes, n_latents).select("latent_id", (F.col("n_fired") == 0).alias("silent_now"))
    return dead.join(now, "latent_id")


def cluster_sizes(assign: DataFrame, n_latents: int) -> DataFrame:
    """Members of each latent by strongest assignment; an empty one has 0."""
    counts = assign.filter(F.col("latent_id") >= 0).groupBy("latent_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    every = assign.sparkSession.range(n_latents).select(F.col("id").cast("int").alias("latent_id"))
    return every.join(counts, "latent_id", "left").select(
        "latent_id", F.coalesce("cluster_size", F.lit(0)).alias("cluster_size")
    )
