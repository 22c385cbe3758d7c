"""From assignments and sentences to label records, resumable per run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import exemplars as ex
from spanlake.operators import gates, labeling, metrics
from spanlake.sources import runs
from spanlake.session import cut_lineage
from spanlake.sources.tables import exists


def prompts_of(
    assign: DataFrame,
    sentences: DataFrame,
    n_latents: int,
    n_top: int = 100,
    n_random: int = 100,
    seed: int = 0,
    template: ex.PromptTemplate = ex.PromptTemplate(),
) -> DataFrame:
    """A prompt per latent from its top and random members."""
    chosen = ex.members_with_text(ex.exemplars(assign, n_top, n_random, seed), sentences)
    return ex.build_prompts(chosen, metrics.cluster_sizes(assign, n_latents), template=template)


def check_inputs(assign: DataFrame, sentences: DataFrame, checked: bool = False) -> None:
    """Raises unless the sentences are numbered densely (left out when ``checked``) and have one assignment each."""
    if not checked:
        gates.require(gates.check_keys(sentences), "dense")
    gates.require(gates.check_same_keys(assign, sentences), "same")


def label_run(
    folder: str,
    run: str,
    assign: DataFrame,
    sentences: DataFrame,
    n_latents: int,
    judge_fn: Callable[..., str],
    judge_model: str,
    n_top: int = 100,
    n_random: int = 100,
    seed: int = 0,
    force: bool = False,
    attempts: int = 3,
    parallelism: int | None = None,
    template: ex.PromptTemplate = ex.PromptTemplate(),
    per_batch: int = 200,
    checked: bool = False,
) -> DataFrame:
    """Labels one run and returns its labels. A rerun asks the judge for unfinished latents only, or for all with
    ``force``.

    Latents are labelled ``per_batch`` at a time and each batch is written when it is done, so a call that fails keeps
    the replies it has paid for. Batches are never overwritten: labels from before are not lost.
    """
    spark = assign.sparkSession
    check_inputs(assign, sentences, checked)
    existing, batch = None, 0
    if exists(spark, f"{folder}/labels/run={run}"):
        stored = spark.read.parquet(f"{folder}/labels").filter(F.col("run") == run)
        batch = (stored.agg(F.max("batch")).first()[0] or 0) + 1
        existing = runs.read_labels(spark, folder).filter(F.col("run") == run)
    todo = prompts_of(assign, sentences, n_latents, n_top, n_random, seed, template)
    if existing is not None and not force:
        todo = labeling.pending(todo, labeling.finished(existing), ["latent_id"])
    todo = cut_lineage(todo)
    for first in range(0, n_latents, per_batch):
        part = todo.filter(F.col("latent_id").between(first, first + per_batch - 1))
        made = labeling.label_clusters(
            part, judge_fn, judge_model, attempts=attempts, parallelism=parallelism, system=template.system
        )
        runs.write_labels(made, folder, run, batch)
        batch += 1
    return runs.read_labels(spark, folder).filter(F.col("run") == run)


def label_layer(
    folder: str,
    layer: int,
    sentences: DataFrame,
    judge_fn: Callable[..., str],
    judge_model: str,
    **options,
) -> list[str]:
    """Labels all runs of a layer, in the order of their names."""
    spark = sentences.sparkSession
    config = runs.read_run_table(spark, folder, "config")
    chosen = runs.select_runs(config.select("run"), config, layer).collect()  # one row per run
    if not chosen:
        raise ValueError(f"no runs of layer {layer} in {folder}")
    sizes = {r["run"]: r["n_latents"] for r in config.select("run", "n_latents").collect()}
    gates.require(gates.check_keys(sentences), "dense")  # once for all runs
    for row in chosen:
        run = row["run"]
        assign = runs.read_run_table(spark, folder, "assignments", run)
        label_run(folder, run, assign, sentences, sizes[run], judge_fn, judge_model, checked=True, **options)
    return [row["run"] for row in chosen]
