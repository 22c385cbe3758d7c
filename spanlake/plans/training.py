"""From a vector table to a fitted run with its artifacts."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame

from spanlake.operators import fitting, latent_blocks, metrics, pooling, sae
from spanlake.schemas import RUN_CONFIG, RUN_METRICS
from spanlake.session import cut_lineage
from spanlake.sources import runs


def name_of(layer: int, cfg: fitting.FitConfig, centered: bool) -> str:
    tag = "centered" if centered else "uncentered"
    return f"L{layer:02d}_n{cfg.n_latents}_k{cfg.k}_{tag}_s{cfg.seed}"


def train_run(
    vectors: DataFrame,
    layer: int,
    cfg: fitting.FitConfig,
    folder: str,
    response_vectors: DataFrame | None = None,
    input_hash: str | None = None,
    force: bool = False,
    start: sae.SaeParams | None = None,
    max_bytes: int = sae.MAX_PARAM_BYTES,
) -> str:
    """Fits one run on ``global_idx, vector`` and writes it; a finished run is left alone unless ``force``.

    With ``response_vectors`` the vectors are centered at the mean of the response means.
    """
    spark = vectors.sparkSession
    centered = response_vectors is not None
    run = name_of(layer, cfg, centered)
    if not force and run in runs.finished_runs(spark, folder):
        return run
    x = vectors.select("global_idx", "vector")
    if centered:
        x = sae.center(x, pooling.global_center(response_vectors))
    fit = fitting.fit_topk_sae(x, cfg, start=start, max_bytes=max_bytes)
    with latent_blocks.Shelf(spark) as shelf:
        if isinstance(fit.params, sae.SaeParams):
            coded = sae.decode(sae.encode(x, fit.params, cfg.k), fit.params)
        else:
            coded = latent_blocks.coded(x, fit.params, cfg.k, ["global_idx"], shelf=shelf)
        coded = cut_lineage(coded)
    ev = metrics.explained_variance(coded).first()["explained_variance"]
    rates = metrics.firing_rate(coded, cfg.n_latents).orderBy("latent_id").collect()  # one row per latent
    l0 = metrics.mean_l0(coded).first()["mean_l0"]
    epochs = len(fit.history)
    # fixed values: the fields of a run's two documents
    known = dict(vars(cfg), layer=layer, centered=centered, lr=cfg.rate, d_in=fit.params.d_in, n_epochs_trained=epochs)
    known |= {"batch_size": -(-fit.n_train // cfg.steps), "activations_input_hash": input_hash, "timestamp": datetime.now(UTC).isoformat()}
    config = {f: known[f] for f in RUN_CONFIG.fieldNames()}
    known |= {"final_recon_loss": fit.best_val_loss, "explained_variance": ev, "firing_rate": [r["firing_rate"] for r in rates]}
    known |= {"dead_latent_count": len(fit.dead_latents), "mean_l0": l0, "early_stopped": fit.early_stopped}
    measured = {f: known[f] for f in RUN_METRICS.fieldNames()}
    assigned = sae.assignments(coded, cfg.k)
    runs.write_run(run, folder, assigned, fit.params.to_table(spark), config, measured, fit.params.b_dec.tolist())
    if isinstance(fit.params, latent_blocks.LatentTable):
        fit.params.close()
    return run


def sweep(vectors: DataFrame, layer: int, grid: Iterable[fitting.FitConfig], folder: str, **options) -> list[str]:
    """Fits every configuration of a grid that is not finished yet, on the same held-out rows."""
    held = cut_lineage(vectors.select("global_idx", "vector"))
    return [train_run(held, layer, cfg, folder, **options) for cfg in grid]
