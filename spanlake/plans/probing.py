"""From probe examples and activations to the comparison with published numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import gates, probes
from spanlake.session import cut_lineage
from spanlake.sources.papers import read_paper_results


def probe_benchmark(
    acts: DataFrame, labels: DataFrame, model: str, paper_paths: Sequence[str], cfg: probes.ProbeConfig = probes.ProbeConfig()
) -> dict[str, DataFrame]:
    """Fits all probes and compares the best of each family: ``results``, ``best``, ``comparison``.

    ``labels`` holds ``example_id, text, label``. Raises when the labels cannot be fitted or a family has no
    activations.
    """
    gates.require(probes.labels_valid(labels), "valid")
    results = cut_lineage(probes.fit_probes(probes.probe_dataset(acts, labels), cfg))
    missing = [r["family"] for r in probes.missing_families(results).collect()]
    if missing:
        raise ValueError(f"no probes for {missing}")
    best = probes.best_probe(results)
    ours = best.select(
        F.lit(model).alias("model"),
        F.concat("family", F.lit("_best_accuracy")).alias("metric"),
        F.col("best_accuracy").alias("value"),
    )
    paper = read_paper_results(acts.sparkSession, paper_paths)
    return {"results": results, "best": best, "comparison": probes.compare_results(ours, paper)}
