"""Probe examples, linear probes per (family, layer, head), and the comparison with published numbers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake import fixed
from spanlake.functions.arrays import codes, matrix, vectors_column
from spanlake.functions.vectors import dot
from spanlake.operators.fitting import moved
from spanlake.operators.index import val_rule
from spanlake.operators.pooling import sum_vectors
from spanlake.session import remove, scratch_dir


def label_summary(examples: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: examples, how many of each label, rate of label 1."""
    label = F.col(label_col)
    return examples.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(label == 1).alias("n_label_1"),
        F.count_if(label == 0).alias("n_label_0"),
        F.avg(label.cast("double")).alias("rate"),
    )


def labels_valid(examples: DataFrame, label_col: str = "label") -> DataFrame:
    """One row: not empty, only labels 0 and 1, and both of them. A text column has to exist, its values may be null."""
    if "text" not in examples.columns or label_col not in examples.columns:
        return examples.sparkSession.range(1).select(F.lit(False).alias("valid"))
    label = F.col(label_col)
    ok = F.bool_and(F.coalesce(label.isin(0, 1), F.lit(False)))
    return examples.agg((ok & (F.countDistinct(label) == 2)).alias("valid")).select(
        F.coalesce("valid", F.lit(False)).alias("valid")
    )


def probe_dataset(acts: DataFrame, labels: DataFrame, key: str = "example_id") -> DataFrame:
    """Activations with the label of their example."""
    return acts.join(labels.select(key, "label"), key)


@dataclass(frozen=True)
class ProbeConfig:
    """Settings of the probes: each takes ``steps`` Adam steps over all of its training rows, from zero weights."""

    lr: float = 0.02
    steps: int = 100
    val_frac: float = 0.2
    seed: int = 0


#: Weights of the probes that are fitted together, with their Adam state; more probes are fitted wave by wave.
MAX_WAVE_BYTES = 512 << 20


_GROUP = ["family", "layer", "head"]


def wilson(accuracy: Column, n: Column) -> tuple[Column, Column]:
    """Wilson 95 % interval of a share."""
    z = 1.959963984540054
    spread = z * F.sqrt(accuracy * (1 - accuracy) / n + z * z / (4 * n * n))
    middle, scale = accuracy + z * z / (2 * n), 1 + z * z / n
    return (middle - spread) / scale, (middle + spread) / scale


def probe_gradients(train: DataFrame, weights: dict[tuple, np.ndarray]) -> dict[tuple, np.ndarray]:
    """Mean gradient of the cross entropy per probe over all of its rows; the last entry belongs to the bias."""
    shared = train.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType(
        [*(train.schema[c] for c in _GROUP), T.StructField("n", T.LongType()), T.StructField("vector", T.ArrayType(T.DoubleType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            code = codes(batch, _GROUP)
            batch = batch.take(pa.array(np.argsort(code, kind="stable")))
            starts = np.append(np.flatnonzero(np.diff(np.sort(code), prepend=-1)), batch.num_rows)
            labels = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            heads = [batch.column(c).take(pa.array(starts[:-1])) for c in _GROUP]
            for at, key in enumerate(zip(*(h.to_pylist() for h in heads))):  # probes, not rows
                own = slice(starts[at], starts[at + 1])
                x = np.hstack([matrix(batch.column("vector")[own]), np.ones((own.stop - own.start, 1))])
                w = shared.value.get(key, np.zeros(x.shape[1]))
                p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
                total = vectors_column((x.T @ (p - labels[own]))[None, :])
                yield pa.RecordBatch.from_arrays([*(h.slice(at, 1) for h in heads), pa.array([len(x)], pa.int64()), total], names=schema.fieldNames())

    sums = sum_vectors(train.mapInArrow(run, schema), _GROUP, "vector", "n").toLocalIterator()
    found = {tuple(r[c] for c in _GROUP): np.array(r["_total"]) / r["_n"] for r in sums}
    shared.destroy()
    return found


def waves_of(sizes: list[tuple[int, int]], max_bytes: int) -> int:
    """How many waves by hash keep each wave's weights and moments within ``max_bytes``, from (hash, weights) per probe. A probe
    that is larger by itself has a wave of its own."""
    n = max(1, -(-24 * sum(size for _, size in sizes) // max_bytes))
    while n < 1 << 20:
        held: dict[int, list[int]] = {}
        for h, size in sizes:
            held.setdefault(h % n, []).append(size)
        if all(24 * sum(own) <= max_bytes or len(own) == 1 for own in held.values()):
            break
        n *= 2
    return n


def fit_weights(train: DataFrame, cfg: ProbeConfig, folder: str, max_bytes: int = MAX_WAVE_BYTES) -> DataFrame:
    """Weights and bias of every probe, written below ``folder``. One job per step for all probes of a wave: gradients are
    summed in the tasks, weights and Adam state of the wave stay on the driver. Probes do not depend on each other, so waves
    change nothing in the result; a wave's rows are laid out together once, and no probe's rows are held."""
    spark, key_hash = train.sparkSession, F.xxhash64(*_GROUP)
    # one row per probe
    sizes = [(r["h"], r["d"] + 1) for r in train.groupBy(*_GROUP).agg(F.max(F.size("vector")).alias("d")).select(key_hash.alias("h"), "d").collect()]
    n_waves = waves_of(sizes, max_bytes)
    schema = T.StructType([*(train.schema[c] for c in _GROUP), T.StructField("weights", T.ArrayType(T.DoubleType()))])
    if n_waves > 1:
        train.withColumn("_wave", F.pmod(key_hash, F.lit(n_waves))).repartition("_wave", F.pmod(F.xxhash64("vector"), F.lit(64))).write.partitionBy("_wave").parquet(f"{folder}/waves")
    spark.createDataFrame([], schema).write.parquet(f"{folder}/weights")
    for wave in sorted({h % n_waves for h, _ in sizes}):
        rows = train if n_waves == 1 else spark.read.schema(train.schema).parquet(f"{folder}/waves/_wave={wave}")
        w: dict[tuple, np.ndarray] = {}
        m, v = {}, {}
        for t in range(1, cfg.steps + 1):
            for key, g in probe_gradients(rows, w).items():
                w[key], m[key], v[key] = moved(w.get(key, np.zeros(len(g))), g, m.get(key, 0.0), v.get(key, 0.0), t, cfg.lr)
        fitted = spark.createDataFrame([(*key, own.tolist()) for key, own in w.items()], schema)
        fitted.write.mode("append").parquet(f"{folder}/weights")
    return spark.read.schema(schema).parquet(f"{folder}/weights")


def fit_probes(dataset: DataFrame, cfg: ProbeConfig = ProbeConfig(), max_bytes: int = MAX_WAVE_BYTES) -> DataFrame:
    """One linear probe per (family, layer, head): ``accuracy`` on held-out examples with its interval, ``weights``.

    The weights lie in a scratch folder, which the result reads. All probes share one exact split by example. A probe without training or without held-out rows is left out.
    """
    spark = dataset.sparkSession
    examples = dataset.select("example_id").distinct()
    rule = val_rule(examples, cfg.val_frac, ["example_id"], cfg.seed)
    rows = dataset.withColumn("is_val", rule).withColumn("head", F.coalesce("head", F.lit(-1)))
    folder, kept = scratch_dir(spark), scratch_dir(spark)
    try:
        # the steps read the joined rows from here
        rows.filter(~F.col("is_val")).select(*_GROUP, "vector", "label").write.parquet(folder)
        weights = fit_weights(spark.read.parquet(folder), cfg, kept, max_bytes)
    finally:
        remove(spark, folder)
        remove(spark, f"{kept}/waves")
    held = rows.filter("is_val").select(*_GROUP, "vector", "label").join(weights, _GROUP)
    logit = dot(F.concat(F.col("vector").cast("array<double>"), F.array(F.lit(1.0))), F.col("weights"))
    hit = ((logit > 0).cast("int") == F.col("label")).cast("int")
    scored = held.select(*_GROUP, hit.alias("hit")).groupBy(*_GROUP).agg(
        F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("n_val")
    )
    low, high = wilson(F.col("accuracy"), F.col("n_val"))
    out = scored.withColumn("ci_low", low).withColumn("ci_high", high).join(weights, _GROUP)
    return out.withColumn("head", F.when(F.col("head") >= 0, F.col("head")))


def best_probe(results: DataFrame, families: tuple[str, ...] = fixed.PROBE_FAMILIES) -> DataFrame:
    """Best accuracy per family with the layer it was reached at (the lowest of equals); 0 for a family without results."""
    order = F.struct("accuracy", -F.col("layer"))
    best = results.groupBy("family").agg(
        F.max("accuracy").alias("best_accuracy"), F.max_by("layer", order).alias("best_layer"), F.count(F.lit(1)).alias("n_probes")
    )
    every = results.sparkSession.createDataFrame([(f,) for f in families], "family string")
    joined = every.join(best, "family", "left")
    return joined.select(
        "family",
        F.coalesce("best_accuracy", F.lit(0.0)).alias("best_accuracy"),
        "best_layer",
        F.coalesce("n_probes", F.lit(0)).alias("n_probes"),
    )


def missing_families(results: DataFrame, families: tuple[str, ...] = fixed.PROBE_FAMILIES) -> DataFrame:
    """Required families that have no result yet."""
    every = results.sparkSession.createDataFrame([(f,) for f in families], "family string")
    return every.join(results.select("family").distinct(), "family", "left_anti")


def compare_results(ours: DataFrame, paper: DataFrame, tol: float = fixed.COMPARE_TOLERANCE) -> DataFrame:
    """Our value next to the published one, by model and metric, with a verdict.

    No published value gives ``NO PAPER REF``, a difference within ``tol`` gives ``VERIFIED``, any other is written out.
    """
    joined = ours.withColumnRenamed("value", "ours").join(
        paper.withColumnRenamed("value", "paper"), ["model", "metric"], "left"
    )
    delta = F.col("ours") - F.col("paper")
    verdict = (
        F.when(F.col("paper").isNull(), fixed.NO_PAPER_REF)
        .when(F.abs(delta) <= tol, fixed.VERIFIED)
        .otherwise(F.format_string("%+.3f", F.round(delta, 3)))
    )
    return joined.select("model", "metric", "ours", "paper", delta.alias("delta"), verdict.alias("verdict"))
