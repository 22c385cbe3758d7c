"""Dictionaries as tables: the same codes, reconstructions and fits as with one array, whatever the size of the groups."""

import os

import numpy as np
import pytest

from spanlake.operators import fitting, latent_blocks, sae
from spanlake.plans import training
from spanlake.sources import runs


def params_of(d, n, seed=1):
    rng = np.random.default_rng(seed)
    w = rng.normal(size=(n, d))
    w[n // 2] = w[0]  # equal latents in different groups
    return sae.SaeParams(w, rng.normal(size=(n, d)), rng.normal(size=n) * 0.1, rng.normal(size=d) * 0.1)


def frame(spark, x, parts=3):
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "global_idx long, vector array<double>").repartition(parts)


@pytest.mark.parametrize("at_once", [1, 3, 50])
def test_codes_and_reconstructions(spark, monkeypatch, at_once):
    monkeypatch.setattr(latent_blocks, "CHUNK_BYTES", 8 * 6 * 7)  # seven vectors
    p = params_of(6, 11)
    x = np.random.default_rng(2).normal(size=(40, 6))
    x[5] = 0
    df = frame(spark, x)
    model = latent_blocks.LatentTable(p.to_table(spark), p.b_dec, max_bytes=at_once * 2 * 8 * 6)
    assert len(model.groups) == -(-11 // at_once)
    want = {r.global_idx: r for r in sae.decode(sae.encode(df, p, 4), p).collect()}
    for r in latent_blocks.encode(df, model, 4, ["global_idx"]).collect():
        assert [e.latent_id for e in r.code] == [e.latent_id for e in want[r.global_idx].code]
        assert np.allclose([e.strength for e in r.code], [e.strength for e in want[r.global_idx].code])
    rows = latent_blocks.coded(df, model, 4, ["global_idx"]).collect()
    assert len(rows) == 40 and all(np.allclose(r.xhat, want[r.global_idx].xhat) for r in rows)


def test_empty_table_and_more_active_than_latents(spark):
    p = params_of(3, 2)
    model = latent_blocks.LatentTable(p.to_table(spark), p.b_dec, max_bytes=1)
    none = spark.createDataFrame([], "global_idx long, vector array<double>")
    assert latent_blocks.encode(none, model, 5, ["global_idx"]).collect() == []
    df = frame(spark, np.random.default_rng(0).normal(size=(4, 3)), 1)
    want = {r.global_idx: [e.latent_id for e in r.code] for r in sae.encode(df, p, 5).collect()}
    assert {r.global_idx: [e.latent_id for e in r.code] for r in latent_blocks.encode(df, model, 5, ["global_idx"]).collect()} == want


def test_ids_must_be_dense(spark):
    with pytest.raises(ValueError, match="latent ids"):
        latent_blocks.LatentTable(params_of(3, 4).to_table(spark).where("latent_id <> 1"))


@pytest.mark.parametrize("start", [None, params_of(5, 9)], ids=["random start", "given start"])
def test_fit_in_groups_is_the_whole_fit(spark, start):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5, 5))[rng.integers(0, 5, 120)] + 0.1 * rng.normal(size=(120, 5))
    cfg = fitting.FitConfig(n_latents=9, k=2, steps=2, max_epochs=2, lr=0.05)
    one = fitting.fit_topk_sae(frame(spark, x), cfg, start=start)
    two = fitting.fit_topk_sae(frame(spark, x, 5), cfg, start=start, max_bytes=4 * 8 * latent_blocks.FIT_COPIES * 5)
    assert isinstance(two.params, latent_blocks.LatentTable) and len(two.params.groups) == 3
    assert [h["val_loss"] for h in two.history] == pytest.approx([h["val_loss"] for h in one.history])
    assert two.n_train == one.n_train and (two.fired == one.fired).all()
    back = sae.SaeParams.from_table(two.params.to_table(spark), two.params.b_dec)
    for name in ("w_enc", "w_dec", "b_enc", "b_dec"):
        assert np.allclose(getattr(back, name), getattr(one.params, name), atol=1e-8), name
    two.params.close()


def test_run_of_a_table(spark, folder):
    """A whole training run with a model above the limit gives the artifacts of one below it."""
    x = np.random.default_rng(4).normal(size=(80, 4))
    cfg = fitting.FitConfig(n_latents=6, k=2, steps=1, max_epochs=2, lr=0.05)
    made = {}
    for name, most in (("whole", 1 << 30), ("table", 1)):
        run = training.train_run(frame(spark, x), 3, cfg, f"{folder}/{name}", max_bytes=most)
        row = runs.read_run_table(spark, f"{folder}/{name}", "metrics").where(f"run = '{run}'").first()
        made[name] = (row.final_recon_loss, row.explained_variance, row.mean_l0, *row.firing_rate)
    assert made["table"] == pytest.approx(made["whole"])


@pytest.mark.parametrize("most", [1 << 30, 1], ids=["whole", "table"])
def test_broadcasts_are_destroyed(spark, monkeypatch, most):
    """No step leaves a copy of the model behind, in the driver's files or on executors."""
    kind, made = type(spark.sparkContext), []
    send = kind.broadcast
    monkeypatch.setattr(kind, "broadcast", lambda self, value: made.append(send(self, value)) or made[-1])
    x = np.random.default_rng(4).normal(size=(60, 4))
    fitting.fit_topk_sae(frame(spark, x), fitting.FitConfig(n_latents=2, k=1, steps=1, max_epochs=2), max_bytes=most)
    assert len(made) >= 4 and not any(os.path.exists(b._path) for b in made)


def test_gradient_sums_take_one_python_step(spark):
    """A task gives each latent once, so its sums go to the shuffle without a second Python process beside the first."""
    from spanlake.operators.pooling import sum_vectors

    parts = spark.createDataFrame([(i % 3, 2, [float(i), 1.0]) for i in range(12)], "latent_id int, n long, vector array<double>")
    plans = [sum_vectors(parts, ["latent_id"], "vector", "n", folded=f) for f in (False, True)]
    assert [p._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") for p in plans] == [2, 1]
    one, other = (sorted((r.latent_id, r._n, r._total) for r in p.collect()) for p in plans)
    assert one == other == [(i, 8, [18.0 + 4 * i, 4.0]) for i in range(3)]
