"""Codes, pooling, fits and probes against NumPy."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanlake.functions import vectors
from spanlake.operators import fitting, gates, index, metrics, pooling, probes, sae
from spanlake.plans import training
from spanlake.sources import runs


def vector_frame(spark, x, parts=4):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "global_idx long, vector array<double>").repartition(parts)


@pytest.mark.parametrize("width", [6, 200])
def test_largest_breaks_ties_by_lower_column(width):
    rng = np.random.default_rng(0)
    z = rng.integers(-3, 4, size=(300, width)).astype(float)
    ids, values = vectors.largest(z, 3)
    for row, i, v in zip(z, ids, values):
        want = sorted((j for j in range(width) if row[j] > 0), key=lambda j: (-row[j], j))[:3]
        assert i.tolist() == want + [-1] * (3 - len(want))
        assert v.tolist() == [row[j] for j in want] + [0.0] * (3 - len(want))


def random_params(d, n, seed=1):
    rng = np.random.default_rng(seed)
    return sae.SaeParams(rng.normal(size=(n, d)), rng.normal(size=(n, d)), rng.normal(size=n), rng.normal(size=d))


def test_encode_decode_and_blocks(spark):
    x = np.random.default_rng(2).normal(size=(40, 5))
    p = random_params(5, 12)
    df = vector_frame(spark, x)
    z = (x - p.b_dec) @ p.w_enc.T + p.b_enc
    ids, values = vectors.largest(z, 3)
    dense = np.zeros_like(z)
    for r in range(len(x)):
        for i, v in zip(ids[r], values[r]):
            if i >= 0:
                dense[r, i] = v
    got = sae.decode(sae.encode(df, p, 3), p).orderBy("global_idx").collect()
    assert all(len(r.code) <= 3 and all(e.strength > 0 for e in r.code) for r in got)
    assert np.allclose([r.xhat for r in got], dense @ p.w_dec + p.b_dec)
    blocks = sae.encode(df, p, 3, max_bytes=5 * 8 * 4).orderBy("global_idx").collect()
    assert [r.code for r in blocks] == [r.code for r in got]
    coded = sae.encode(df, p, 3)
    parts = sae.decode(coded, p, max_bytes=5 * 8 * 4).orderBy("global_idx").collect()
    assert np.allclose([r.xhat for r in parts], [r.xhat for r in got])
    pre = sae.preactivations(df, p, max_bytes=5 * 8 * 4).orderBy("global_idx").collect()
    assert np.allclose([r.z_pre for r in pre], z)
    # repeated and missing ids are rows like others
    odd = df.withColumn("global_idx", F.when(F.col("global_idx") > 5, 1))
    forms = [sae.decode(sae.encode(odd, p, 3, max_bytes=b), p, max_bytes=b) for b in (1 << 20, 5 * 8 * 4)]
    rows = [sorted((str(r.global_idx), r.code) for r in f.collect()) for f in forms]
    assert rows[0] == rows[1] and len(rows[0]) == len(x)


def test_assignment_of_rows_that_do_not_fire(spark):
    p = sae.SaeParams(np.eye(2), np.eye(2), np.zeros(2), np.zeros(2))
    df = vector_frame(spark, np.array([[-1.0, -2.0], [3.0, -1.0], [2.0, 2.0]]))
    rows = sae.assignments(sae.encode(df, p, 2), 3).orderBy("global_idx").collect()
    assert [(r.latent_id, r.strength, r.topk) for r in rows] == [
        (-1, 0.0, [-1, -1, -1]),
        (0, 3.0, [0, -1, -1]),
        (0, 2.0, [0, 1, -1]),
    ]
    sizes = metrics.cluster_sizes(sae.assignments(sae.encode(df, p, 2), 3), 3).orderBy("latent_id").collect()
    assert [r.cluster_size for r in sizes] == [2, 0, 0]


def test_params_round_trip(spark):
    p = random_params(4, 6)
    q = sae.SaeParams.from_table(p.to_table(spark), p.b_dec)
    assert all(np.array_equal(a, b) for a, b in zip(p.arrays, q.arrays))
    with pytest.raises(ValueError):
        sae.SaeParams.from_table(p.to_table(spark), max_bytes=10)


@pytest.mark.parametrize("top_n, block", [(7, 3), (9, 512), (40, 4), (5, 1)])
def test_cosine_matrix_in_blocks(spark, top_n, block):
    x = np.random.default_rng(5).normal(size=(12, 6))
    x[3] = 0
    size = [int(s) for s in np.random.default_rng(6).integers(1, 5, 12)]
    latents = spark.createDataFrame([(i, size[i], x[i].tolist()) for i in range(12)], "latent_id int, n long, w_dec array<double>")
    best = sorted(range(12), key=lambda i: (-size[i], i))[:top_n]
    unit = x[best] / np.maximum(np.linalg.norm(x[best], axis=1, keepdims=True), 1e-8)
    found = {(r.i, r.latent_id, r.j): r.cosine for r in sae.cosine_matrix(latents, top_n, "n", ["latent_id"], block=block).collect()}
    assert set(found) == {(i, best[i], j) for i in range(len(best)) for j in range(len(best))}
    assert all(np.isclose(c, unit[i] @ unit[j]) for (i, _, j), c in found.items())


def test_cosine_matrix_of_no_latents(spark):
    none = spark.createDataFrame([], "latent_id int, n long, w_dec array<double>")
    assert sae.cosine_matrix(none, 3, "n", ["latent_id"]).collect() == []


def test_sums_with_one_heavy_key(spark):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(500) < 0.7, 0, rng.integers(1, 40, 500))
    x = rng.normal(size=(500, 3))
    rows = [(int(k), None if k % 5 == 0 else f"g{k % 3}", v.tolist()) for k, v in zip(keys, x)]
    df = spark.createDataFrame(rows, "k int, g string, vector array<double>").repartition(6)
    got = {(r.k, r.g): (r.n, r.vector) for r in pooling.mean_vectors(df, ["k", "g"]).collect()}
    assert len(got) == len(set(keys))
    for (k, _), (n, mean) in got.items():
        assert n == (keys == k).sum() and np.allclose(mean, x[keys == k].mean(axis=0))
    assert np.allclose(pooling.global_center(df).first()[0], x.mean(axis=0))


def test_pooling_forms_agree(spark):
    rng = np.random.default_rng(4)
    spans = {"a": [(0, 3), (3, 9), (0, 200)], "b": [(5, 6), (2, 2)]}
    vecs = {"a": rng.normal(size=(200, 4)), "b": rng.normal(size=(8, 4))}
    tv = spark.createDataFrame(
        [(r, layer, t, (v * layer).tolist()) for r, m in vecs.items() for layer in (1, 2) for t, v in enumerate(m)],
        "response_id string, layer int, tok_idx long, vector array<double>",
    )
    sp = spark.createDataFrame(
        [(r, i, a, b) for r, s in spans.items() for i, (a, b) in enumerate(s)],
        "response_id string, sent_idx long, tok_start long, tok_end long",
    )
    got = {(r.response_id, r.sent_idx, r.layer): r.vector for r in pooling.mean_pool(tv, sp, width=16).collect()}
    assert len(got) == 10
    for (r, i, layer), mean in got.items():
        a, b = spans[r][i]
        assert mean is None if a == b else np.allclose(mean, layer * vecs[r][a:b].mean(axis=0))
    nested = spark.createDataFrame(
        [(r, vecs[r].tolist(), spans[r]) for r in spans],
        "response_id string, v array<array<double>>, spans array<struct<tok_start:long,tok_end:long>>",
    )
    holed = nested.withColumn("v", F.when(F.col("response_id") == "a", F.transform("v", lambda t: F.transform(t, lambda x: x * float("nan")))).otherwise(F.col("v")))
    other = {r.response_id: r.pooled for r in pooling.pool_nested(holed, "v", "spans").collect()}
    assert np.allclose(other["b"][0], vecs["b"][5]) and np.isnan(other["a"][0]).all()
    for row in pooling.pool_nested(nested, "v", "spans").collect():
        for i, mean in enumerate(row.pooled):
            assert mean is None if got[row.response_id, i, 1] is None else np.allclose(mean, got[row.response_id, i, 1])


def test_pooling_by_prefix_sums(spark):
    """Random spans over responses of which one holds most tokens, with gaps, null vectors and repeated places."""
    rng = np.random.default_rng(6)
    tokens, spans = [], []
    for r, n in (("hot", 900), ("b", 40), ("c", 1), (None, 5)):
        for t in range(n):
            if t % 7 != 3:
                tokens.append((r, 1, t, None if t % 11 == 5 else rng.normal(size=3).tolist()))
            if t % 50 == 0:
                tokens.append((r, 1, t, rng.normal(size=3).tolist()))
    for i in range(120):
        a = int(rng.integers(0, 900))
        spans.append(("hot", i, a, a + int(rng.integers(0, 400))))
    spans += [("b", 0, 0, 40), ("b", 1, 3, 4), ("b", 2, 39, 900), ("c", 0, 0, 1), ("none", 0, 0, 3), (None, 0, 0, 5)]
    tv = spark.createDataFrame(tokens, "response_id string, layer int, tok_idx int, vector array<double>").repartition(6)
    sp = spark.createDataFrame(spans, "response_id string, sent_idx long, tok_start long, tok_end long").repartition(3)
    got = {(r.response_id, r.sent_idx): r for r in pooling.mean_pool(tv, sp, width=32).collect()}
    assert len(got) == len(spans)
    for r, i, a, b in spans:
        inside = [v for q, _, t, v in tokens if q == r is not None and a <= t < b and v is not None]
        row = got[r, i]
        assert row.n_vectors == len(inside) and row.layer == (1 if r in ("hot", "b", "c") else None)
        assert row.vector is None if not inside else np.allclose(row.vector, np.mean(inside, axis=0))


def test_pooling_moves_each_vector_once(spark):
    """Token vectors pass one exchange, by response and run of places; the other one moves sums of spans."""
    tv = spark.createDataFrame([("a", 0, [1.0])], "response_id string, tok_idx long, vector array<double>")
    sp = spark.createDataFrame([("a", 0, 0, 1)], "response_id string, sent_idx long, tok_start long, tok_end long")
    plan = pooling.mean_pool(tv, sp, extra_keys=[])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "hashpartitioning(response_id" in plan


def test_pooling_sends_packed_rows_to_python(spark, monkeypatch):
    """Python gets a row for many tokens, and the sums are those of every single one: spans over several packs and runs, without
    a place, without a token, given twice; tokens in any order, given twice, without a place."""
    rng = np.random.default_rng(9)
    tokens = [("a", int(t), rng.normal(size=2).tolist()) for t in rng.permutation(2000)]
    tokens += [("a", 70, [5.0, 1.0]), ("a", None, [1e9, 1e9]), ("b", 3, [1.0, 2.0])]
    spans = [("a", i, 37 * i, 37 * i + 90) for i in range(50)] + [("a", 60, 10, 1990), ("b", 0, 0, 9), ("b", 1, 4, 9), ("a", 5, 0, 3)]
    spans += [("a", 70, 8, 8), ("a", 71, None, 5), ("b", 72, 5, None), ("none", 0, 0, 4), ("none", 1, None, None)]
    received, real = spark.sparkContext.accumulator(0), pooling._prefix_sums

    def counting(*args):
        run = real(*args)

        def seen(batches):
            for batch in batches:
                received.add(batch.num_rows)
                yield batch

        return lambda batches: run(seen(batches))

    monkeypatch.setattr(pooling, "_prefix_sums", counting)
    tv = spark.createDataFrame(tokens, "response_id string, tok_idx int, vector array<double>").repartition(5)
    sp = spark.createDataFrame(spans, "response_id string, sent_idx long, tok_start long, tok_end long").repartition(3)
    rows = pooling.mean_pool(tv, sp, extra_keys=[], width=256).collect()
    assert 0 < received.value < len(tokens) / 10
    got = {(r.response_id, r.sent_idx): r for r in rows}
    assert len(rows) == len(got) == len({s[:2] for s in spans})
    for key, row in got.items():
        inside = [
            v for r, i, a, b in spans if (r, i) == key and None not in (a, b) for q, t, v in tokens if q == r and t is not None and a <= t < b
        ]
        assert row.n_vectors == len(inside)
        assert row.vector is None if not inside else np.allclose(row.vector, np.mean(inside, axis=0))


def test_dense_index(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("same")).repartition(9)
    rows = index.dense_index(df, [F.col("k").desc()]).collect()
    assert {r.global_idx: r.k for r in rows} == {i: 4999 - i for i in range(5000)}
    assert gates.check_keys(index.dense_index(df, ["k"])).first().dense


def test_dense_index_moves_keys_not_texts(spark):
    rows = [(None if i == 3 else i * 7919 % 500, i % 2, f"text {i}", i) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, j int, text string, global_idx int").repartition(7)
    got = index.dense_index(df, ["j", "k"])
    assert got.columns == ["k", "j", "text", "global_idx"]
    want = sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or 0))
    assert [(r.k, r.j, r.text) for r in got.orderBy("global_idx").collect()] == [r[:3] for r in want]
    assert [r.global_idx for r in got.orderBy("global_idx").collect()] == list(range(500))
    # the numbers come from a checkpoint of the keys alone
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_key0" in plan and "rangepartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    twice = index.dense_index(df.unionAll(df), ["k"])  # repeated keys
    assert sorted(r.global_idx for r in twice.collect()) == list(range(1000))
    assert [r.k for r in twice.orderBy("global_idx").collect()][2:] == sorted(2 * [r[0] for r in rows if r[0] is not None])


def test_split_is_exact_and_independent_of_layout(spark):
    for n, frac, want in [(1, 0.05, 1), (1000, 0.05, 50), (39, 0.05, 1), (40, 0.5, 20)]:
        df = spark.range(n).withColumnRenamed("id", "i")
        rows = index.train_val_split(df.repartition(5), frac, ["i"]).collect()
        order = sorted(range(n), key=lambda i: hashlib.md5(f"0|{i}".encode()).hexdigest())
        assert {r.i for r in rows if r.is_val} == set(order[:want])


def test_hash_cutoff_goes_into_deep_prefixes(spark):
    h = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("h"))
    ordered = sorted(r.h for r in h.collect())
    for n in (1, 2, 1500, 2999, 3000):
        assert index.hash_cutoff(h, lambda _, n=n: n, digits=1, small=3) == ordered[n - 1]
    assert index.hash_cutoff(h, lambda total: total // 2) == ordered[1499]
    assert index.hash_cutoff(h, lambda total: total + 1) is None and index.hash_cutoff(h, lambda _: 0) is None


def numeric_gradient(p, x, k, name, at, eps=1e-6):
    def loss(delta):
        arrays = {f: getattr(p, f).copy() for f in ("w_enc", "w_dec", "b_enc", "b_dec")}
        arrays[name][at] += delta
        return fitting.gradients(sae.SaeParams(**arrays), x, k)[2]

    return (loss(eps) - loss(-eps)) / (2 * eps)


def test_gradients_match_finite_differences():
    x = np.random.default_rng(5).normal(size=(20, 4))
    p = random_params(4, 7)
    grads, fired, loss = fitting.gradients(p, x, 3)
    assert loss > 0 and fired.any()
    for name, g in grads.items():
        for at in [tuple(0 for _ in g.shape), tuple(s - 1 for s in g.shape)]:
            assert g[at] == pytest.approx(numeric_gradient(p, x, 3, name, at), rel=1e-4, abs=1e-6)


def test_spark_gradient_equals_numpy(spark):
    x = np.random.default_rng(6).normal(size=(60, 5))
    p = random_params(5, 8)
    got, fired, loss = fitting.full_gradient(vector_frame(spark, x).select("vector"), p, 3)
    want, active, total = fitting.gradients(p, x, 3)
    assert loss == pytest.approx(total / x.size) and (fired == active).all()
    for name in want:
        assert np.allclose(got[name], want[name] / x.size)
    assert fitting.reconstruction_loss(vector_frame(spark, x), p, 3) == pytest.approx(total / x.size)


def clustered(n=600, d=8, k=5, seed=7):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(k, d))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    which = rng.integers(0, k, n)
    return centers[which] * rng.uniform(1, 2, (n, 1)) + 0.05 * rng.normal(size=(n, d))


def test_fit_matches_numpy_over_several_epochs(spark):
    x = clustered(300)
    cfg = fitting.FitConfig(n_latents=6, k=2, steps=1, max_epochs=5, lr=0.02)
    df = vector_frame(spark, x)
    fit = fitting.fit_topk_sae(df, cfg)
    split = index.train_val_split(df, cfg.val_frac, ["global_idx"]).collect()
    train, val = (np.array([r.vector for r in split if r.is_val == v]) for v in (False, True))
    params, m, v = fitting.start_params(x.shape[1], 6, 0), {}, {}
    for h in fit.history:
        grads, _, _ = fitting.gradients(params, train, 2)
        new = {}
        for n, g in grads.items():
            new[n], m[n], v[n] = fitting.moved(getattr(params, n), g / train.size, m.get(n, 0), v.get(n, 0), h["epoch"], 0.02)
        params = fitting.unit_decoder(sae.SaeParams(**new))
        _, _, off = fitting.gradients(params, val, 2)
        assert h["val_loss"] == pytest.approx(off / val.size)


def test_fit_improves_and_does_not_depend_on_layout(spark):
    x = clustered()
    cfg = fitting.FitConfig(n_latents=8, k=2, steps=4, max_epochs=6, lr=0.02)
    one = fitting.fit_topk_sae(vector_frame(spark, x, 2), cfg)
    losses = [h["val_loss"] for h in one.history]
    assert one.best_val_loss == min(losses) <= losses[0]
    assert np.allclose(np.linalg.norm(one.params.w_dec, axis=1), 1)
    two = fitting.fit_topk_sae(vector_frame(spark, x, 5), cfg)
    assert [h["val_loss"] for h in two.history] == pytest.approx(losses)


def test_best_epoch_is_restored_and_patience_stops(spark):
    x = clustered(200)
    cfg = fitting.FitConfig(n_latents=4, k=2, max_epochs=30, lr=1.5, patience=2)
    fit = fitting.fit_topk_sae(vector_frame(spark, x), cfg)
    assert fit.early_stopped and len(fit.history) < 30
    df = vector_frame(spark, x).select("global_idx", "vector")
    val = index.train_val_split(df, cfg.val_frac, ["global_idx"]).filter("is_val")
    assert fitting.reconstruction_loss(val, fit.params, 2) == pytest.approx(fit.best_val_loss)


def test_train_run_writes_and_skips_finished_runs(spark, folder):
    x = vector_frame(spark, clustered(300))
    grid = [fitting.FitConfig(n_latents=n, k=2, steps=2, max_epochs=2, lr=0.02) for n in (3, 4)]
    names = training.sweep(x, 18, grid, folder)
    assert names == ["L18_n3_k2_uncentered_s0", "L18_n4_k2_uncentered_s0"]
    stamps = {r.run: r.timestamp for r in runs.read_run_table(spark, folder, "config").collect()}
    assert training.sweep(x, 18, grid, folder) == names
    assert {r.run: r.timestamp for r in runs.read_run_table(spark, folder, "config").collect()} == stamps
    for row in runs.read_run_table(spark, folder, "metrics").collect():
        n = int(row.run.split("_n")[1].split("_")[0])
        assert len(row.firing_rate) == n and row.mean_l0 <= 2 and row.n_epochs_trained == 2
    assigned = runs.read_run_table(spark, folder, "assignments", names[0])
    assert assigned.count() == 300 and gates.check_keys(assigned).first().dense
    stored = runs.read_params(spark, folder, names[0])
    again = sae.assignments(sae.encode(x, stored, 2), 2).orderBy("global_idx").collect()
    assert [(r.global_idx, r.latent_id) for r in again] == [
        (r.global_idx, r.latent_id) for r in assigned.orderBy("global_idx").collect()
    ]
    centered = training.train_run(x, 18, grid[0], folder, response_vectors=x)
    assert centered == "L18_n3_k2_centered_s0"


def test_probes_learn_a_separable_label_and_not_noise(spark, folder):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(300):
        label = i % 2
        signal = rng.normal(size=4) + (2 * label - 1) * np.array([2.0, 0, 0, 0])
        rows.append(("mha", 3, 1, i, label, signal.tolist()))
        rows.append(("mlp", 3, None, i, label, rng.normal(size=4).tolist()))
    df = spark.createDataFrame(rows, "family string, layer int, head int, example_id long, label int, vector array<double>")
    got = {r.family: r for r in probes.fit_probes(df, probes.ProbeConfig(lr=0.05, steps=30)).collect()}
    assert got["mha"].accuracy > 0.9 and got["mlp"].accuracy < 0.8
    assert got["mha"].head == 1 and got["mlp"].head is None
    assert all(r.n_val == 60 and r.ci_low < r.accuracy < r.ci_high for r in got.values() if r.accuracy < 1)
    train = df.select("family", "layer", F.coalesce("head", F.lit(-1)).alias("head"), "vector", "label").repartition(3)
    for name, most in (("one", 1 << 20), ("waves", 24 * 5)):  # all together, and one probe at a time
        fitted = probes.fit_weights(train, probes.ProbeConfig(lr=0.05, steps=4), f"{folder}/{name}", most)
        assert fitted.count() == 2
        w = fitted.where("family = 'mha'").first().weights
        assert np.allclose(w, own_weights(rows))
    best = {r.family: r.best_accuracy for r in probes.best_probe(probes.fit_probes(df, probes.ProbeConfig(steps=3))).collect()}
    assert set(best) == {"mha", "mlp", "residual"} and best["residual"] == 0.0
    assert [r.family for r in probes.missing_families(df).collect()] == ["residual"]


def own_weights(rows):
    """Four steps of the first probe in NumPy."""
    x = np.array([[*r[5], 1.0] for r in rows if r[0] == "mha"])
    y = np.array([r[4] for r in rows if r[0] == "mha"], float)
    own, m, v = np.zeros(5), 0, 0
    for t in range(1, 5):
        g = x.T @ (1 / (1 + np.exp(-x @ own)) - y) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        own = own - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return own


def test_waves_hold_what_fits():
    sizes = [(i * 7919, 100) for i in range(50)]
    for most in (1 << 30, 24 * 100 * 10, 1):
        n = probes.waves_of(sizes, most)
        held = {}
        for h, size in sizes:
            held.setdefault(h % n, []).append(size)
        assert all(24 * sum(own) <= most or len(own) == 1 for own in held.values())
    assert probes.waves_of(sizes, 1 << 30) == 1 and probes.waves_of([], 1) == 1


def test_labels_valid(spark):
    def valid(rows):
        return probes.labels_valid(spark.createDataFrame(rows, "text string, label int")).first().valid

    assert valid([("a", 0), (None, 1)])
    assert not valid([("a", 0), ("b", 0)])
    assert not valid([("a", 0), ("b", 1), ("c", 2)])
    assert not valid([("a", 0), ("b", 1), ("c", None)])
    assert not valid([])
    assert not probes.labels_valid(spark.createDataFrame([(1,)], "label int")).first().valid


def test_empty_sample_has_no_verdict(spark):
    row = gates.span_verdict(spark.createDataFrame([], "agrees boolean")).first()
    assert (row.n, row.pass_rate, row.passed) == (0, None, None)


def test_probe_benchmark(spark, tmp_path):
    import json

    from spanlake.plans.probing import probe_benchmark

    rng = np.random.default_rng(9)
    rows = []
    for i in range(120):
        shift = np.array([3.0 * (2 * (i % 2) - 1), 0.0])
        for family, head in (("mha", 0), ("mlp", None), ("residual", None)):
            rows.append((family, 5, head, i, (rng.normal(size=2) + shift).tolist()))
    acts = spark.createDataFrame(rows, "family string, layer int, head int, example_id long, vector array<double>")
    labels = spark.createDataFrame([(i, "t", i % 2) for i in range(120)], "example_id long, text string, label int")
    path = tmp_path / "paper_results.json"
    path.write_text(json.dumps({"m": {"mha_best_accuracy": 1.0, "mlp_best_accuracy": 0.5}}))
    cfg = probes.ProbeConfig(lr=0.05, steps=30)
    out = probe_benchmark(acts, labels, "m", [str(path)], cfg)
    verdicts = {r.metric: r.verdict for r in out["comparison"].collect()}
    assert verdicts["mha_best_accuracy"] == "VERIFIED"
    assert verdicts["mlp_best_accuracy"].startswith("+0.")
    assert verdicts["residual_best_accuracy"] == "NO PAPER REF"
    assert [r.best_layer for r in out["best"].collect()] == [5, 5, 5]
    with pytest.raises(ValueError):
        probe_benchmark(acts.filter("family = 'mha'"), labels, "m", [str(path)], cfg)
    with pytest.raises(ValueError):
        probe_benchmark(acts, labels.withColumn("label", F.lit(1)), "m", [str(path)], cfg)
