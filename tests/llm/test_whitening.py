"""Whitening against NumPy's eigendecomposition, and the rank-one updates by themselves."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from spanlake.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, component string, n int, x string"


def brute(rows, most=4):
    """{(id, component): [...]} with n, deviation, |whitened|, explained."""
    kept = []
    for i, v in rows:
        if v and all(c is not None and math.isfinite(c) for c in v):
            kept.append((i, [math.floor(256 * float(np.float32(c))) for c in v]))
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[x[j] - s[j] / n for j in range(d)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = defaultdict(list)
    for i, x in kept:
        dev = sum((n * x[j] - s[j]) ** 2 for j in range(d))
        for k in range(min(most, d)):
            if values[k] > 1e-12 * values.sum():
                w = (np.array(x) - np.array(s) / n) @ vectors[:, k] / math.sqrt(values[k])
                out[(i, k + 1)].append((n, dev, abs(w), values[k] / values.sum()))
    return {k: sorted(v) for k, v in out.items()}


def check(spark, rows, most=4, **more):
    df = spark.createDataFrame([(*r, "x", 1, "x") for r in rows], SCHEMA).repartition(4)
    got = whitening.whiten(df, most=most, **more)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    found = defaultdict(list)
    errors = set()
    for r in got.collect():
        found[(r.vec_id, r.component)].append((r.n, r.deviation, abs(r.whitened), r.explained))
        errors.add(r.identity_error)
    want = brute(rows, most)
    assert found.keys() == want.keys()
    assert len(errors) <= 1 and all(e < 1e-8 for e in errors)
    for key, rows_of in want.items():
        assert len(found[key]) == len(rows_of)
        for a, b in zip(sorted(found[key]), rows_of):
            assert a[:2] == b[:2]
            assert a[2] == pytest.approx(b[2], rel=1e-8, abs=1e-8) and a[3] == pytest.approx(b[3], rel=1e-10)
    return want


def made_up(n, d, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * np.geomspace(3, 0.1, d) + rng.normal(0, 2, d)
    return [(i, v) for i, v in enumerate(x.astype(np.float32).tolist())]


def test_vectors_with_copies_and_odd_rows(spark):
    rows = made_up(300, 12)
    rows += [(1000 + i, rows[5][1]) for i in range(150)] + [rows[7], rows[7], (None, rows[8][1])]
    rows += [(2000, None), (2001, [None] * 12), (2002, [float("nan")] * 12), (2003, [float("inf")] + [0.0] * 11), (2004, [])]
    assert check(spark, rows)


def test_given_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert check(spark, rows)


@pytest.mark.parametrize(
    "rows",
    [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [1.0, 2.0, 3.0]), (2, [2.0, 2.0, 3.0])], [(i, [float(i), 2.0 * i]) for i in range(9)], [(i, [float(i)]) for i in range(5)]],
    ids=["one", "copies", "line", "line of nine", "one dimension"],
)
def test_few_directions(spark, rows):
    check(spark, rows)


def test_equal_eigenvalues(spark):
    # a cross-polytope: all eigenvalues are equal, so only what does not depend on the choice of vectors is compared
    rows = [(2 * i + s, [float((1 - 2 * s) * (i == j)) for j in range(6)]) for i in range(6) for s in (0, 1)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.component for r in got} == {1, 2, 3, 4} and len(got) == 48
    assert all(r.explained == pytest.approx(1 / 6, rel=1e-12) and r.identity_error < 1e-12 for r in got)


def test_other_lengths_and_empty(spark):
    odd = [(90, [1.0]), (91, [2.0]), (92, [1.0] * 13)]
    rows = made_up(50, 12)
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    assert {r.vec_id for r in whitening.whiten(df).collect()} == set(range(50))
    none = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(none).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<double>")).collect() == []


def test_large_entries(spark):
    rows = [(i, [1e12 * (i + 1), 5.0 * i * i, -1e11 * i]) for i in range(4)] + [(9, [1e300, 1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id for r in got} == set(range(4)) and all(r.deviation is None for r in got)


def test_narrow_spectra_are_refined(spark):
    check(spark, made_up(200, 40, 3), rank=10)


@pytest.mark.parametrize("seed", range(4))
def test_rank_one_updates(seed):
    rng = np.random.default_rng(seed)
    d = 30
    own = whitening.Spectrum(d, d)
    x = rng.normal(0, 1, (400, d)) * np.geomspace(1e3, 1e-3, d)
    if seed % 2:
        x = np.round(x)  # many zeros and equal values
    for row in x:
        own.add(row)
    want = np.linalg.eigvalsh(x.T @ x)
    assert np.allclose(np.sort(own.values), want[-len(own.values):], rtol=1e-10, atol=1e-10 * want[-1])
    assert np.abs(own.basis.T @ own.basis - np.eye(own.basis.shape[1])).max() < 1e-10
    rebuilt = (own.basis * own.values) @ own.basis.T
    assert np.abs(rebuilt - x.T @ x).max() < 1e-9 * want[-1]


def test_secular_roots_lie_between_the_poles():
    rnd = random.Random(4)
    for m in (1, 2, 3, 20):
        d = np.cumsum([rnd.choice([1e-9, 1e-3, 1.0, 50.0]) for _ in range(m)])
        z = np.array([rnd.choice([1e-6, 0.1, 3.0]) for _ in range(m)])
        roots, off = whitening.secular_roots(d, z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(roots, want, rtol=1e-12)
        assert (off[np.arange(m), np.arange(m)] < 0).all() and (off[np.arange(m - 1), np.arange(1, m)] > 0).all()
