import zlib

import numpy as np
import pytest

from spanlake.llm import quality
from spanlake.llm.queries import op7_quality


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op7_quality(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_fit_of_summed_equations_is_the_ridge_solution(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(r.tolist(), float(t), i % 2) for i, (r, t) in enumerate(zip(x, y))], "x array<double>, y double, fold int")
    model = quality.fit(rows.repartition(5))
    plain = quality.Model(x.mean(0), x.std(0))
    z = plain.fourier(x)
    penalty = np.diag(np.append(np.full(quality.FEATURES, quality.RIDGE * 400 + 1e-6), 1e-6))
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    assert (np.diff(model.values) >= 0).all()
    # a linear score would be right for half of them
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.85


def test_isotonic_is_the_best_monotone_curve():
    n = np.array([1.0, 2, 1, 4, 1])
    good = np.array([1.0, 0, 0, 3, 1])
    assert quality.isotonic(n, good).tolist() == [0.25, 0.25, 0.25, 0.75, 1.0]


CASES = [(1, None), (2, ""), (3, " \n"), (3, " \n"), (4, "a" * 200000), (5, "word " * 30000), (None, "Some text."), (6, "ÉÉ 12 !!\n")]


@pytest.mark.parametrize("rows", [CASES, []], ids=["cases", "empty"])
@pytest.mark.parametrize("marks", [[], [(5, 1), (5, None), (5, 0)], [(4, 1), (2, 1), (None, 1), (6, 0), (1, 0), (3, 0)]], ids=["none", "one", "some"])
def test_scores_of_edge_cases(spark, rows, marks):
    docs = spark.createDataFrame([(d, t, "x", 2) for d, t in rows], "doc_id long, text string, score string, y int")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    scored = quality.with_score(docs, quality.fit_on(docs, labels))
    found = scored.collect()
    assert scored.columns == ["doc_id", "text", "y", "score"] and len(found) == len(rows)
    assert all(0 <= r.score <= 1 for r in found)
    if not marks:
        assert all(r.score == 0.5 for r in found)
    assert len({(r.doc_id, r.text, r.score) for r in found}) == len({(r.doc_id, r.text) for r in found})
    empty = {r.score for r in found if not r.text}
    assert len(empty) <= 1


def test_statistics_do_not_depend_on_the_block():
    import pyarrow as pa

    texts = [t for _, t in CASES] + ["x y x y z z", "A!! B!!"]
    together = quality.statistics_of(quality.Block(pa.array(texts)))
    alone = np.concatenate([quality.statistics_of(quality.Block(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone)
