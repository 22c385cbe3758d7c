import math

import numpy as np
import pytest

from spanlake.llm import vafile


def brute(rows, every, k):
    fine = [(i, d, [math.floor(256 * float(np.float32(x))) for x in v]) for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, d, q in fine:
        if d % every == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), e) for j, e, v in fine if j != i and len(v) == len(q))[:k]
            out += [(d, r, e, -s) for r, (s, e) in enumerate(best, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(d, v, "x", 0) for d, v in rows], "vec_id long, embedding array<float>, id string, row int")


NAN, INF = float("nan"), float("inf")
CASES = [
    (0, [0.1, 0.2]), (1, [0.1, 0.2]), (2, [0.1, 0.2]), (3, [-0.5, 0.3]), (50, [NAN, 1.0]), (51, [1.0, None]), (52, None), (53, []),
    (None, [9.0, 9.0]), (54, [INF, 0.0]), (100, [0.0, 0.0]), (100, [0.0, 0.0]), (55, [1.0, 2.0, 3.0]), (150, [1.0, 2.0, 4.0]), (56, [30000.0, -70000.0]),
]


@pytest.mark.parametrize("rows", [CASES, [], CASES[:1], CASES[4:10]], ids=["cases", "empty", "one", "none fit"])
def test_edge_cases(spark, rows):
    found = vafile.nearest(frame(spark, rows), 50, 5)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 50, 5)


def test_parts_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in base[i % 40 if i % 3 else 0]]) for i in range(900)]
    want = brute(rows, 50, 5)
    monkeypatch.setattr(vafile, "QUERY_BYTES", 600)
    monkeypatch.setattr(vafile, "BLOCK_ROWS", 64)
    assert sorted(tuple(r) for r in vafile.nearest(frame(spark, rows).repartition(5), 50, 5).collect()) == want


def test_most_vectors_are_never_read():
    rng = np.random.default_rng(2)
    exact = np.floor(256 * rng.normal(size=(4096, 64)) / 8).astype(np.int64)
    low = exact.min(0)
    width = -(-(exact.max(0) - low + 1) // vafile.CELLS)
    ids = np.arange(4096)
    block = {"row": ids, "id": ids, "exact": exact, "low": low, "width": width, "cell": ((exact - low) // width).astype(np.uint8)}
    lower, upper = vafile._bounds(exact[:20], block)
    true = exact[:20] @ exact.T
    assert (lower <= true).all() and (true <= upper).all()
    running = vafile.Running(20, 5)
    running.visit(np.arange(20), ids[:20], exact[:20], block)
    assert running.read < 0.2 * 20 * 4096
    true[np.arange(20), np.arange(20)] = -(1 << 40)
    assert all(sorted(running.score[q]) == sorted(np.sort(true[q])[-5:]) for q in range(20))


def test_large_components_raise(spark):
    with pytest.raises(Exception, match="too large"):
        vafile.build(frame(spark, [(0, [1e30, 0.0])])).collect()
