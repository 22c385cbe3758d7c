"""Language-model scores: counts against plain Python, the network against plain loops and numeric slopes, and held-out texts."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanlake.llm import gru, lm

SCHEMA = "doc_id long, text string, h long, c int, symbols string"


def tokens(text):
    return [*re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})), None]


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    c = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        own = tokens(t)
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        out.append((i, held_out(i), len(own), sum(c[w] > 0 for w in own), n, round(base, 6)))
    return Counter(out)


def found(df):
    rows = df.collect()
    assert all(r.score <= 1e-9 and math.isfinite(r.score) for r in rows)
    return Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows)


def made_up():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(400)] + ["Ä", "ä", "日本語", "x", "LONG" * 300, "!?"]
    rows = [(i, " ".join(rnd.choices(words, k=rnd.choice([0, 1, 30, 200])))) for i in range(150)]
    rows += [(1000 + i, rows[4][1]) for i in range(80)] + [rows[7], rows[7], (None, "w1 w2"), (3, None), (4, ""), (5, " \n")]
    rows += [(7777, "word " * 30_000), (11, "\x0bTab\tNew\nline")]
    rows += [(i, f"unseen{i} w1") for i in range(5000, 5040)]
    return rows


@pytest.mark.parametrize("sizes", [(lm.WORDS, lm.TAILS, lm.KNOWN), (20, 3, 30), (64, 1, 64)], ids=str)
def test_counts_and_base(spark, sizes):
    rows = made_up()
    df = spark.createDataFrame([(*r, 1, 1, "x") for r in rows], SCHEMA).repartition(5)
    got = lm.score(df, words=sizes[0], tails=sizes[1], known=sizes[2])
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert found(got) == brute(rows)


def test_no_rows_and_no_training_text(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    only = [(i, "a b") for i in range(200) if held_out(i)]
    rows = lm.score(spark.createDataFrame(only, "doc_id long, text string")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows} == {(3, 0, 0, 0.0, 0.0)}


def test_scores_are_those_of_the_learnt_model(spark):
    """The whole query against word-by-word products with the same model."""
    rows = made_up()[:150]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.score for r in lm.score(df, words=40, tails=4, known=60).collect()}
    counts = lm.word_counts(df.where(~lm.is_held_out()))
    vocab = lm.vocabulary(counts, 40, 4, 60)
    keyed = lm.with_symbols(df.selectExpr("*", "monotonically_increasing_id() AS __row").selectExpr("*", "int(pmod(xxhash64(__row), 4)) AS __part"), vocab)
    model = lm.learn(keyed.where(~lm.is_held_out()), vocab)
    c = Counter(w for i, t in rows if not held_out(i) for w in tokens(t))
    # the vocabulary by hand: the 39 most frequent words (ties by hash, so counts tell) and the end
    symbols = {r.doc_id: np.frombuffer(r.symbols, "<u2") for r in keyed.collect()}
    for i, t in rows:
        own, h, log = tokens(t), np.zeros((1, gru.WIDTH), np.float32), 0.0
        before = model.shape.start
        for w, s in zip(own, symbols[i].tolist()):
            h = model.step(model.p["table"][[before]], h)[0]
            log += everything(model, h)[s]
            if s >= model.shape.words:
                k = s - model.shape.words
                log += math.log((c[w] + 0.1) / (vocab.tail_tokens[k] + 0.1 * (vocab.tail_words[k] + 1)))
            before = s
        assert got[i] == pytest.approx(log / math.log(10), rel=1e-4, abs=1e-3)
    for k in range(4):  # the shares of a tail class and of its unknown word add up
        inside = {w for i, t in rows for w, s in zip(tokens(t), symbols[i].tolist()) if s == model.shape.words + k}
        assert vocab.tail_tokens[k] == sum(c[w] for w in inside) and vocab.tail_words[k] == sum(c[w] > 0 for w in inside)


def everything(model, h):
    """Log-probability of every symbol."""
    return model.log_probability(np.repeat(h, model.shape.start, axis=0), np.arange(model.shape.start))


def small_model(seed=3):
    shape = gru.Shape(100, 3)
    rng = np.random.default_rng(seed)
    model = gru.Model.start(shape, rng.integers(1, 50, 103).astype(float))
    for name in ("class_w", "word_w"):
        model.p[name][:] = rng.normal(0, 0.3, model.p[name].shape)
    return model, rng


def test_probabilities_add_up():
    model, rng = small_model()
    h = rng.normal(0, 0.5, (1, gru.WIDTH)).astype(np.float32)
    assert np.exp(everything(model, h)).sum() == pytest.approx(1, abs=1e-4)


def test_start_is_the_share_of_each_symbol():
    counts = np.arange(1, 104).astype(float)
    model = gru.Model.start(gru.Shape(100, 3), counts)
    p = np.exp(everything(model, np.zeros((1, gru.WIDTH), np.float32)))
    assert np.allclose(p, (counts + 1) / (counts + 1).sum(), rtol=1e-3)


def test_slopes_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(gru, "CLIP", 1e9)
    model, rng = small_model()
    flat = model.flat.copy()
    inputs, targets = rng.integers(0, 104, (5, 4)), rng.integers(0, 103, (5, 4))
    fresh, counted = rng.random((5, 4)) < 0.2, rng.random((5, 4)) < 0.9
    h0 = rng.normal(0, 0.3, (4, gru.WIDTH)).astype(np.float32)

    def loss(m):
        h, total = h0, 0.0
        for t in range(5):
            h = m.step(m.p["table"][inputs[t]], h * (~fresh[t])[:, None].astype(np.float32))[0]
            total -= (m.log_probability(h, targets[t]) * counted[t]).sum()
        return total / counted.sum()

    grads = {}
    monkeypatch.setattr(gru.Model, "_move", staticmethod(lambda p, g2, at, g: grads.update({id(p): (at, g)})))
    model.learn(inputs, targets, fresh, counted, h0)
    for name in gru.NAMES:
        at, g = grads[id(model.p[name])]
        full = np.zeros(model.p[name].shape)
        full[at] = g
        for place in np.argsort(-np.abs(full).ravel())[:4]:
            sides = []
            for by in (1e-2, -1e-2):
                other = gru.Model(model.shape, flat.copy())
                other.p[name].ravel()[place] += by
                sides.append(loss(other))
            assert (sides[0] - sides[1]) / 2e-2 == pytest.approx(full.ravel()[place], rel=0.05, abs=2e-4)


def test_words_of_all_classes_are_rated_in_one_array(monkeypatch):
    """One softmax over the classes and one over the words of a window; what is added up in blocks is what single rows give."""
    model, rng = small_model()
    calls, softmax = [], gru._softmax
    monkeypatch.setattr(gru, "_softmax", lambda logits: calls.append(logits.shape) or softmax(logits))
    inputs, targets = rng.integers(0, 104, (5, 8)), np.arange(40).reshape(5, 8) * 2
    model.learn(inputs, targets, rng.random((5, 8)) < 0.2, np.ones((5, 8), bool), np.zeros((8, gru.WIDTH), np.float32))
    assert calls == [(40, model.shape.classes), (40, gru.CLASS)]
    monkeypatch.setattr(gru, "ROWS", 7)
    states, symbols = rng.normal(0, 0.5, (60, gru.WIDTH)).astype(np.float32), rng.integers(0, 103, 60)
    single = [model.log_probability(states[i : i + 1], symbols[i : i + 1])[0] for i in range(60)]
    assert model.log_probability(states, symbols) == pytest.approx(single, rel=1e-5)


def test_states_go_on_over_windows():
    """A text's score is that of one long recurrence, in whatever company it is scored."""
    model, rng = small_model()
    texts = [rng.integers(0, 103, n).astype("<u2") for n in (1, 700, 3, 0, 64, 65, 128)]
    together = model.score(texts)
    for t, got in zip(texts, together):
        h, want, before = np.zeros((1, gru.WIDTH), np.float32), 0.0, model.shape.start
        for s in t.tolist():
            h = model.step(model.p["table"][[before]], h)[0]
            want += model.log_probability(h, np.array([s]))[0]
            before = s
        assert got == pytest.approx(want, rel=1e-5, abs=1e-4)


def test_held_out_texts_are_likelier_than_by_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score(docs).collect() if r.held_out]
    n = sum(r.n_tokens for r in rows)
    assert len(rows) > 50 and sum(r.score for r in rows) / n > sum(r.base_score for r in rows) / n + 0.1
