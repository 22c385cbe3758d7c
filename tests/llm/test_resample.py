"""Resampling against a plain version, and the radix sort against Python's."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from spanlake.llm import radix, resample
from spanlake.llm.resample import Draw

SCHEMA = "doc_id long, text string, score string, rank int, position int, bucket string"


def features(text, draw):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    runs = [" ".join(words[i : i + k]) for k in range(1, draw.most_words + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % draw.buckets for r in runs]


def brute(docs, target, draw):
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(features(x, draw)[1])
    for x in target:
        t.update(features(x, draw)[1])
    big_s, big_t, k = sum(s.values()), sum(t.values()), draw.buckets
    rows = []
    for i, x in docs:
        n, found = features(x, draw)
        w = sum(math.floor(draw.scale * math.log(((t[b] + 1) * (big_s + k)) / ((s[b] + 1) * (big_t + k)))) for b in found)
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = w + math.floor(-draw.scale * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((i, n, len(found), w, score))
    able = sorted((r for r in rows if r[1] >= draw.fewest_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    rank = {}
    for at, r in enumerate(able[: len(able) * draw.percent // 100]):
        rank.setdefault(r, []).append(at + 1)
    out = []
    for r in rows:
        out.append((*r, rank[r].pop(0) if rank.get(r) else None))
    return Counter(out)


def made_up(n=400):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Ä", "über", "日本", "x" * 70, "y" * 200]
    docs = [(i * 7 - 900, " ".join(rnd.choices(words, k=rnd.choice([3, 19, 20, 25, 60])))) for i in range(n)]
    # copies (one group holds a third of all), repeated ids, odd rows
    docs += [(10_000 + i, docs[0][1] + " " + docs[1][1]) for i in range(n // 2)]
    docs += [docs[3], docs[3], (None, docs[4][1] * 3), (None, docs[4][1] * 3), (5, None), (6, ""), (7, "!?"), (2**62, "LONG word " * 30_000), (-(2**63), "a b " * 20)]
    return docs, [d[1] for d in docs[:30]] + [None, "", "zz zz"]


@pytest.mark.parametrize("draw", [Draw(), Draw(2, 64, 100, 3, 20, 50), Draw(3, 1000, 1000, 1, 0, 100)], ids=["contract", "pairs", "all"])
def test_resample(spark, draw):
    docs, target = made_up()
    df = spark.createDataFrame([(*d, "x", 1, 1, "x") for d in docs], SCHEMA).repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, bucket int")
    got = resample.resample(df, goal, draw)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in got.collect()) == brute(docs, target, draw)


def test_empty_tables_and_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert resample.resample(none, some).collect() == []
    (row,) = resample.resample(some, none).collect()  # a tenth of one row is none
    assert (row.n_words, row.rank) == (30, None)
    assert [r.rank for r in resample.resample(some, none, Draw(percent=100)).collect()] == [1]


def test_crc_of_ranges():
    rnd = random.Random(1)
    parts = [bytes(rnd.choices(range(256), k=k)) for k in [0, 1, 2, 63, 64, 65, 300, 5, 5, 0]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    start = end - [len(p) for p in parts]
    state = resample.crc_feed(np.full(len(parts), 0xFFFFFFFF, np.uint32), data, start, end)
    assert [int(s) ^ 0xFFFFFFFF for s in state] == [zlib.crc32(p) for p in parts]


def test_counts_do_not_depend_on_blocks(spark, monkeypatch):
    docs, _ = made_up(60)
    block = resample.Block(pa.array([t for _, t in docs], pa.string()))
    (bucket, bounds), *_ = resample.features_of(block, Draw())
    assert [bucket[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [features(t, Draw())[1] for _, t in docs]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_positions(spark, monkeypatch, n):
    monkeypatch.setattr(radix, "DIGIT", 4)
    monkeypatch.setattr(radix, "PART_BITS", (5, 6))
    rnd = random.Random(2)
    # most rows share their leading digits
    rows = [(i, rnd.choice([7, 7, 7, rnd.randrange(2**13)]), rnd.randrange(2**20)) for i in range(n)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "id long, a long, b long").repartition(7)
    got = radix.with_position(df, [(F.col("id"), 13), (F.col("b"), 20), (F.col("a"), 13)], n)
    want = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    assert sorted((r.position, r.id) for r in got.collect()) == [(i, r[0]) for i, r in enumerate(want)]
    if n:
        values = sorted((r[2] for r in rows), reverse=True)
        assert [radix.nth_largest(df, F.col("b"), 20, k) for k in (1, n // 3 + 1, n)] == [values[0], values[n // 3], values[-1]]


def test_rows_are_shuffled_by_part(spark):
    from pyspark.sql import functions as F

    df = spark.range(10).withColumn("position", F.col("id"))
    plan = radix._counting_pass(df, F.col("id"), 8, "position")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__part" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
