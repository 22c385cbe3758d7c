import re

import numpy as np
import pytest
import xxhash

from spanlake.llm import simhash


def fingerprint(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall("[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Component per row: smallest id over links of the fingerprints."""
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(rows[i][0], f"{prints[i]:016x}", least.get(find(i))) for i in range(len(rows))]


CASES = [
    (7, "The quick brown fox jumps over the lazy dog"),
    (7, "The quick brown fox jumps over the lazy dog"),
    (3, "the QUICK brown fox\tjumps over the lazy dog"),
    (1, None),
    (2, ""),
    (None, " \n\t"),
    (9, "one"),
    (10, "one two"),
    (11, "x" * 3000 + " y"),
    (12, "Été  nbsp \u0085 word"),
    (None, "alone without an id"),
    (None, "another without an id at all"),
    (13, "word " * 40000),
]


@pytest.mark.parametrize("rows", [CASES, []], ids=["cases", "empty"])
def test_components_of_edge_cases(spark, rows):
    docs = spark.createDataFrame([(d, t, "c", 1) for d, t in rows], "doc_id long, text string, component_id string, fingerprint int")
    found = simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    key = lambda r: (str(r[0]), r[1])
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(brute_components(rows), key=key)
    assert simhash.near_duplicates(docs).count() == len(rows)


def test_components_of_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(docs.select("doc_id", "text")).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    assert sorted(tuple(r) for r in found.collect()) == sorted(brute_components(rows))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_components(rows)})


def test_keep_one_of_edge_cases(spark):
    docs = spark.createDataFrame([(d, t, "x") for d, t in CASES], "doc_id long, text string, __n string")
    docs = docs.withColumnRenamed("__n", "extra")
    kept = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert sorted(str(k) for k in kept) == sorted(
        str(k) for k in [CASES[2], CASES[3], *CASES[6:10], *CASES[10:]]
    )


def test_masks_cover_every_triple():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    bits = [[m >> i & 1 for i in range(64)] for m in masks]
    bits = np.array(bits, bool)
    for i in range(64):
        for j in range(i, 64):
            hit = bits[:, i] | bits[:, j]
            assert (~(hit[:, None] | bits)).any(axis=0).all()


def test_dense_and_split_buckets(spark):
    rng = np.random.default_rng(5)
    near = {int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in rng.integers(1, 1 << 62, 3) for i, j in rng.integers(0, 60, (150, 2))}
    values = sorted(near)
    frame = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "fingerprint long, doc_id long")
    for piece in (16, 4096):
        edges = simhash.links(frame.select("fingerprint"), "fingerprint", piece=piece).collect()
        root = {v: v for v in values}

        def find(v):
            while root[v] != v:
                v = root[v]
            return v

        for a, b in edges:
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        linked = {v: v for v in values}
        for i, a in enumerate(values):
            for b in values[:i]:
                if (a ^ b).bit_count() <= 3:
                    assert find(a) == find(b)
        assert len({find(v) for v in values}) == len({find(v) for v in linked})
