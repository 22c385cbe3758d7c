import re

import pytest

from spanlake.llm import decontaminate as D


def words(text):
    lowered = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items, window=10):
    windows = set()
    for item, text in items:
        w = words(text)
        for s in range(max(len(w) - window, 0) + 1) if w else ():
            windows.add((item, tuple(w[s : s + window])))
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, phrase in windows:
            for s in range(len(w) - len(phrase) + 1):
                if tuple(w[s : s + len(phrase)]) == phrase:
                    hit.update(range(s, s + len(phrase)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found - {None})))
    return out


ALPHA = " ".join(f"w{i}" for i in range(30))
ITEMS = [("a", ALPHA), ("b", "Short item"), ("c", None), ("d", ""), ("e", "w3 W4 w5 w6 w7 w8 w9 w10 w11 w12"), (None, "nameless words here"), ("a", "short ITEM")]
DOCS = [
    (1, None),
    (2, ""),
    (3, "x " + ALPHA.upper() + "; y"),
    (4, "w0 w1 w2 w3 w4 w5 w6 w7 w8"),
    (5, "w3-w4_w5 w6 w7 w8 w9 w10 w11 w12 tail"),
    (5, "w3-w4_w5 w6 w7 w8 w9 w10 w11 w12 tail"),
    (6, "short"),
    (7, "item short item short"),
    (None, "nameless words here"),
    (8, "short item " * 5000),
    (9, "z" * 200000 + " ééé 日本"),
]


@pytest.mark.parametrize("docs,items", [(DOCS, ITEMS), ([], ITEMS), (DOCS, [])], ids=["cases", "no docs", "no items"])
def test_search_of_edge_cases(spark, docs, items):
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, n_hit int, items string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    found = D.search(D.build_index(frame), bench).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.id, r.n_words, r.n_hit, sorted(r.items)) for r in found), key=key) == sorted(brute(docs, items), key=key)
    clean = D.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    want = [d for (d, _), (_, _, hit, _) in zip(docs, brute(docs, items)) if not hit]
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(map(str, want))


def test_passes_give_the_same(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    one = {(r.id, r.n_hit, tuple(sorted(r.items))) for r in D.search(D.build_index(docs), bench).collect()}
    monkeypatch.setattr(D, "PASS_BYTES", 3000)
    many = {(r.id, r.n_hit, tuple(sorted(r.items))) for r in D.search(D.build_index(docs), bench).collect()}
    assert one == many and any(n for _, n, _ in one)


def test_words_near_each_other(spark):
    docs = spark.createDataFrame([(1, "b x a y c"), (2, "a x y z b c"), (3, "c b a"), (4, "a b"), (5, "c a b z z")], "doc_id long, text string")
    bench = spark.createDataFrame([("i", "a b c")], "item_id string, text string")
    found = {r.id: r.n_hit for r in D.search(D.build_index(docs), bench, width=5).collect()}
    assert found == {1: 5, 2: 0, 3: 3, 4: 0, 5: 5}
