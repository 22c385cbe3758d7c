import re

import numpy as np
import pytest

from spanlake.llm import lines


def norm(s):
    return re.sub("[ \t-\r]+", " ", s.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


def brute(rows, key_of):
    """(id, n_lines, n_kept, text) per row."""
    places = []
    for d, t in {(d, t or "") for d, t in rows}:
        places += [((d is None, d or 0, key_of[t], i), norm(s)) for i, s in enumerate(t.split("\n")) if norm(s)]
    distinct = sorted({s for _, s in places})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    sets = {s: {s[i : i + 7] for i in range(max(1, len(s) - 6))} for s in distinct}
    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])):
                both = len(sets[a] & sets[b])
                if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    first = {}
    for p, s in sorted(places):
        first.setdefault(find(s), p)
    out = []
    for d, t in rows:
        if t is None:
            out.append((d, 0, 0, None))
            continue
        all_lines = t.split("\n")
        kept = [s for i, s in enumerate(all_lines) if not norm(s) or first[find(norm(s))] == (d is None, d or 0, key_of[t], i)]
        out.append((d, len(all_lines), len(kept), "\n".join(kept)))
    return out


def run(spark, rows):
    more = ["key", "dropped", "id", "pos", "root", "h", "line", "bucket", "first", "node"]
    docs = spark.createDataFrame([(d, t, 1, *more) for d, t in rows], "doc_id long, text string, n_lines int, " + ", ".join(f"{c} string" for c in more))
    out = lines.dedup(docs)
    assert out.columns == ["doc_id", "text", *more, "n_lines", "n_kept"]
    keys = {r.t: r.k for r in docs.selectExpr("coalesce(text, '') AS t", "xxhash64(coalesce(text, '')) AS k").collect()}
    found = [(r.doc_id, r.n_lines, r.n_kept, r.text) for r in out.collect()]
    return sorted(found, key=str), sorted(brute(rows, keys), key=str)


LONG = "the quick brown fox jumps over the lazy dog and then some more words follow here to make it long"
CASES = [
    (5, f"Title\n{LONG}\n\nshort\nshort\n  SHORT "),
    (3, f"{LONG}!\nother line of its own, not like any\n{LONG.replace('lazy', 'hazy')}"),
    (3, f"{LONG}!\nother line of its own, not like any\n{LONG.replace('lazy', 'hazy')}"),
    (4, f"{LONG.upper()}\t \r\nOther  line of its own, not like any"),
    (None, f"{LONG}\nonly here without an id"),
    (6, None),
    (7, ""),
    (8, "\n\n"),
    (9, "x" * 50000 + "\n" + "x" * 50001),
    (10, "ééé ß 日本 🎉🎉🎉🎉🎉🎉🎉🎉 line\nééé ß 日本 🎉🎉🎉🎉🎉🎉🎉🎉 line"),
    (11, "\n".join(["same"] * 3000)),
]


@pytest.mark.parametrize("rows", [CASES, [], CASES[5:8]], ids=["cases", "empty", "no lines"])
def test_edge_cases(spark, rows):
    found, want = run(spark, rows)
    assert found == want


def test_given_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found, want = run(spark, rows)
    assert sum(a != b for a, b in zip(found, want)) <= 0.005 * len(rows)
    assert sum(r[2] for r in found) <= 1.001 * sum(r[2] for r in want)


def test_both_forms_of_the_search_agree(monkeypatch):
    rng = np.random.default_rng(3)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 120))
    made = []
    for i in range(80):
        own = list(base if i % 4 else base[::-1])
        for at in rng.integers(0, 120, i % 5):
            own[at] = "#"
        made.append("".join(own) + str(i % 7))
    made.append("short")

    def groups(edges):
        root = list(range(len(made)))
        for a, b in edges:
            ra, rb = root[a], root[b]
            root = [rb if r == ra else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == k) for k in set(root)}

    many = lines.forest(made)
    monkeypatch.setattr(lines, "FEW", 1000)
    few = lines.forest(made)
    assert groups(many) == groups(few) and len(many) == len(few) == len(made) - len(groups(few))


def test_recall_and_pieces(spark):
    rng = np.random.default_rng(9)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for g in range(40):
        base = [words[i] for i in rng.integers(0, 400, 40)]
        for v in range(12):
            own = list(base)
            own[v * 3 % 40] = words[int(rng.integers(400))]
            rows.append((g * 100 + v, " ".join(own)))
    found, want = run(spark, rows)
    assert sum(a == b for a, b in zip(found, want)) >= 0.99 * len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few = lines.links(docs, piece=3)
    whole = lines.links(docs)
    groups = lambda df: {frozenset(r) for r in lines.components(df, "a", "b").groupBy("root").agg(lines.F.collect_set("node").alias("m")).rdd.map(lambda r: tuple(sorted([*r.m, r.root]))).collect()}
    assert groups(few) == groups(whole)
