"""Near copies against the exact Jaccard similarity of all pairs."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import near_copies, simhash


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else {""}


def brute_kept(rows):
    """The smallest id of each component over pairs with a Jaccard similarity of 0.8 or more."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rnd, words, n):
    out = list(words)
    for at in rnd.sample(range(len(out)), n):
        out[at] = f"new{rnd.randint(0, 10**9)}"
    return " ".join(out)


def made_up():
    rnd = random.Random(3)
    rows = []
    for group in range(40):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([80, 300, 1200]))]
        rows += [" ".join(words), *(edited(rnd, words, len(words) * k // 200) for k in (1, 2, 4, 6, 9))]
    rows += ["", None, " \n", "one", "ONE", "one two", "a b c d e f", "A b c\td e f", "word " * 9000]
    rnd.shuffle(rows)
    return list(enumerate(rows))


def test_pairs_from_0_8_on_leave_one(spark):
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == brute_kept(rows)


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()) == brute_kept(rows)


def test_large_buckets_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "PIECE", 4)
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == brute_kept(rows)


def test_simhash_groups_are_compared_without_any_band(spark, monkeypatch):
    """Without any band, only the groups of ``simhash.near_duplicates`` are candidates."""
    made = near_copies._sketches
    monkeypatch.setattr(near_copies, "_sketches", lambda narrow: made(narrow).withColumn("bands", F.array().cast("array<long>")))
    rnd = random.Random(8)
    rows = []
    for _ in range(20):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(3000)]
        rows += [" ".join(words), edited(rnd, words, 1), edited(rnd, words, 1500)]
    # the same fingerprint by one shingle that repeats, but other words: no near copies
    rows += [f"{'word ' * 400}{' '.join(f'{end}{i}' for i in range(40))}" for end in "xy"]
    rows = list(enumerate([*rows, None, "", "one"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, shingle=near_copies.SHINGLE).collect()}
    near = [i for i in range(1, 60, 3) if groups[i] == i - 1]
    kept = {r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()}
    assert len(near) > 10 and groups[61] == 60 and kept == {i for i, _ in rows} - {*near, 63}
