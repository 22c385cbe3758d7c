"""The pipeline against plain-Python versions of its stages."""

from collections import Counter

import pytest

import corpus_pipeline
from spanlake.llm import quality, sharding
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_mixing import brute as mixed
from tests.llm.test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


def plain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    model = quality.fit_on(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = docs.collect()
    texts = [r.text for r in rows]
    import pyarrow as pa

    scores = model.score(quality.statistics_of(quality.Block(pa.array(texts, pa.string())))) if rows else []
    rows = [r for r, s in zip(rows, scores) if s >= 0.3]
    kept = set(brute_kept([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in kept]
    clean = {d for d, _, hit, _ in contaminated([(r.doc_id, r.text) for r in rows], bench) if not hit}
    rows = [r for r in rows if r.doc_id in clean]
    _, draws = mixed([(r.doc_id, r.source, r.text) for r in rows], corpus_pipeline.MIX)
    table = sharding.lookup_table(corpus_pipeline.SHARDS)
    out = Counter()
    for r in rows:
        slot = sharding._number(str(r.doc_id)) % len(table)
        out[(*r, slot, corpus_pipeline.SHARDS[table[slot]])] = draws[(r.doc_id, r.source, r.text)]
    return +out


def test_run_matches_the_plain_version(spark):
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, SF).collect()) == plain(spark, SF)


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.columns == [*docs.columns, *(["slot", "shard"] if name == "sharding" else [])]
        counts.append(made.count())
    assert counts[1] < counts[0] and counts[2] < counts[0] and counts[3] < counts[0] and counts[5] == counts[0]


@pytest.mark.parametrize("rows", [[(1, None, None, None, 0), (1, None, None, None, 0), (None, "a b c d", "en", "s", 7), (2, "", "en", None, 0), (3, "w " * 50000, None, "s", 100000)], []], ids=["odd", "empty"])
def test_stages_of_odd_rows(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(*r, "x") for r in rows], schema + ", score string").write.parquet(f"{folder}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").where("false").write.parquet(f"{folder}/{name}.parquet")
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "slot", "shard"]
    # no label: nothing is rejected; the texts without words and the repeated row are one group
    assert {r.doc_id for r in found.collect()} <= {r[0] for r in rows}
    assert found.count() == (3 if rows else 0)
