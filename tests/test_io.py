"""Sources, sinks, guards and streaming."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanlake.functions.text import hash_order
from spanlake.operators import infer, reports
from spanlake.plans.corpus import tables_of
from spanlake.schemas import GENERATION
from spanlake.sources import freeze, generations, papers, prompts, runs, tables
from spanlake.streaming.ingest import ingest_stream, read_ingested


def test_prompt_csv(spark, tmp_path):
    (tmp_path / "AITA-NTA-FLIP.csv").write_text(
        ',id,original_post,flipped_story\n0,x1,"first, with ""quotes""\nand a line",  flip \n1,x2,,second\n', encoding="utf-8"
    )
    (tmp_path / "OEQ.csv").write_text(",prompt\n5,only\n6,   \n", encoding="utf-8")
    (tmp_path / "SS.csv").write_text(",sentence\n0,left out\n", encoding="utf-8")
    with open(tmp_path / "OEQ.csv", "a", encoding="utf-8") as f:
        f.write("7,NA\n8,None\n")
    (tmp_path / "other file.csv").write_text(",a\n0,b\n", encoding="utf-8")
    known, unknown = prompts.list_prompt_sources(spark, str(tmp_path), excluded=["SS.csv"])
    assert [r.file_name for r in known.collect()] == ["AITA-NTA-FLIP.csv", "OEQ.csv"]
    assert [r.file_name for r in unknown.collect()] == ["other file.csv"]
    rows = prompts.read_prompts(spark, str(tmp_path), excluded=["SS.csv"]).collect()
    assert sorted(tuple(r) for r in rows) == [
        ("AITA-NTA-FLIP", "x1", "flipped_story", "flip"),
        ("AITA-NTA-FLIP", "x1", "original_post", 'first, with "quotes"\nand a line'),
        ("AITA-NTA-FLIP", "x2", "flipped_story", "second"),
        ("OEQ", "5", "prompt", "only"),
    ]
    (tmp_path / "AITA-YTA.csv").write_text(",prompt\n0,a,too many,cells\n", encoding="utf-8")
    with pytest.raises(Exception, match="MALFORMED_CSV_RECORD"):
        prompts.read_prompts(spark, str(tmp_path)).collect()


def test_sources_with_blanks_and_in_parts(spark, tmp_path):
    folder = str(tmp_path / "in put")
    rows = [(i, f"text {i}", f"{'a b+c' if i % 2 else 'd'}.csv") for i in range(20)]
    spark.createDataFrame(rows, "id long, prompt string, file string").repartition(3).write.partitionBy("file").csv(folder, header=True)
    (tmp_path / "in put" / "one file.csv").write_text("id,prompt\n77,single\n", encoding="utf-8")
    (tmp_path / "in put" / "deeper").mkdir()
    (tmp_path / "in put" / "deeper" / "x.csv").write_text("id,prompt\n1,not listed\n", encoding="utf-8")
    specs = {name: ("id", ("prompt",)) for name in ("a b+c.csv", "one file.csv")}
    known, unknown = prompts.list_prompt_sources(spark, folder, specs)
    assert [r.file_name for r in known.collect()] == ["a b+c.csv", "one file.csv"]
    assert [r.file_name for r in unknown.collect()] == ["d.csv"]
    read = sorted((r.dataset, int(r.row_id), r.text) for r in prompts.read_prompts(spark, folder, specs).collect())
    assert read == [("a b+c", i, f"text {i}") for i in range(1, 20, 2)] + [("one file", 77, "single")]


def generation(row_id, response, sample=0, prompt="Ask."):
    return {
        "dataset": "d",
        "row_id": row_id,
        "prompt_col": "text",
        "prompt": prompt,
        "sample_idx": sample,
        "response": response,
        "model": "m",
    }


def write_lines(path, records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records), encoding="utf-8")


def test_generations(spark, tmp_path):
    write_lines(tmp_path / "b.jsonl", [generation(1, "One."), generation("2", None)])
    with open(tmp_path / "a.jsonl", "w", encoding="utf-8") as f:
        f.write("\n" + json.dumps(generation(3, "Three.")) + "\n\n")
    (tmp_path / "notes.txt").write_text("not json")
    df = generations.read_generations(spark, str(tmp_path))
    assert sorted((r._place.file, r.row_id) for r in df.collect()) == [("a.jsonl", "3"), ("b.jsonl", "1"), ("b.jsonl", "2")]
    out = str(tmp_path / "out")
    generations.write_generations(df, out)
    again = generations.read_generation_sets(spark, out)
    assert sorted(map(str, again.collect())) == sorted(map(str, df.drop("_place").collect()))
    (tmp_path / "c.jsonl").write_text("{broken\n")
    with pytest.raises(PySparkException):
        generations.read_generations(spark, str(tmp_path)).collect()


def test_input_order(spark, tmp_path):
    from spanlake.operators import prompts as pr

    write_lines(tmp_path / "b.jsonl", [generation("1", f"Text {i}.") for i in range(50)])
    write_lines(tmp_path / "a.jsonl", [generation("1", "Earlier."), generation("0", "Only one.")])
    gens = pr.with_response_id(generations.read_generations(spark, str(tmp_path)))
    last = pr.attach_text(gens.select("response_id").distinct(), gens, ["_place"])
    assert sorted(r.response for r in last.collect()) == ["Only one.", "Text 49."]
    made = tables_of(gens)
    texts = [r.text for r in made.sentences.orderBy("global_idx").collect()]
    assert texts == ["Earlier.", "Only one.", *[f"Text {i}." for i in range(50)]]
    # without the place, rows with one id are still separate responses
    made = tables_of(gens.drop("_place"))
    assert made.responses.count() == 52 and made.sentences.select("global_idx").distinct().count() == 52


def test_tables_vectors_and_caches(spark, folder):
    gens = spark.createDataFrame([tuple(generation(str(i), "Yes. No.").values()) for i in range(4)], GENERATION)
    made = tables_of(gens)
    tables.write_tables(made.sentences, made.responses, folder)
    tables.write_skips(made.skips, folder)
    sentences, responses = tables.read_tables(spark, folder)
    assert (sentences.count(), responses.count(), tables.read_skips(spark, folder).count()) == (8, 4, 0)
    assert sorted(r.global_idx for r in sentences.collect()) == list(range(8))

    path = f"{folder}/vectors"
    vec = spark.createDataFrame([(18, 0, [1.0, 2.0]), (9, 0, [3.0, 4.0])], "layer int, global_idx long, vector array<float>")
    tables.write_vectors(vec, path)
    for _ in range(2):  # a repeated call adds nothing
        tables.write_vectors(vec.withColumn("global_idx", F.lit(1).cast("long")), path, 1)
    assert tables.read_vectors(spark, path).count() == 4
    one = tables.read_vectors(spark, path, 18)
    assert one.count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan
    with pytest.raises(PySparkException, match="shape mismatch"):
        tables.write_vectors(vec.withColumn("vector", F.array(F.lit(1.0))), path, 2)
    with pytest.raises(PySparkException, match="shape mismatch"):
        tables.write_vectors(vec.withColumn("vector", F.when(F.col("layer") == 9, F.array(F.lit(1.0))).otherwise(F.col("vector"))), path, 2)
    assert tables.read_vectors(spark, path).count() == 4

    acts = vec.select(F.lit("mlp").alias("family"), "layer", F.lit(None).cast("int").alias("head"), F.col("global_idx").alias("example_id"), "vector")
    labels = spark.createDataFrame([(0, 1)], "example_id long, label int")
    tables.write_probe_cache(acts, labels, f"{folder}/probe", {"model": "m", "n_examples": 1})
    a, b, meta = tables.read_probe_cache(spark, f"{folder}/probe")
    assert (a.count(), b.count(), meta) == (2, 1, {"model": "m", "n_examples": 1})


def test_run_documents(spark, tmp_path):
    for name, layer in (("L18_n2_k3_uncentered_s0", 18), ("L09_n2_k3_uncentered_s0", 9)):
        d = tmp_path / name
        d.mkdir()
        (d / "config.json").write_text(json.dumps({"layer": layer, "n_latents": 2, "k": 3}, indent=2))
        (d / "metrics.json").write_text(json.dumps({"firing_rate": [0.25, 0.0], "mean_l0": 0.25}, indent=2))
        labels = [
            {"latent_id": 0, "cluster_size": 4, "status": "ok", "title": "A", "description": "B", "error": None},
            {"latent_id": 1, "cluster_size": 0, "status": "skipped_empty_cluster", "title": None, "description": None},
        ]
        (d / "labels.json").write_text(json.dumps(labels, indent=2))
    from spanlake.operators import reports

    config, metrics, labels = runs.read_runs(spark, str(tmp_path), 18)
    rows = reports.run_summary(reports.join_runs(config, metrics, labels)).orderBy("latent_id").collect()
    assert [(r.run[:3], r.n_latents, r.cluster_size, r.firing_rate, r.title) for r in rows] == [
        ("L18", 2, 4, 0.25, "A"),
        ("L18", 2, 0, 0.0, None),
    ]
    assert runs.read_runs(spark, str(tmp_path))[0].count() == 2
    lost = labels.withColumn("run", F.lit("L18_n9_k3_uncentered_s0"))
    with pytest.raises(PySparkException, match="has no configuration"):
        reports.join_runs(config, metrics, lost).collect()


def test_run_documents_together(spark, folder):
    """Many runs are few files; runs that are alone in their folder are read beside them."""
    names = [f"L{18 + i % 2}_n2_k3_uncentered_s{i}" for i in range(40)] + [None]
    entry = {"config.json": {"n_latents": 2}, "metrics.json": {"firing_rate": [0.25, 0.0]}}
    entry["labels.json"] = [{"latent_id": i, "cluster_size": 4 - i, "title": 'a "b"\n'} for i in range(2)]
    rows = [(run, file, json.dumps(value)) for run in names for file, value in entry.items()]
    runs.write_documents(spark.createDataFrame(rows, "run string, file string, value string").repartition(2), folder)
    assert sum(name.startswith("part-") for _, _, files in os.walk(folder) for name in files) <= 3 * 3 * 2

    def found(layer=None):
        summary = reports.run_summary(reports.join_runs(*runs.read_runs(spark, folder, layer)))
        return sorted((r.run, r.latent_id, r.cluster_size, r.firing_rate, r.title) for r in summary.collect())

    of = lambda runs_: sorted((r or runs.NO_NAME, i, 4 - i, [0.25, 0.0][i], 'a "b"\n') for r in runs_ for i in range(2))
    assert found() == of(names) and found(18) == of(names[:40:2]) and found(17) == []
    alone = os.path.join(folder, "L17_n2_k3_uncentered_s0")
    os.mkdir(alone)
    for file, value in entry.items():
        with open(os.path.join(alone, file), "w") as f:
            json.dump(value, f, indent=2)
    assert found(17) == of([os.path.basename(alone)]) and found() == of([*names, os.path.basename(alone)])


def test_freeze_guard(spark, folder):
    built = []

    def build():
        built.append(1)
        return {"sentences": spark.range(5), "responses": spark.range(2)}

    params = {"model": "m", "max_length": 10, "limit": None}
    first = freeze.freeze(build, spark, folder, params, "h1")
    again = freeze.freeze(build, spark, folder, params, "h1")
    assert built == [1] and first["sentences"].count() == again["sentences"].count() == 5
    for other in (({**params, "max_length": 11}, "h1"), (params, "h2")):
        with pytest.raises(RuntimeError):
            freeze.freeze(build, spark, folder, *other)
    freeze.freeze(build, spark, folder, params, "h2", force=True)
    assert built == [1, 1]

    def broken():
        return {"sentences": spark.range(9), "responses": spark.range(2).select(F.raise_error(F.lit("stopped")))}

    with pytest.raises(PySparkException):
        freeze.freeze(broken, spark, folder, params, "h3", force=True)
    # nothing of the half-built tables is taken over
    again = freeze.freeze(build, spark, folder, params, "h2")
    assert built == [1, 1, 1] and again["sentences"].count() == 5


def test_fingerprints(spark, tmp_path):
    df = spark.range(300).select("id", F.col("id").cast("string").alias("t"))
    value = freeze.fingerprint(df).first()[0]
    assert value == freeze.fingerprint(df.repartition(7).orderBy(hash_order(1, F.col("id")))).first()[0]
    assert value != freeze.fingerprint(df.union(df.limit(1))).first()[0]
    assert value != freeze.fingerprint(df.withColumn("t", F.when(F.col("id") != 7, F.col("t")))).first()[0]
    write_lines(tmp_path / "a.jsonl", [generation(1, "x")])
    one = freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
    assert one == freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
    write_lines(tmp_path / "b.jsonl", [generation(1, "x")])
    assert one != freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
    lines = [generation(i, "some words " * 20) for i in range(200)]
    write_lines(tmp_path / "c.jsonl", lines)
    whole = freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        assert whole == freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
        lines[3], lines[150] = lines[150], lines[3]
        write_lines(tmp_path / "c.jsonl", lines)
        assert whole != freeze.fingerprint_files(spark, str(tmp_path)).first()[0]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_completion_marker(spark, folder):
    every = spark.createDataFrame([("a",), ("b",)], "response_id string")
    done = every.limit(1)
    assert not freeze.write_meta(every, done, "response_id", {"n": 2}, folder)
    assert not tables.exists(spark, f"{folder}/meta")
    assert freeze.write_meta(every, every, "response_id", {"n": 2}, folder)
    assert tables.read_json(spark, f"{folder}/meta") == {"n": 2}


def test_paper_results(spark, tmp_path):
    path = tmp_path / "paper_results.json"
    path.write_text(json.dumps({"m1": {"mha_best_accuracy": 0.5, "mlp_best_accuracy": 0.25}, "m2": {"residual_best_accuracy": 1.0}}, indent=2))
    df = papers.read_paper_results(spark, [str(tmp_path / "missing.json"), str(path)])
    assert sorted(tuple(r) for r in df.collect()) == [
        ("m1", "mha_best_accuracy", 0.5),
        ("m1", "mlp_best_accuracy", 0.25),
        ("m2", "residual_best_accuracy", 1.0),
    ]
    with pytest.raises(FileNotFoundError):
        papers.read_paper_results(spark, [str(tmp_path / "missing.json")])


def test_stream_in_two_arrivals_equals_batch(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    first = [generation(i, f"Answer {i}. More text {i}!  End") for i in range(5)] + [generation(90, " ")]
    second = [generation(i, f"Answer {i}. Short") for i in range(5, 9)]
    repeated = [generation(2, "Another text. For a known id")]

    def arrive(name, records):
        write_lines(source / name, records)
        query = ingest_stream(spark, str(source), out, state)
        query.awaitTermination(120)
        assert query.exception() is None

    arrive("a.jsonl", first)
    arrive("b.jsonl", second + repeated)
    ingest_stream(spark, str(source), out, state).awaitTermination(120)  # nothing new
    got = read_ingested(spark, out)
    want = tables_of(spark.createDataFrame([tuple({**r, "row_id": str(r["row_id"])}.values()) for r in first + second], GENERATION))
    numbers = ("global_idx", "response_idx")
    for name in ("sentences", "responses", "skips"):
        a, b = getattr(want, name).drop(*numbers), got[name].drop(*numbers)
        assert sorted(map(str, b.select(a.columns).collect())) == sorted(map(str, a.collect()))
    assert sorted(r.global_idx for r in got["sentences"].collect()) == list(range(got["sentences"].count()))
    assert sorted(r.response_idx for r in got["responses"].collect()) == list(range(9))


def test_stream_of_many_batches_keeps_no_state(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), tmp_path / "state"
    source.mkdir()
    for step in range(6):
        known = [generation(i, "Again. For a known id") for i in range(max(0, step - 4), step)]
        twice = [generation(step, f"Answer {step}. Short")] * 2
        write_lines(source / f"{step}.jsonl", known + twice)
        query = ingest_stream(spark, str(source), out, str(state), id_buckets=4, merge_every=2)
        assert query.awaitTermination(120) and query.exception() is None
    got = read_ingested(spark, out)
    assert sorted(r.row_id for r in got["responses"].collect()) == [str(i) for i in range(6)]
    assert not any("Again" in str(r) for r in got["sentences"].collect())
    assert sorted(r.response_idx for r in got["responses"].collect()) == list(range(6))
    assert not (state / "state").exists()
    assert spark.read.parquet(f"{out}/ids_merged/upto=6").count() == 6
    assert spark.read.parquet(f"{out}/ids_merged/upto=4").count() == 4


def test_inference_keeps_order_and_batches(spark):
    df = spark.range(25).select(F.col("id"), F.concat(F.lit("t"), "id").alias("text")).coalesce(2)

    def make():
        def fn(batch):
            assert 0 < len(batch) <= 4
            return [f"  {t}!\n" for t in batch]

        return fn

    rows = infer.infer(df, make, 4).collect()
    assert {r.id: r.response for r in rows} == {i: f"t{i}!" for i in range(25)}
    with pytest.raises(PySparkException):
        infer.infer(df, lambda: lambda batch: batch[:-1], 4).collect()
