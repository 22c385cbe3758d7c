"""Exemplars, judge replies and labelling: the cases of the inventory's test list."""

import json

import pytest
from pyspark.sql import functions as F

from spanlake.functions.replies import first_json_object, validate_label
from spanlake.operators import exemplars as ex
from spanlake.operators import labeling
from spanlake.plans import labeling as flow
from spanlake.sources import runs


def assignment_of(spark, ids, strength):
    rows = [(i, a, float(s)) for i, (a, s) in enumerate(zip(ids, strength))]
    return spark.createDataFrame(rows, "global_idx long, latent_id int, strength double").repartition(4)


def sentences_of(spark, n):
    return spark.range(n).select(F.col("id").alias("global_idx"), F.concat(F.lit("sentence "), "id").alias("text"))


def picked(df, latent):
    rows = df.filter(F.col("latent_id") == latent).orderBy("rank").collect()
    return [r.global_idx for r in rows if r.kind == "top"], [r.global_idx for r in rows if r.kind == "random"]


def test_top_and_random(spark):
    a = assignment_of(spark, [2, 0, 2, 2, -1, 0, 2, 0, 2, 2, 0], [0.15, 0.6, 0.95, 0.4, 0, 0.2, 0.85, 0.75, 0.3, 0.05, 0.1])
    top, rest = picked(ex.exemplars(a, 3, 2), 2)
    assert top == [2, 6, 3]
    assert len(rest) == 2 and set(rest) <= {0, 8, 9}


def test_empty_cluster(spark):
    a = assignment_of(spark, [4] * 3, [0.7, 0.25, 0.5])
    assert picked(ex.exemplars(a), 3) == ([], [])


def test_cluster_smaller_than_top(spark):
    a = assignment_of(spark, [7, 7, 5, 7, 5], [0.3, 0.1, 0.8, 0.2, 0.9])
    top, rest = picked(ex.exemplars(a), 7)
    assert top == [0, 3, 1] and rest == []


def test_disjoint_whole_and_stable(spark):
    a = assignment_of(spark, [i * 7 % 3 for i in range(50)], [(i * 37 % 50) / 50 for i in range(50)])
    one = ex.exemplars(a, 3, 100)
    for latent in range(3):
        top, rest = picked(one, latent)
        assert not set(top) & set(rest)
        assert len(top) + len(rest) == sum(1 for i in range(50) if i * 7 % 3 == latent)
    again = ex.exemplars(a.repartition(7), 3, 5)
    assert picked(again, 1) == picked(ex.exemplars(a.coalesce(1), 3, 5), 1)


def test_random_pool_equals_choice_over_the_whole_rest(spark):
    import hashlib

    n = 400  # one latent holds all rows
    a = assignment_of(spark, [0] * n, [(i * 137 % n) / n for i in range(n)])
    _, rest = picked(ex.exemplars(a, 10, 15, seed=3), 0)
    strong = sorted(range(n), key=lambda i: (-(i * 137 % n), i))[:10]
    order = sorted((i for i in range(n) if i not in strong), key=lambda i: hashlib.md5(f"3|0|{i}".encode()).hexdigest())
    assert rest == order[:15]


PLAIN = '{"title": "Doubt", "description": "Takes back what was said."}'


@pytest.mark.parametrize("reply", [PLAIN, f"```json\n{PLAIN}\n```", f"As {{asked}}:\n{PLAIN}\nThat is all."])
def test_json_is_found(reply):
    assert first_json_object(reply) == {"title": "Doubt", "description": "Takes back what was said."}


def test_no_json_raises():
    with pytest.raises(ValueError):
        first_json_object("just words")


def test_validation_in_spark(spark):
    replies = [PLAIN, '{"title": ""}', "nothing", '{"title": 3, "description": "x"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [r.v for r in df.select("i", validate_label(F.col("r")).alias("v")).orderBy("i").collect()]
    assert [v.status for v in got] == ["ok", "error", "error", "error"]
    assert got[0].title == "Doubt" and all(v.error.startswith("ValueError: ") for v in got[1:])


def prompts(spark, rows):
    return spark.createDataFrame(rows, "latent_id int, cluster_size long, n_exemplars_used int, prompt string")


def test_failures_are_isolated_and_empty_clusters_not_asked(spark):
    def judge(prompt):
        if prompt == "fail":
            raise RuntimeError("out of order")
        if prompt == "bad":
            return '{"title": ""}'
        assert prompt == "good"
        return '{"title": "Greeting", "description": "Says hello."}'

    made = labeling.label_clusters(
        prompts(spark, [(0, 2, 2, "good"), (1, 0, 0, None), (2, 3, 3, "fail"), (3, 1, 1, "bad")]), judge, "x"
    )
    got = {r.latent_id: r for r in made.collect()}
    assert {i: r.status for i, r in got.items()} == {0: "ok", 1: "skipped_empty_cluster", 2: "error", 3: "error"}
    assert got[0].title == "Greeting" and got[0].cluster_size == 2 and got[1].cluster_size == 0
    assert got[2].title is None and "out of order" in got[2].error


class Status(Exception):
    def __init__(self, code):
        self.status_code = code


@pytest.mark.parametrize(
    "errors, calls, works",
    [
        ([Status(500), ConnectionError()], 3, True),
        ([Status(503)] * 3, 3, False),
        ([Status(404)], 1, False),
        ([RuntimeError()], 1, False),
    ],
)
def test_retries(errors, calls, works):
    made, pauses, left = [], [], list(errors)

    def call():
        made.append(1)
        if left:
            raise left.pop(0)
        return "fine"

    if works:
        assert labeling.call_with_retry(call, 3, pauses.append) == "fine"
        assert pauses == [1, 2]
    else:
        with pytest.raises(Exception):
            labeling.call_with_retry(call, 3, pauses.append)
    assert len(made) == calls and len(pauses) == max(0, calls - 1)


def counting_judge(folder, fail_on=None):
    """A judge that leaves a file per call, since it runs in worker processes."""

    def judge(prompt, system):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        if fail_on and fail_on in prompt:
            raise RuntimeError("not now")
        return json.dumps({"title": system[:3], "description": "same"})

    return judge


def test_rerun_asks_for_failures_only_and_force_for_all(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    folder = str(tmp_path / "runs")
    a = assignment_of(spark, [-1, 2, 0, -1, 2, 0, 0, -1], [0, 0.8, 0.1, 0, 0.6, 0.7, 0.4, 0])
    sents = sentences_of(spark, 8)

    def run(judge, **options):
        before = len(list(calls.iterdir()))
        labels = flow.label_run(folder, "L07_n3_k1_centered_s4", a, sents, 3, judge, "x", per_batch=2, **options)
        states = {r.latent_id: r.status for r in labels.collect()}
        return states, len(list(calls.iterdir())) - before

    states, n = run(counting_judge(str(calls), "sentence 4"))
    assert states == {0: "ok", 1: "skipped_empty_cluster", 2: "error"} and n == 2
    states, n = run(counting_judge(str(calls)))
    assert states == {0: "ok", 1: "skipped_empty_cluster", 2: "ok"} and n == 1
    states, n = run(counting_judge(str(calls)), force=True)
    assert n == 2 and set(states.values()) == {"ok", "skipped_empty_cluster"}


def test_a_call_that_stops_keeps_its_finished_batches(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "runs")
    (tmp_path / "calls").mkdir()
    a, sents = assignment_of(spark, [0, 1, 2, 3], [0.1, 0.2, 0.3, 0.4]), sentences_of(spark, 4)
    write, done = runs.write_labels, []

    def stopping(*args):
        if done:
            raise KeyboardInterrupt
        done.append(write(*args))

    monkeypatch.setattr(runs, "write_labels", stopping)
    with pytest.raises(KeyboardInterrupt):
        flow.label_run(folder, "r", a, sents, 4, counting_judge(str(tmp_path / "calls")), "x", per_batch=2)
    monkeypatch.setattr(runs, "write_labels", write)
    labels = flow.label_run(folder, "r", a, sents, 4, counting_judge(str(tmp_path / "calls")), "x", per_batch=2)
    assert {r.latent_id: r.status for r in labels.collect()} == dict.fromkeys(range(4), "ok")
    assert len(list((tmp_path / "calls").iterdir())) == 4


def test_labels_need_matching_keys(spark, folder):
    a = assignment_of(spark, [0, 0], [0.1, 0.2])
    with pytest.raises(ValueError):
        flow.label_run(folder, "r", a, sentences_of(spark, 3), 1, counting_judge(folder), "x")


def test_run_selection(spark):
    names = ["L18_n5_k3_uncentered_s0", "L18_n10_k3_uncentered_s0", "L09_n5_k3_uncentered_s0", "L18_n7_k3_uncentered_s0"]
    df = spark.createDataFrame([(n,) for n in names], "run string")
    configs = df.filter(~F.col("run").contains("_n7_"))
    assert [r.run for r in runs.select_runs(df, configs, 18).collect()] == [names[1], names[0]]
