"""The plans are the ones that scale: limits before shuffles, pruned scans, nothing computed twice."""

from pyspark.sql import functions as F

from spanlake.operators import exemplars as ex
from spanlake.operators import segment
from spanlake.plans.catalog import load_all, table
from spanlake.plans.cluster_queries import assigned

QUERIES = load_all()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cutting_does_not_shuffle(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for df in (segment.split_sentences(docs), segment.tokenize(docs), segment.segment(docs, None, "text")):
        assert "Exchange" not in plan_of(df)


def test_regular_expressions_run_once(spark, sf_dir):
    plan = plan_of(segment.split_sentences(table(spark, sf_dir, "documents")))
    assert plan.count("regexp_replace(") == 1
    plan = plan_of(segment.tokenize(table(spark, sf_dir, "documents")))
    assert plan.count("regexp_extract_all(") == 1


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = plan_of(segment.split_sentences(table(spark, sf_dir, "documents")))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_exemplars_are_cut_before_the_shuffle(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    assert "WindowGroupLimit" in plan_of(ex.top_exemplars(rows, 5))
    assert plan_of(ex.random_exemplars(rows, 5, 5)).count("WindowGroupLimit") >= 2


def test_vectors_are_encoded_once(spark, sf_dir):
    rows = assigned(spark, sf_dir)
    for df in (rows, rows.filter("latent_id >= 0"), ex.top_exemplars(rows, 5)):
        plan = plan_of(df)
        assert plan.count("ArrowEvalPython") == plan.count("Scan parquet") == 1


def test_coverage_report_reads_each_side_once(spark, sf_dir):
    # one side of the query is a table, the other a join of two
    assert plan_of(QUERIES["coverage_report"].run(spark, sf_dir)).count("Scan parquet") == 3


def test_heavy_cluster_is_cut_in_two_levels(spark):
    rows = spark.range(5000).selectExpr("id AS global_idx", "int(id >= 4900) AS latent_id", "cast(id % 977 AS double) AS strength")
    got = [r.global_idx for r in ex.top_exemplars(rows.repartition(11), 7).where("latent_id = 0").orderBy("rank").collect()]
    assert got == sorted(range(4900), key=lambda i: (-(i % 977), i))[:7]
    assert plan_of(ex.top_exemplars(rows, 7)).count("WindowGroupLimit") >= 3


def shuffled(spark, df):
    """Rows and bytes that a run of ``df`` writes to shuffles."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    gateway = spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    df.write.format("noop").mode("overwrite").save()
    after = stages()
    new = [s for s in (after.apply(i) for i in range(after.size())) if s.stageId() not in before]
    return sum(s.shuffleWriteRecords() for s in new), sum(s.shuffleWriteBytes() for s in new)


def test_alignment_is_a_sweep_without_join_or_copies(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sentences, tokens = segment.split_sentences(docs), segment.tokenize(docs)
    sweep = segment.align_spans(sentences, tokens)
    plan = plan_of(sweep)
    assert "Join" not in plan and plan.count("Exchange") == 2
    slim = sentences.select("doc_id", "sent_idx", "char_start", "char_end")
    pairs = segment.overlap_join(slim, tokens, ["doc_id"], ("char_start", "char_end"), ("start", "end"), 256)
    joined = pairs.groupBy(*slim.columns).agg(F.min("tok_idx").alias("tok_start"), (F.max("tok_idx") + 1).alias("tok_end"))
    assert sorted(joined.collect()) == sorted(sweep.select(*joined.columns).collect())
    n, written = shuffled(spark, sweep)
    assert n < tokens.count() + 2.1 * sentences.count()  # tokens once, spans twice
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with tables too large to broadcast
    try:
        assert written < shuffled(spark, joined)[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_last_text_is_aggregated_not_ranked(spark, sf_dir):
    plan = plan_of(QUERIES["attached_texts"].run(spark, sf_dir))
    assert "Window" not in plan and "max_by" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.col("lang") == "en")
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan_of(segment.split_sentences(docs))
