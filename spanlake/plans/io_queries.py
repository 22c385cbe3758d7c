"""Queries that write through a sink and read back through its source. The files lie in the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.fixed import MAX_LENGTH
from spanlake.functions.text import run_name
from spanlake.operators import labeling, probes, reports
from spanlake.operators import prompts as pr
from spanlake.plans import corpus
from spanlake.plans import sql_parts as sp
from spanlake.plans.catalog import query, r4, sql_r4, table
from spanlake.plans.cluster_queries import _MEMBERS, assigned
from spanlake.plans.probe_queries import _ACTS, _RATES, _acts, _labels, rates_by_half
from spanlake.plans.text_queries import SHORT, SKIPS_SQL, chat_sql
from spanlake.plans.vector_queries import K, dictionary
from spanlake.schemas import GENERATION
from spanlake.session import scratch_dir
from spanlake.sources import freeze, generations, papers, prompts, runs, tables
from spanlake.streaming.ingest import ingest_stream, read_ingested


@query(
    "S1 P1",
    f"""SELECT 'parts' AS dataset, p_partkey::VARCHAR AS row_id, prompt_col, {sp.strip('text')} AS text
FROM (UNPIVOT (SELECT p_partkey, p_name || chr(10) || '"' || p_brand || '", ' AS p_name, p_type FROM part) ON p_name, p_type
      INTO NAME prompt_col VALUE text)""",
)
def csv_prompts(spark, sf):
    folder = scratch_dir(spark)
    named = F.concat("p_name", F.lit('\n"'), "p_brand", F.lit('", '))
    parts = table(spark, sf, "part").select("p_partkey", named.alias("p_name"), "p_type")
    parts.write.csv(folder, header=True, escape='"', quoteAll=True)
    return pr.melt_prompts(prompts.read_prompt_csv(spark, folder), "parts", "p_partkey", ["p_name", "p_type"])


@query(
    "S3 S4",
    "WITH " + sp.GENERATIONS + " SELECT dataset, row_id, prompt_col, prompt, sample_idx, response, 'stand-in' AS model FROM gen",
)
def stored_generations(spark, sf):
    folder = scratch_dir(spark)
    generations.write_generations(corpus.conversation_generations(spark, sf), folder)
    return generations.read_generations(spark, folder, "*.json").select(*GENERATION.fieldNames())


def _tables(spark, sf) -> corpus.CorpusTables:
    return corpus.tables_of(corpus.conversation_generations(spark, sf))


@query(
    "S5",
    chat_sql(MAX_LENGTH)
    + """ SELECT response_id, sent_idx, tok_start, tok_end, (SELECT count(DISTINCT response_id) FROM span WHERE tok_start IS NOT NULL) AS n_responses
FROM span WHERE tok_start IS NOT NULL""",
)
def stored_tables(spark, sf):
    folder = scratch_dir(spark)
    made = _tables(spark, sf)
    tables.write_tables(made.sentences, made.responses, folder)
    sentences, responses = tables.read_tables(spark, folder)
    n = responses.agg(F.count(F.lit(1)).alias("n"))
    rows = sentences.select("response_id", "sent_idx", "tok_start", "tok_end")
    return rows.withColumn("n_responses", n.scalar())


@query("S6", SKIPS_SQL)
def stored_skips(spark, sf):
    folder = scratch_dir(spark)
    made = corpus.tables_of(corpus.conversation_generations(spark, sf), max_length=SHORT)
    tables.write_skips(made.skips, folder)
    return tables.read_skips(spark, folder)


@query("S7", f"SELECT label AS layer, vec_id AS global_idx, {sql_r4('list_sum(embedding::DOUBLE[])')} AS total FROM embeddings WHERE label = 4")
def vectors_of_one_layer(spark, sf):
    folder = scratch_dir(spark)
    emb = table(spark, sf, "embeddings").select(
        F.col("label").alias("layer"), F.col("vec_id").alias("global_idx"), F.col("embedding").alias("vector")
    )
    tables.write_vectors(emb, folder)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return tables.read_vectors(spark, folder, 4).select("layer", "global_idx", r4(total).alias("total"))


@query("S9", _MEMBERS.split(", member AS")[0] + f" SELECT 'L18_n10_k3_uncentered_s0' AS run, global_idx, latent_id, {sql_r4('strength')} AS strength FROM assign")
def stored_run(spark, sf):
    folder, run = scratch_dir(spark), "L18_n10_k3_uncentered_s0"
    params = dictionary(spark, sf)
    config = {"layer": 18, "n_latents": params.n_latents, "k": K, "centered": False, "seed": 0}
    runs.write_run(run, folder, assigned(spark, sf), params.to_table(spark), config, {"firing_rate": []}, params.b_dec.tolist())
    if run not in runs.finished_runs(spark, folder):
        raise RuntimeError("the run is not marked as finished")
    rows = runs.read_run_table(spark, folder, "assignments", run)
    return rows.select("run", "global_idx", "latent_id", r4("strength").alias("strength"))


@query(
    "S10",
    """SELECT 'r' AS run, p_partkey::INTEGER AS latent_id,
       CASE WHEN p_size % 3 = 0 THEN 'ok' ELSE 'error' END AS status, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS attempt
FROM part""",
)
def latest_labels(spark, sf):
    """A first batch of errors, then a second one that redoes some of them, written twice."""
    folder = scratch_dir(spark)
    every = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("latent_id"), "p_size")
    first = every.select("latent_id", F.lit("error").alias("status"), F.lit(0).alias("attempt"))
    redone = every.filter("p_size % 3 = 0").select("latent_id", F.lit("ok").alias("status"), F.lit(1).alias("attempt"))
    runs.write_labels(first, folder, "r", 0)
    for _ in range(2):
        runs.write_labels(redone, folder, "r", 1)
    return runs.read_labels(spark, folder)


@query("S11", "WITH " + _ACTS + " SELECT family, layer, head, example_id, label FROM data")
def stored_probe_cache(spark, sf):
    folder = scratch_dir(spark)
    tables.write_probe_cache(_acts(spark, sf), _labels(spark, sf), folder, {"dtype": "float32"})
    acts, labels, meta = tables.read_probe_cache(spark, folder)
    if meta != {"dtype": "float32"}:
        raise RuntimeError("the description differs")
    rows = probes.probe_dataset(acts, labels)
    return rows.select("family", "layer", "head", "example_id", "label")


@query(
    "S12",
    """SELECT DISTINCT 'L' || lpad(p_size::VARCHAR, 2, '0') || '_n' || substring(p_brand, 7) || '_k3_uncentered_s0' AS run
FROM part WHERE p_size = 18 AND p_brand IN (SELECT p_brand FROM part WHERE p_type = 'ECONOMY' AND p_size = 18)""",
)
def runs_of_a_layer(spark, sf):
    brand = F.substring("p_brand", 7, 10).cast("int")
    named = table(spark, sf, "part").select(
        run_name(F.col("p_size"), brand, F.lit(3), F.lit(False), F.lit(0)).alias("run"), "p_type"
    )
    return runs.select_runs(named.select("run").distinct(), named.filter("p_type = 'ECONOMY'").select("run"), 18)


@query("S13", "SELECT doc_id, n_chars FROM documents")
def frozen_table(spark, sf):
    """Built once, then taken over because input and parameters are the same."""
    folder = scratch_dir(spark)
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    built = []

    def build() -> dict[str, DataFrame]:
        built.append(1)
        return {"documents": docs}

    value = freeze.fingerprint(docs).first()["fingerprint"]
    for _ in range(2):
        out = freeze.freeze(build, spark, folder, {"max_length": MAX_LENGTH}, value)
    if len(built) != 1:
        raise RuntimeError("the table was built again")
    return out["documents"]


@query(
    "S14",
    """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) = 0 AS marked_by_labels,
       true AS marked_by_itself""",
)
def completion_marker(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    by_labels = freeze.write_meta(docs, labels, "doc_id", {"n": 1}, scratch_dir(spark))
    by_itself = freeze.write_meta(docs, docs, "doc_id", {"n": 1}, scratch_dir(spark))
    counts = labeling.progress(docs, labels, "doc_id")
    return counts.select(F.lit(by_labels).alias("marked_by_labels"), F.lit(by_itself).alias("marked_by_itself"))


@query(
    "T1",
    chat_sql(MAX_LENGTH)
    + """ SELECT row_number() OVER (ORDER BY response_id, sent_idx) - 1 AS global_idx, response_id, sent_idx, text, tok_start, tok_end
FROM span WHERE tok_start IS NOT NULL""",
)
def ingested_stream(spark, sf):
    folder = scratch_dir(spark)
    arrived = pr.with_response_id(corpus.conversation_generations(spark, sf)).drop("response_id")
    arrived.write.json(f"{folder}/in")
    query_ = ingest_stream(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/state", glob="*.json"
    )
    query_.awaitTermination()
    rows = read_ingested(spark, f"{folder}/out")["sentences"]
    return rows.select("global_idx", "response_id", "sent_idx", "text", "tok_start", "tok_end")


@query(
    "S15",
    "WITH "
    + _RATES
    + f""" SELECT model || '/' || half AS model, CASE metric WHEN 'quality' THEN 'mha_best_accuracy' ELSE 'mlp_best_accuracy' END AS metric,
       {sql_r4('value')} AS value FROM value_ WHERE NOT (model = 'en' AND metric = 'toxic')""",
)
def stored_paper_results(spark, sf):
    folder = scratch_dir(spark)
    toxic = F.when(F.col("model") != "en", F.col("toxic"))
    numbers = F.struct(F.col("quality").alias("mha_best_accuracy"), toxic.alias("mlp_best_accuracy"))
    named = rates_by_half(spark, sf).select(F.concat_ws("/", "model", "half").alias("model"), numbers.alias("n"))
    # one entry per language and half
    document = named.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("model", "n")))).alias("value"))
    document.coalesce(1).write.text(folder)
    found = papers.read_paper_results(spark, [f"{folder}-missing", folder])
    return found.select("model", "metric", r4("value").alias("value"))


_UNPIVOTED = """(UNPIVOT (SELECT o_orderkey, o_orderpriority, o_orderstatus || ' of "' || o_orderkey || '"' AS note, o_orderstatus AS status FROM orders)
      ON note, status INTO NAME prompt_col VALUE text)"""


@query(
    "S1 S2 P1 P2",
    f"""SELECT o_orderpriority AS dataset, true AS known, prompt_col, o_orderkey::VARCHAR AS row_id, {sp.strip('text')} AS text
FROM {_UNPIVOTED} WHERE o_orderpriority[1] IN ('1', '3', '5')
UNION ALL SELECT DISTINCT o_orderpriority, false, NULL, NULL, NULL FROM orders WHERE o_orderpriority[1] NOT IN ('1', '3', '5')""",
)
def listed_sources(spark, sf):
    """A prompt source per priority, written by Spark; three have a specification and are read, the others are only listed."""
    folder = scratch_dir(spark)
    note = F.concat("o_orderstatus", F.lit(' of "'), "o_orderkey", F.lit('"'))
    rows = table(spark, sf, "orders").select("o_orderkey", note.alias("note"), F.col("o_orderstatus").alias("status"), F.concat("o_orderpriority", F.lit(".csv")).alias("file"))
    rows.write.partitionBy("file").csv(folder, header=True, escape='"', quoteAll=True)
    specs = {f"{name}.csv": ("o_orderkey", ("note", "status")) for name in ("1-URGENT", "3-MEDIUM", "5-LOW")}
    known, unknown = prompts.list_prompt_sources(spark, folder, specs)
    read = prompts.read_prompts(spark, folder, specs)
    name = F.regexp_replace("file_name", "[.]csv$", "").alias("dataset")
    listed = known.select(name, F.lit(True).alias("known")).join(read, "dataset", "left")
    return listed.unionByName(unknown.select(name, F.lit(False).alias("known")), allowMissingColumns=True)


_RUN_SQL = "'L' || lpad((label + 10)::VARCHAR, 2, '0') || '_n3_k3_uncentered_s' || (vec_id // 50)"


@query(
    "S8 S12 J6 P11",
    f"""WITH v AS (SELECT {_RUN_SQL} AS run, label + 10 AS layer, vec_id % 3 AS latent_id FROM embeddings),
n AS (SELECT run, layer, i::INTEGER AS latent_id, count(*) FILTER (latent_id = i) AS cluster_size, count(*) AS n FROM v, range(3) AS t(i) GROUP BY ALL),
r AS (
  SELECT layer, run, 3 AS n_latents, latent_id, cluster_size, cluster_size / n::DOUBLE AS firing_rate,
         CASE WHEN cluster_size > 0 THEN 'ok' ELSE 'skipped_empty_cluster' END AS status,
         CASE WHEN cluster_size > 0 THEN 'group "' || run || '/' || latent_id || '"' END AS title, NULL::VARCHAR AS description FROM n)
SELECT 'all' AS scope, * EXCLUDE (layer) FROM r UNION ALL SELECT 'one layer', * EXCLUDE (layer) FROM r WHERE layer = 14""",
)
def documents_of_runs(spark, sf):
    """A run per label and fifty vectors, kept as JSON documents that Spark writes by layer; all are read, then those of one layer."""
    folder = scratch_dir(spark)
    run = F.concat(F.lit("L"), F.lpad((F.col("label") + 10).cast("string"), 2, "0"), F.lit("_n3_k3_uncentered_s"), F.floor(F.col("vec_id") / 50))
    vecs = table(spark, sf, "embeddings").select(run.alias("run"), (F.col("label") + 10).alias("layer"), (F.col("vec_id") % 3).alias("latent"))
    sizes = [F.count_if(F.col("latent") == i) for i in range(3)]
    found = vecs.groupBy("run", "layer").agg(F.array(*sizes).alias("size"), F.count("*").alias("n"))

    def label(size, i):
        title = F.when(size > 0, F.concat(F.lit('group "'), "run", F.lit("/"), i, F.lit('"')))
        status = F.when(size > 0, "ok").otherwise("skipped_empty_cluster")
        return F.struct(i.cast("int").alias("latent_id"), size.alias("cluster_size"), status.alias("status"), title.alias("title"))

    documents = {
        "config": F.struct("layer", F.lit(3).alias("n_latents")),
        "metrics": F.struct(F.transform("size", lambda x: x / F.col("n")).alias("firing_rate")),
        "labels": F.transform("size", label),
    }
    entries = F.array(*[F.struct(F.lit(f"{name}.json").alias("file"), F.to_json(content).alias("value")) for name, content in documents.items()])
    runs.write_documents(found.select("run", F.explode(entries).alias("e")).select("run", "e.file", "e.value"), folder)
    read = [
        reports.run_summary(reports.join_runs(*runs.read_runs(spark, folder, layer))).select(F.lit(scope).alias("scope"), "*")
        for scope, layer in (("all", None), ("one layer", 14))
    ]
    return read[0].unionByName(read[1])
