"""Queries over clusters: members, exemplars, prompts, labels."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import replies
from spanlake.operators import exemplars as ex
from spanlake.operators import labeling, metrics, sae
from spanlake.plans import sql_parts as sp
from spanlake.plans.catalog import query, r4, sql_r4, table
from spanlake.plans.vector_queries import K, N_LATENTS, coded
from spanlake.session import cut_lineage

N_TOP, N_RANDOM, SEED = 5, 5, 0


def assigned(spark, sf) -> DataFrame:
    return sae.assignments(coded(spark, sf).withColumnRenamed("vec_id", "global_idx"), K)


def _texts(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("global_idx"), "text")


_MEMBERS = "WITH " + sp.ASSIGNED + ", member AS (SELECT a.*, d.text FROM assign a JOIN documents d ON d.doc_id = a.global_idx)"

_TOP = """
top AS (
  SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY strength DESC, global_idx) AS rank
  FROM assign WHERE latent_id >= 0 QUALIFY rank <= 5)"""

_RANDOM = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY strength DESC, global_idx) AS by_strength
  FROM assign WHERE latent_id >= 0),
random_ AS (
  SELECT latent_id, global_idx, strength,
         row_number() OVER (PARTITION BY latent_id ORDER BY md5('0|' || latent_id || '|' || global_idx), global_idx) AS rank
  FROM ranked WHERE by_strength > 5 QUALIFY rank <= 5)"""


@query("J7", _MEMBERS + f" SELECT global_idx, latent_id, {sql_r4('strength')} AS strength, md5(text) AS text_md5 FROM member")
def members_with_text(spark, sf):
    rows = ex.members_with_text(assigned(spark, sf), _texts(spark, sf))
    return rows.select("global_idx", "latent_id", r4("strength").alias("strength"), F.md5("text").alias("text_md5"))


@query("W2", "WITH " + sp.ASSIGNED + "," + _TOP + f" SELECT latent_id, global_idx, {sql_r4('strength')} AS strength, rank::INTEGER AS rank FROM top")
def top_exemplars(spark, sf):
    rows = ex.top_exemplars(assigned(spark, sf), N_TOP)
    return rows.select("latent_id", "global_idx", r4("strength").alias("strength"), "rank")


@query("W3", "WITH " + sp.ASSIGNED + "," + _RANDOM + f" SELECT latent_id, global_idx, {sql_r4('strength')} AS strength, rank::INTEGER AS rank FROM random_")
def random_exemplars(spark, sf):
    rows = ex.random_exemplars(assigned(spark, sf), N_TOP, N_RANDOM, SEED)
    return rows.select("latent_id", "global_idx", r4("strength").alias("strength"), "rank")


_PROMPTS = (
    "WITH "
    + sp.ASSIGNED
    + ","
    + _TOP
    + ","
    + _RANDOM
    + f""",
line AS (
  SELECT latent_id, 0 AS part, rank, '[top-activating] ' || text AS line
  FROM top JOIN documents d ON d.doc_id = global_idx
  UNION ALL
  SELECT latent_id, 1, rank, '[random from cluster] ' || text FROM random_ JOIN documents d ON d.doc_id = global_idx),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY latent_id ORDER BY part, rank) || '. ' || line AS item FROM line),
block AS (
  SELECT latent_id, string_agg(item, chr(10) ORDER BY part, rank) AS lines, count(*)::INTEGER AS n,
         count(*) FILTER (part = 0) AS n_top, count(*) FILTER (part = 1) AS n_random,
         left(split_part(first(line ORDER BY part, rank), chr(10), 1), 36) AS first_line
  FROM numbered GROUP BY latent_id),
size_ AS (
  SELECT range::INTEGER AS latent_id, count(global_idx) AS cluster_size
  FROM range({N_LATENTS}) LEFT JOIN assign ON latent_id = range GROUP BY range)"""
)


def _prompts(spark, sf) -> DataFrame:
    assign = cut_lineage(assigned(spark, sf))  # read three times, encoded once
    chosen = ex.members_with_text(ex.exemplars(assign, N_TOP, N_RANDOM, SEED), _texts(spark, sf))
    return ex.build_prompts(chosen, metrics.cluster_sizes(assign, N_LATENTS))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


@query(
    "F8 W2 W3 J7",
    _PROMPTS
    + f"""
SELECT latent_id, cluster_size, coalesce(n, 0) AS n_exemplars_used,
       {_quoted(ex.PromptTemplate.question)} || ' (' || n_top || ' strongest, ' || n_random || ' random)' || chr(10) || chr(10)
       || lines || chr(10) || chr(10) || {_quoted(ex.PromptTemplate.answer)} AS prompt
FROM size_ LEFT JOIN block USING (latent_id)""",
)
def exemplar_prompts(spark, sf):
    return _prompts(spark, sf)


def _judge(prompt: str, system: str) -> str:
    """A stand-in judge: names a cluster by the first words of its first exemplar, and fails when none was drawn."""
    if "JSON" not in system:
        raise ValueError("no system message")
    lines = prompt.split("\n\n", 1)[1]
    n_random = lines.count("[random from cluster] ")
    if n_random == 0:
        raise RuntimeError("nothing drawn")
    title = lines[len("1. ") :].split("\n")[0][:36]
    label = json.dumps({"title": title, "description": f"{n_random} drawn"})
    return f"Here it is:\n```json\n{label}\n```"


@query(
    "U2 F7",
    _PROMPTS
    + """
SELECT latent_id, cluster_size, coalesce(n, 0) AS n_exemplars_used, 'stand-in' AS judge_model,
       CASE WHEN n_random > 0 THEN first_line END AS title,
       CASE WHEN n_random > 0 THEN n_random || ' drawn' END AS description,
       CASE WHEN n IS NULL THEN 'skipped_empty_cluster' WHEN n_random > 0 THEN 'ok' ELSE 'error' END AS status,
       CASE WHEN n_random = 0 THEN 'RuntimeError: nothing drawn' END AS error
FROM size_ LEFT JOIN block USING (latent_id)""",
)
def cluster_labels(spark, sf):
    return labeling.label_clusters(_prompts(spark, sf), _judge, "stand-in", system=ex.PromptTemplate.system)


_REPLY = "text || chr(10) || '```json' || chr(10) || '{\"title\": \"' || source || '\", \"description\": \"' || lang || '\"}' || chr(10) || '```'"


def _replies(spark, sf) -> DataFrame:
    made = F.concat(
        "text", F.lit('\n```json\n{"title": "'), "source", F.lit('", "description": "'), "lang", F.lit('"}\n```')
    )
    return table(spark, sf, "documents").select("doc_id", made.alias("reply"))


@query("F6", "SELECT doc_id, '{\"description\": \"' || lang || '\", \"title\": \"' || source || '\"}' AS found FROM documents")
def json_in_replies(spark, sf):
    return _replies(spark, sf).select("doc_id", replies.extract_json(F.col("reply")).alias("found"))


@query(
    "F7",
    "SELECT doc_id, source AS title, lang AS description, 'ok' AS status, NULL::VARCHAR AS error FROM documents",
)
def validated_replies(spark, sf):
    checked = _replies(spark, sf).select("doc_id", replies.validate_label(F.col("reply")).alias("v"))
    return checked.select("doc_id", "v.*")


@query(
    "V2 V3 W10 A12 J7 W2",
    "WITH "
    + sp.ASSIGNED
    + ","
    + _TOP
    + f""",
size_ AS (SELECT latent_id, count(*) AS cluster_size FROM assign GROUP BY latent_id)
SELECT latent_id, cluster_size, rank::INTEGER AS rank, global_idx, {sql_r4('strength')} AS strength, left(text, 80) AS excerpt
FROM top JOIN size_ USING (latent_id) JOIN documents ON doc_id = global_idx""",
)
def latent_report(spark, sf):
    """For each latent its size and its five strongest documents."""
    assign = assigned(spark, sf)
    top = ex.members_with_text(ex.top_exemplars(assign, N_TOP), _texts(spark, sf))
    sizes = metrics.cluster_sizes(assign, N_LATENTS)
    return top.join(sizes, "latent_id").select(
        "latent_id", "cluster_size", "rank", "global_idx", r4("strength").alias("strength"), F.substring("text", 1, 80).alias("excerpt")
    )
