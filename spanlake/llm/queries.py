"""The queries of the operators over the given tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from spanlake.llm import decontaminate, html, lines, lm, mixing, pii, quality, resample, sharding, simhash, tokens, vafile, whitening
from spanlake.llm.catalog import query
from spanlake.llm.storage import stored
from spanlake.plans.catalog import table


@query()
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query(
    r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws, row_number() OVER () AS r FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(p) AS n, array_to_string(p, ' ') AS phrase
  FROM (SELECT item_id, ws[s:s + 9] AS p FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(s) WHERE len(ws) > 0)),
size AS (SELECT DISTINCT n FROM win),
gram AS (
  SELECT r, s, n, array_to_string(ws[s:s + n - 1], ' ') AS phrase
  FROM w, size, unnest(range(1, len(ws) - n + 2)) AS u(s)),
occ AS (SELECT g.r, g.s, g.n, win.item_id FROM gram g JOIN win ON win.phrase = g.phrase AND win.n = g.n),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM occ) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document, found in the stored index."""
    index = stored(decontaminate.build_index(table(spark, sf_dir, "documents").select("doc_id", "text")))
    found = decontaminate.search(index, table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


#: Tokens that a training sequence takes.
SEQUENCE = 1024


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = tokens.count_tokens(sized, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > SEQUENCE).alias("over_limit"))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_on(docs, table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model)
    kept = (F.col("score") >= corpus_pipeline.LEAST_SCORE).cast("int")
    return scored.select("doc_id", quality.is_held_out().alias("held_out"), "score", kept.alias("predicted"))


@query(
    """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0),
row_of AS (SELECT vec_id, q, row_number() OVER () AS r FROM v),
pair AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM row_of a JOIN row_of b ON a.vec_id % 50 = 0 AND a.r <> b.r AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM pair QUALIFY rank <= 5
"""
)
def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best neighbours of every fiftieth vector."""
    return vafile.nearest(table(spark, sf_dir, "embeddings"), 50, 5)


@query()
def op5_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document and the terms near it that give it away."""
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    terms = F.transform("terms", lambda t: F.struct(F.lit("term").alias("kind"), t["start"].alias("start"), t["end"].alias("end")))
    return found.select(
        F.col("id").alias("doc_id"),
        *map(count, pii.KINDS),
        F.sha2(pii.written("spans"), 256).alias("base_sha256"),
        pii.written(F.concat("spans", terms)).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
    )


@query()
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = html.with_main_text(pages, html.fit(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with one line left of each group of similar lines."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_kept", "text")


_SIZE = sharding.table_size(len(corpus_pipeline.SHARDS))
_NUMBER = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query(
    f"""
WITH RECURSIVE shard AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(corpus_pipeline.SHARDS)}) AS t(i)),
pref AS (
  SELECT i, {_NUMBER.format("'offset|' || name")} % {_SIZE} AS first, {_NUMBER.format("'skip|' || name")} % {_SIZE - 1} + 1 AS skip
  FROM shard),
fill(turn, owner) AS (
  SELECT 0::BIGINT, list_transform(range({_SIZE}), lambda x: (-1)::BIGINT)
  UNION ALL
  SELECT turn + 1, list_concat(owner[1:slot], [i], owner[slot + 2:])
  FROM (
    SELECT turn, owner, i,
           (first + skip * list_filter(range({_SIZE}), lambda k: owner[(first + skip * k) % {_SIZE} + 1] = -1)[1]) % {_SIZE} AS slot
    FROM fill JOIN pref ON i = turn % {len(corpus_pipeline.SHARDS)} WHERE turn < {_SIZE})),
owner AS (SELECT unnest(owner) AS i, generate_subscripts(owner, 1) - 1 AS slot FROM fill WHERE turn = {_SIZE}),
placed AS (SELECT doc_id, {_NUMBER.format("coalesce(doc_id::VARCHAR, '')")} % {_SIZE} AS slot FROM documents)
SELECT doc_id, slot, name AS shard FROM placed JOIN owner USING (slot) JOIN shard USING (i)
"""
)
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.with_shard(table(spark, sf_dir, "documents").select("doc_id"), corpus_pipeline.SHARDS)


def _power(k: str, more: str = "") -> str:
    return f"list_sum(list_transform(lp, lambda l: exp({k} / 1048576.0::DOUBLE * l){more}))"


def _entropy(k: str) -> str:
    return f"ln({_power(k)}) - {_power(k, f' * {k} / 1048576.0::DOUBLE * l')} / {_power(k)}"


def _bisect(name: str, low: int, holds: str, keep: str) -> str:
    """A bisection of the grid; ``keep`` is the bound that a point which holds moves."""
    yes, no = ("mid", "lo") if keep == "lo" else ("lo", "mid")
    yes_hi, no_hi = ("hi", "mid") if keep == "lo" else ("mid", "hi")
    return f"""
{name}(lo, hi) AS (
  SELECT {low}::BIGINT, 1048576::BIGINT
  UNION ALL
  SELECT CASE WHEN ok THEN {yes} ELSE {no} END, CASE WHEN ok THEN {yes_hi} ELSE {no_hi} END
  FROM (SELECT lo, hi, mid, {holds} AS ok FROM (SELECT lo, hi, (lo + hi) // 2 AS mid FROM {name} WHERE hi - lo > 1), lists))"""


@query(
    rf"""
WITH RECURSIVE tok AS (
  SELECT doc_id, coalesce('=' || source, '') AS s, source,
         len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS n_tokens FROM documents),
src AS (SELECT s, sum(n_tokens)::BIGINT AS tokens FROM tok GROUP BY s HAVING sum(n_tokens) > 0),
tot AS (SELECT sum(tokens)::BIGINT AS total, count(*) AS n FROM src),
lists AS (
  SELECT list(ln(tokens / total::DOUBLE)) AS lp, list(tokens::DOUBLE) AS ts, any_value(total)::DOUBLE AS budget, any_value(n) AS n
  FROM src, tot),
{_bisect("even", 0, f"{_entropy('mid')} >= {corpus_pipeline.MIX.evenness} * ln(n::DOUBLE) - 1e-12", "lo")},
{_bisect("near", -1, f"list_max(list_transform(list_zip(lp, ts), lambda z: exp(mid / 1048576.0::DOUBLE * z[1]) / z[2])) / {_power('mid')} * budget <= {corpus_pipeline.MIX.most_epochs}", "hi")},
expo AS (
  SELECT greatest(CASE WHEN {_entropy("1048576")} >= {corpus_pipeline.MIX.evenness} * ln(n::DOUBLE) - 1e-12 THEN 1048576
                       ELSE (SELECT max(lo) FROM even) END, (SELECT min(hi) FROM near)) AS k, lp, budget FROM lists),
plan AS (
  SELECT s, tokens, floor(round(exp(k / 1048576.0::DOUBLE * ln(tokens / total::DOUBLE)) / {_power("k")} * budget, 3))::BIGINT AS quota,
         ceil(tokens / {corpus_pipeline.MIX.block_tokens}.0)::BIGINT AS n_blocks FROM src, tot, expo),
whole AS (SELECT s, quota // tokens AS whole, quota % tokens AS rest, n_blocks FROM plan),
keyed AS (
  SELECT doc_id, source, s, n_tokens, whole, coalesce(rest, 0) AS rest,
         ('0x' || substr(md5('{corpus_pipeline.MIX.seed}|' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT % coalesce(n_blocks, 1) AS block,
         md5('{corpus_pipeline.MIX.seed}|' || whole || '|' || coalesce(doc_id::VARCHAR, '')) AS dk
  FROM tok LEFT JOIN whole USING (s)),
rows_ AS (SELECT *, md5('{corpus_pipeline.MIX.seed}|' || whole || '|' || s || '|' || block) AS bk FROM keyed),
blocks AS (SELECT s, rest, bk, sum(n_tokens) AS t FROM rows_ WHERE rest > 0 GROUP BY ALL),
ends AS (SELECT *, sum(t) OVER (PARTITION BY s ORDER BY bk) AS e FROM blocks),
cut AS (SELECT s, bk AS cut_bk, rest - e + t AS remaining FROM ends WHERE e > rest QUALIFY row_number() OVER (PARTITION BY s ORDER BY bk) = 1),
filled AS (
  SELECT r.s, dk, remaining, sum(n_tokens) OVER (PARTITION BY r.s ORDER BY dk) AS e
  FROM rows_ r JOIN cut ON r.s = cut.s AND r.bk = cut_bk),
last AS (SELECT s, max(dk) AS cut_dk FROM filled WHERE e <= remaining GROUP BY s),
copies AS (
  SELECT r.*, CASE WHEN whole IS NULL THEN 1
    ELSE whole + (rest > 0 AND (bk < cut_bk OR bk = cut_bk AND coalesce(dk <= cut_dk, false)))::BIGINT END AS n
  FROM rows_ r LEFT JOIN cut USING (s) LEFT JOIN last USING (s))
SELECT doc_id, source, unnest(range(n))::INTEGER AS epoch, block, n_tokens FROM copies
"""
)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the mix draws, by epoch."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.draws(docs, corpus_pipeline.MIX).select("doc_id", "source", "epoch", "block", "n_tokens")


#: The draw of op11.
DRAW = resample.Draw()
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    rf"""
WITH crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT r, w, count(*) AS n FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY ALL),
bw AS (SELECT w, count(*) AS n FROM (SELECT unnest(ws) AS w FROM b) GROUP BY ALL),
bytes AS (
  SELECT w, list_transform(range(0, len(x), 2), lambda i: ('0x' || substr(x, (i + 1)::BIGINT, 2))::BIGINT) AS bs
  FROM (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw))),
bucket AS (
  SELECT w, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], bs),
    lambda c, y: xor(c >> 8, t[xor(c & 255, y) + 1]))) % {DRAW.buckets} AS k FROM bytes, crc),
s AS (SELECT k, sum(n)::BIGINT AS s FROM dw JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, sum(n)::BIGINT AS t FROM bw JOIN bucket USING (w) GROUP BY k),
tot AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::BIGINT AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::BIGINT AS big_t),
gain AS (
  SELECT k, floor({DRAW.scale} * ln(((coalesce(t, 0) + 1) * (big_s + {DRAW.buckets}))::DOUBLE
                                 / ((coalesce(s, 0) + 1) * (big_t + {DRAW.buckets}))::DOUBLE))::BIGINT AS g
  FROM s FULL JOIN t USING (k), tot),
weight AS (SELECT r, sum(n * g)::BIGINT AS w FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws)::BIGINT AS n_features, coalesce(weight.w, 0)::BIGINT AS weight,
         coalesce(weight.w, 0)::BIGINT + floor(-{DRAW.scale}.0::DOUBLE * ln(-ln((
           ('0x' || substr(sha256('{DRAW.seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weight USING (r)),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS rank, count(*) OVER () AS n
  FROM scored WHERE n_features >= {DRAW.fewest_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {DRAW.percent} // 100 THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (r)
"""
)
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight for the benchmark's distribution, and the rank of those that are drawn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = resample.resample(docs, table(spark, sf_dir, "benchmark"), DRAW)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@query()
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the four leading whitened components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query()
def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by word counts and by the recurrent model."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)
