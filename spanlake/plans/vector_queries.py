"""Queries over vectors: centering, encoding, codes, fit metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.functions import vectors
from spanlake.operators import gates, index, latent_blocks, metrics, pooling, sae
from spanlake.plans import sql_parts as sp
from spanlake.plans.catalog import query, r4, sql_r4, table

K = 3
#: More latents than the dictionary has, so that silent ones occur.
N_LATENTS = 16


def dictionary(spark, sf) -> sae.SaeParams:
    """The dictionary that the SQL twins can build too: a unit-length mean per label."""
    return sae.SaeParams.from_table(sae.centroid_latents(table(spark, sf, "embeddings")))


def coded(spark, sf) -> DataFrame:
    emb = table(spark, sf, "embeddings")
    return sae.encode(emb, dictionary(spark, sf), K, "embedding")


def _entries(df: DataFrame, *keys: str, col: str = "vector") -> DataFrame:
    rows = df.select(*keys, F.posexplode(col).alias("dim", "value"))
    return rows.select(*keys, (F.col("dim") + 1).cast("long").alias("dim"), r4("value").alias("value"))


_DIM = "generate_subscripts(embedding, 1) AS dim"
_LONG = f"long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, {_DIM} FROM embeddings)"


@query("A5", f"WITH {_LONG} SELECT dim, {sql_r4('avg(x)')} AS value FROM long GROUP BY dim")
def global_center(spark, sf):
    return _entries(pooling.global_center(table(spark, sf, "embeddings"), "embedding"), col="center")


@query("A6", f"WITH {_LONG} SELECT label, dim, {sql_r4('avg(x)')} AS value FROM long GROUP BY label, dim")
def mean_per_label(spark, sf):
    return _entries(pooling.mean_vectors(table(spark, sf, "embeddings"), ["label"], "embedding"), "label")


_PLACE = "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1"


@query(
    "A6",
    f"""WITH tv AS (SELECT label, {_PLACE} AS tok_idx, embedding FROM embeddings),
span AS (
  SELECT label, lo AS sent_idx, lo AS tok_start, least(lo + 12, n) AS tok_end
  FROM (SELECT label, count(*) AS n FROM tv GROUP BY label), LATERAL (SELECT unnest(range(0, n, 12)) AS lo)
  UNION ALL SELECT label, -1, 0, count(*) FROM tv GROUP BY label),
long AS (SELECT label, tok_idx, unnest(embedding)::DOUBLE AS x, {_DIM} FROM tv)
SELECT s.label, sent_idx, dim, {sql_r4('avg(x)')} AS value
FROM span s JOIN long t ON t.label = s.label AND t.tok_idx >= s.tok_start AND t.tok_idx < s.tok_end
GROUP BY s.label, sent_idx, dim""",
)
def span_pool_of_members(spark, sf):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    tv = table(spark, sf, "embeddings").select(
        "label", place.cast("long").alias("tok_idx"), F.col("embedding").alias("vector"), F.lit(18).alias("layer")
    )
    sizes = tv.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(12).cast("long")))
    pieces = sizes.select("label", "n", start.alias("tok_start")).select(
        "label", F.col("tok_start").alias("sent_idx"), "tok_start", F.least(F.col("tok_start") + 12, "n").alias("tok_end")
    )
    whole = sizes.select("label", F.lit(-1).cast("long").alias("sent_idx"), F.lit(0).cast("long").alias("tok_start"), F.col("n").alias("tok_end"))
    pooled = pooling.mean_pool(tv, pieces.unionByName(whole), "label", ["sent_idx"])
    return _entries(pooled, "label", "sent_idx")


@query(
    "V1",
    f"""WITH {_LONG}, c AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim)
SELECT vec_id, dim, {sql_r4('x - m')} AS value FROM long JOIN c USING (dim)""",
)
def centered_vectors(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return _entries(sae.center(emb, pooling.global_center(emb)), "vec_id")


@query("V2", "WITH " + sp.CODES + f" SELECT vec_id, latent_id, {sql_r4('z')} AS z_pre FROM zpre")
def preactivations(spark, sf):
    z = sae.preactivations(table(spark, sf, "embeddings"), dictionary(spark, sf), "embedding")
    return z.select("vec_id", F.posexplode("z_pre").alias("latent_id", "z")).select("vec_id", "latent_id", r4("z").alias("z_pre"))


_CENTERED = (
    "WITH "
    + sp.DICTIONARY
    + """,
c AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim),
zpre AS (
  SELECT vec_id, latent_id, sum((x - m) * w) AS z FROM long JOIN c USING (dim) JOIN dict USING (dim) GROUP BY vec_id, latent_id),
code AS (
  SELECT vec_id, latent_id, z AS strength, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent_id) AS rank
  FROM zpre WHERE z > 0 QUALIFY rank <= 3)"""
)


@query("V1 V2 V3", _CENTERED + f" SELECT vec_id, rank::INTEGER AS rank, latent_id, {sql_r4('strength')} AS strength FROM code")
def codes_with_decoder_bias(spark, sf):
    emb = table(spark, sf, "embeddings")
    mean = pooling.global_center(emb, "embedding").first()["center"]
    params = sae.SaeParams.from_table(sae.centroid_latents(emb), mean)
    return _code_rows(sae.encode(emb, params, K, "embedding"))


def _code_rows(df: DataFrame) -> DataFrame:
    rows = df.select("vec_id", F.posexplode("code").alias("rank", "e"))
    return rows.select(
        "vec_id", (F.col("rank") + 1).alias("rank"), F.col("e.latent_id").alias("latent_id"), r4("e.strength").alias("strength")
    )


_CODE_ROWS = "WITH " + sp.CODES + f" SELECT vec_id, rank::INTEGER AS rank, latent_id, {sql_r4('strength')} AS strength FROM code"


@query("V2 V3", _CODE_ROWS)
def topk_codes(spark, sf):
    return _code_rows(coded(spark, sf))


@query("V3", _CODE_ROWS)
def topk_codes_in_blocks(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "embedding")
    params = dictionary(spark, sf)
    block = 4 * params.w_enc.shape[1] * 8  # room for four latents, so several passes are merged
    return _code_rows(sae.encode(emb, params, K, "embedding", max_bytes=block))


def latent_table(spark, sf, latents_at_once: int) -> latent_blocks.LatentTable:
    """The same dictionary, left as a table."""
    latents = sae.centroid_latents(table(spark, sf, "embeddings"))
    width = latents.agg(F.max(F.size("w_enc"))).first()[0]
    return latent_blocks.LatentTable(latents, max_bytes=latents_at_once * 2 * 8 * width)


@query("V2 V3", _CODE_ROWS)
def topk_codes_of_table(spark, sf):
    """The dictionary stays a table of which no process holds more than three latents."""
    return _code_rows(latent_blocks.encode(table(spark, sf, "embeddings"), latent_table(spark, sf, 3), K, ["vec_id"], "embedding"))


@query("V3", _CODE_ROWS)
def topk_mask_of_arrays(spark, sf):
    z = sae.preactivations(table(spark, sf, "embeddings"), dictionary(spark, sf), "embedding")
    return _code_rows(z.withColumn("code", sae.topk_mask(F.col("z_pre"), K)))


_XHAT = (
    "WITH "
    + sp.CODES
    + """,
hat AS (SELECT vec_id, dim, sum(strength * w) AS h FROM code JOIN dict USING (latent_id) GROUP BY vec_id, dim),
recon AS (SELECT l.vec_id, l.dim, x, coalesce(h, 0.0) AS h FROM long l LEFT JOIN hat USING (vec_id, dim))"""
)


def _decoded(spark, sf) -> DataFrame:
    return sae.decode(coded(spark, sf), dictionary(spark, sf))


@query("V4", _XHAT + f" SELECT vec_id, dim, {sql_r4('h')} AS value FROM recon")
def reconstructions(spark, sf):
    return _entries(_decoded(spark, sf), "vec_id", col="xhat")


@query("V4", _XHAT + f" SELECT vec_id, dim, {sql_r4('h')} AS value FROM recon")
def reconstructions_of_table(spark, sf):
    emb = table(spark, sf, "embeddings")
    return _entries(latent_blocks.coded(emb, latent_table(spark, sf, 4), K, ["vec_id"], "embedding"), "vec_id", col="xhat")


@query(
    "V5",
    f"""WITH {_LONG}, m AS (SELECT label, dim, sum(x) AS s FROM long GROUP BY label, dim)
SELECT label, dim, {sql_r4('s / greatest(sqrt(sum(s * s) OVER (PARTITION BY label)), 1e-8)')} AS value FROM m""",
)
def unit_directions(spark, sf):
    sums = pooling.sum_vectors(table(spark, sf, "embeddings"), ["label"], "embedding").withColumnRenamed("_total", "w_dec")
    return _entries(sae.normalize_decoder(sums), "label", col="w_dec")


@query(
    "V6",
    "WITH "
    + sp.DICTIONARY
    + f""",
ranked AS (
  SELECT label AS latent_id, row_number() OVER (ORDER BY count(*) DESC, label) - 1 AS i FROM embeddings GROUP BY label
  QUALIFY i < 11),
v AS (SELECT i, latent_id, dim, w FROM ranked JOIN dict USING (latent_id))
SELECT a.i::INTEGER AS i, a.latent_id, b.i::INTEGER AS j, {sql_r4('sum(a.w * b.w)')} AS cosine
FROM v a JOIN v b USING (dim) GROUP BY a.i, a.latent_id, b.i""",
)
def cosine_matrix(spark, sf):
    emb = table(spark, sf, "embeddings")
    sizes = emb.groupBy(F.col("label").alias("latent_id")).agg(F.count(F.lit(1)).alias("cluster_size"))
    latents = sae.centroid_latents(emb).join(sizes, "latent_id")
    cos = sae.cosine_matrix(latents, 11, "cluster_size", ["latent_id"])
    return cos.select("i", "latent_id", "j", r4("cosine").alias("cosine"))


@query(
    "V7",
    f"""WITH {_LONG}, b AS (SELECT dim, x AS y FROM long WHERE vec_id = 0)
SELECT vec_id, bool_and(x = y) AS exact_equal, {sql_r4('max(abs(x - y))')} AS max_abs_diff
FROM long JOIN b USING (dim) GROUP BY vec_id""",
)
def difference_to_base(spark, sf):
    emb = table(spark, sf, "embeddings")
    diff = sae.vector_diff(emb, emb.filter("vec_id = 0"), "embedding")
    return diff.select("vec_id", "exact_equal", r4("max_abs_diff").alias("max_abs_diff"))


@query("V8", "WITH " + sp.CODES + f" SELECT vec_id, {sql_r4('z')} AS z_pre FROM zpre WHERE latent_id = 4")
def one_latent(spark, sf):
    z = sae.latent_preact(table(spark, sf, "embeddings"), dictionary(spark, sf), 4, "embedding")
    return z.select("vec_id", r4("z_pre").alias("z_pre"))


@query(
    "W9 W10",
    "WITH "
    + sp.CODES
    + f""",
per AS (
  SELECT vec_id, list(latent_id ORDER BY rank) AS ids, first(latent_id ORDER BY rank) AS top, max(strength) AS s
  FROM code GROUP BY vec_id)
SELECT e.vec_id, coalesce(top, -1) AS latent_id, {sql_r4('coalesce(s, 0.0)')} AS strength,
       array_to_string(list_concat(coalesce(ids, []::INTEGER[]), [-1, -1, -1])[1:3], ',') AS topk
FROM embeddings e LEFT JOIN per USING (vec_id)""",
)
def assignments(spark, sf):
    rows = sae.assignments(coded(spark, sf), K, ["vec_id"])
    return rows.select("vec_id", "latent_id", r4("strength").alias("strength"), F.array_join(F.col("topk").cast("array<string>"), ",").alias("topk"))


@query(
    "W11",
    f"""WITH {_LONG} SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, dim) - 1)::INTEGER AS rank,
       dim, {sql_r4('x')} AS value FROM long QUALIFY rank < 10""",
)
def top_dimensions(spark, sf):
    rows = sae.top_dims(table(spark, sf, "embeddings"), ["vec_id"], "embedding")
    return rows.select("vec_id", "rank", (F.col("dim") + 1).cast("long").alias("dim"), r4("value").alias("value"))


@query(
    "W11 V7",
    f"""WITH {_LONG}, b AS (SELECT dim, x AS y FROM long WHERE vec_id = 0),
d AS (SELECT vec_id, dim, x - y AS v FROM long JOIN b USING (dim))
SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, dim) - 1)::INTEGER AS rank, dim, {sql_r4('v')} AS value
FROM d QUALIFY rank < 10""",
)
def top_differences(spark, sf):
    emb = table(spark, sf, "embeddings")
    base = emb.filter("vec_id = 0").select(F.col("embedding").alias("center"))
    rows = sae.top_dims(sae.center(emb, base, "embedding"), ["vec_id"], "embedding")
    return rows.select("vec_id", "rank", (F.col("dim") + 1).cast("long").alias("dim"), r4("value").alias("value"))


@query(
    "A7",
    _XHAT
    + f""", m AS (SELECT dim, avg(x) AS m FROM long GROUP BY dim)
SELECT {sql_r4('sum((h - x) ** 2)')} AS recon_error, {sql_r4('sum((x - m) ** 2)')} AS total_variance,
       {sql_r4('1 - sum((h - x) ** 2) / sum((x - m) ** 2)')} AS explained_variance FROM recon JOIN m USING (dim)""",
)
def explained_variance(spark, sf):
    ev = metrics.explained_variance(_decoded(spark, sf), "embedding")
    return ev.select(*[r4(c).alias(c) for c in ev.columns])


_SPLIT = """
split AS (
  SELECT vec_id, row_number() OVER (ORDER BY md5('0|' || vec_id)) <= greatest(1, (count(*) OVER () * 5) // 100) AS is_val
  FROM embeddings)"""


@query(
    "A8 W8",
    _XHAT
    + ","
    + _SPLIT
    + f""", e AS (SELECT vec_id, avg((h - x) ** 2) AS e FROM recon GROUP BY vec_id)
SELECT is_val, {sql_r4('avg(e) * 1000')} AS recon_mse_milli, count(*) AS n FROM e JOIN split USING (vec_id) GROUP BY is_val""",
)
def reconstruction_loss(spark, sf):
    split = index.train_val_split(_decoded(spark, sf), 0.05, ["vec_id"])
    mse = metrics.recon_mse(split, "embedding", by="is_val")
    return mse.select("is_val", r4(F.col("recon_mse") * 1000).alias("recon_mse_milli"), "n")


@query(
    "A8",
    _XHAT
    + f""", e AS (SELECT vec_id, avg((h - x) ** 2) AS e FROM recon GROUP BY vec_id)
SELECT label AS run, {sql_r4('min(e) * 1000')} AS best_loss_milli, arg_min(vec_id, e) AS best_epoch, max(vec_id) AS n_epochs_trained
FROM e JOIN embeddings USING (vec_id) GROUP BY label""",
)
def best_loss_per_run(spark, sf):
    err = vectors.squared_distance(F.col("xhat"), F.col("embedding")) / F.size("embedding")
    history = _decoded(spark, sf).select(F.col("label").alias("run"), F.col("vec_id").alias("epoch"), err.alias("val_loss"))
    best = metrics.best_loss(history)
    return best.select("run", r4(F.col("final_recon_loss") * 1000).alias("best_loss_milli"), "best_epoch", "n_epochs_trained")


_FIRED = "fired AS (SELECT latent_id, count(*) AS n FROM code GROUP BY latent_id)"
_EVERY = f"every AS (SELECT range::INTEGER AS latent_id FROM range({N_LATENTS}))"


@query(
    "A9",
    "WITH "
    + sp.CODES
    + f""", {_FIRED}, {_EVERY}
SELECT latent_id, coalesce(n, 0) AS n_fired, {sql_r4('coalesce(n, 0) / (SELECT count(*) FROM embeddings)')} AS firing_rate
FROM every LEFT JOIN fired USING (latent_id)""",
)
def firing_rates(spark, sf):
    rate = metrics.firing_rate(coded(spark, sf), N_LATENTS)
    return rate.select("latent_id", "n_fired", r4("firing_rate").alias("firing_rate"))


@query("A10", "WITH " + sp.CODES + f" SELECT {sql_r4('(SELECT count(*) FROM code) / count(*)')} AS mean_l0 FROM embeddings")
def mean_l0(spark, sf):
    return metrics.mean_l0(coded(spark, sf)).select(r4("mean_l0").alias("mean_l0"))


@query(
    "A11",
    "WITH "
    + sp.CODES
    + f""", {_FIRED}, {_EVERY}, {_SPLIT},
hist AS (SELECT DISTINCT latent_id FROM code JOIN split USING (vec_id) WHERE NOT is_val AND rank = 1)
SELECT latent_id, coalesce(n, 0) = 0 AS silent_now FROM every LEFT JOIN fired USING (latent_id)
WHERE latent_id NOT IN (SELECT latent_id FROM hist)""",
)
def dead_latents(spark, sf):
    codes = coded(spark, sf)
    # the strongest latents of the training rows stand for what fired in training
    train = index.train_val_split(codes, 0.05, ["vec_id"]).filter("not is_val")
    history = train.select(F.get("code", F.lit(0))["latent_id"].alias("latent_id")).filter("latent_id is not null")
    return metrics.dead_latents(history, N_LATENTS, codes)


@query(
    "A12",
    "WITH "
    + sp.ASSIGNED
    + f""", {_EVERY} SELECT latent_id, count(a.global_idx) AS cluster_size
FROM every LEFT JOIN assign a USING (latent_id) GROUP BY latent_id""",
)
def cluster_sizes(spark, sf):
    return metrics.cluster_sizes(sae.assignments(coded(spark, sf), K, ["vec_id"]), N_LATENTS)


@query(
    "Q2",
    f"""WITH {_LONG} SELECT label AS layer, {sql_r4('max(abs(x - round(x, 2))) FILTER (NOT (vec_id % 7 = 0 AND label = 3))')} AS max_abs_diff,
       0 AS only_in_a, count(DISTINCT vec_id) FILTER (vec_id % 7 = 0 AND label = 3) AS only_in_b,
       max(abs(x - round(x, 2))) FILTER (NOT (vec_id % 7 = 0 AND label = 3)) <= 0.01
         AND count(*) FILTER (vec_id % 7 = 0 AND label = 3) = 0 AS passed FROM long GROUP BY label""",
)
def vector_agreement(spark, sf):
    a = table(spark, sf, "embeddings").select(F.col("label").alias("layer"), F.col("vec_id").alias("global_idx"), F.col("embedding").alias("vector"))
    b = a.withColumn("vector", F.transform(vectors.doubles(F.col("vector")), lambda x: F.round(x, 2)))
    got = gates.check_vectors(a.where("not (layer = 3 and global_idx % 7 = 0)"), b)
    return got.select("layer", r4("max_abs_diff").alias("max_abs_diff"), "only_in_a", "only_in_b", "passed")
