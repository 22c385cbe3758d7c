"""Queries over probe examples and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.operators import fitting, latent_blocks, probes
from spanlake.plans import sql_parts as sp
from spanlake.plans import training
from spanlake.plans.catalog import query, r4, sql_r4, table
from spanlake.plans.vector_queries import dictionary
from spanlake.session import scratch_dir
from spanlake.sources import runs


@query(
    "A14",
    f"""SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS n_label_1, count(*) FILTER (toxic = 0) AS n_label_0,
       {sql_r4('avg(toxic)')} AS rate FROM labels""",
)
def label_summary(spark, sf):
    s = probes.label_summary(table(spark, sf, "labels"), "toxic")
    return s.select("n", "n_label_1", "n_label_0", r4("rate").alias("rate"))


@query(
    "A15",
    """SELECT coalesce(bool_and(coalesce(toxic IN (0, 1), false)) AND count(DISTINCT toxic) = 2, false) AS valid
FROM labels JOIN documents USING (doc_id)""",
)
def labels_valid(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return probes.labels_valid(rows, "toxic")


_ACTS = """
act AS (
  SELECT ['mha', 'mlp', 'residual'][1 + label % 3] AS family, label AS layer,
         CASE WHEN label % 3 = 0 THEN vec_id::INTEGER % 2 END AS head, vec_id AS example_id, embedding FROM embeddings),
data AS (SELECT act.*, quality AS label FROM act JOIN labels ON doc_id = example_id)"""


def _acts(spark, sf) -> DataFrame:
    """Vectors by family and layer, both from the label; only one family has heads."""
    kind = F.col("label") % 3
    family = F.when(kind == 0, "mha").when(kind == 1, "mlp").otherwise("residual")
    return table(spark, sf, "embeddings").select(
        family.alias("family"),
        F.col("label").alias("layer"),
        F.when(kind == 0, (F.col("vec_id") % 2).cast("int")).alias("head"),
        F.col("vec_id").alias("example_id"),
        F.col("embedding").alias("vector"),
    )


def _labels(spark, sf, col: str = "quality") -> DataFrame:
    return table(spark, sf, "labels").select(F.col("doc_id").alias("example_id"), F.col(col).alias("label"))


@query("J11", "WITH " + _ACTS + f" SELECT family, layer, head, example_id, label, {sql_r4('embedding[1]::DOUBLE')} AS first_value FROM data")
def probe_examples(spark, sf):
    rows = probes.probe_dataset(_acts(spark, sf), _labels(spark, sf))
    return rows.select("family", "layer", "head", "example_id", "label", r4(F.get("vector", F.lit(0)).cast("double")).alias("first_value"))


_PROBES = (
    "WITH "
    + _ACTS
    + """,
ex AS (SELECT example_id, row_number() OVER (ORDER BY md5('0|' || example_id)) AS r FROM (SELECT DISTINCT example_id FROM data)),
held AS (SELECT example_id, r <= greatest(1, (count(*) OVER () * 2) // 10) AS is_val FROM ex),
cell AS (
  SELECT family, layer, coalesce(head, -1) AS head, example_id, label AS y, is_val,
         unnest(list_append(embedding::DOUBLE[], 1.0)) AS x, generate_subscripts(list_append(embedding, 1), 1) AS dim
  FROM data JOIN held USING (example_id)),
g1 AS (SELECT family, layer, head, dim, avg((0.5 - y) * x) AS g FROM cell WHERE NOT is_val GROUP BY ALL),
w1 AS (SELECT family, layer, head, dim, g, -0.02 * g / (abs(g) + 1e-8) AS w FROM g1),
p1 AS (
  SELECT family, layer, head, example_id, 1 / (1 + exp(-sum(w * x))) AS p
  FROM cell JOIN w1 USING (family, layer, head, dim) WHERE NOT is_val GROUP BY ALL),
g2 AS (
  SELECT family, layer, head, dim, avg((p - y) * x) AS h
  FROM cell JOIN p1 USING (family, layer, head, example_id) WHERE NOT is_val GROUP BY ALL),
w2 AS (
  SELECT family, layer, head, dim,
         w - 0.02 * ((0.09 * g + 0.1 * h) / 0.19) / (sqrt((0.000999 * g * g + 0.001 * h * h) / (1 - 0.999 ** 2)) + 1e-8) AS w
  FROM w1 JOIN g2 USING (family, layer, head, dim)),
hit AS (
  SELECT family, layer, head, example_id, ((sum(w * x) > 0)::INTEGER = any_value(y))::INTEGER AS ok
  FROM cell JOIN w2 USING (family, layer, head, dim) WHERE is_val GROUP BY ALL),
acc AS (SELECT family, layer, head, count(*) AS n, avg(ok) AS a, 1.959963984540054 AS z FROM hit GROUP BY ALL)"""
)


_FIT_SQL = (
    _PROBES
    + f"""
SELECT family, layer, nullif(head, -1) AS head, n AS n_val, {sql_r4('a')} AS accuracy,
       {sql_r4('(a + z * z / (2 * n) - z * sqrt(a * (1 - a) / n + z * z / (4 * n * n))) / (1 + z * z / n)')} AS ci_low,
       {sql_r4('(a + z * z / (2 * n) + z * sqrt(a * (1 - a) / n + z * z / (4 * n * n))) / (1 + z * z / n)')} AS ci_high
FROM acc"""
)


@query("M2 J11", _FIT_SQL)
def probe_fit(spark, sf):
    """Probes of all families, layers and heads after two steps; more steps are compared with NumPy in the tests."""
    return _probe_rows(spark, sf, probes.MAX_WAVE_BYTES)


@query("M2", _FIT_SQL)
def probe_fit_in_waves(spark, sf):
    """The same probes, of which no more than a few are fitted at a time."""
    return _probe_rows(spark, sf, 10_000)


def _probe_rows(spark, sf, most: int) -> DataFrame:
    rows = probes.probe_dataset(_acts(spark, sf), _labels(spark, sf))
    fitted = probes.fit_probes(rows, probes.ProbeConfig(steps=2), most)
    return fitted.select("family", "layer", "head", "n_val", *[r4(c).alias(c) for c in ("accuracy", "ci_low", "ci_high")])


@query(
    "A16",
    "WITH "
    + _ACTS
    + f""",
res AS (SELECT family, layer, avg(label) AS accuracy FROM data GROUP BY family, layer),
fam AS (SELECT unnest(['mha', 'mlp', 'residual']) AS family)
SELECT fam.family, {sql_r4('coalesce(max(accuracy), 0.0)')} AS best_accuracy,
       first(layer ORDER BY accuracy DESC, layer) AS best_layer, count(layer) AS n_probes
FROM fam LEFT JOIN res USING (family) GROUP BY fam.family""",
)
def best_probes(spark, sf):
    rows = probes.probe_dataset(_acts(spark, sf), _labels(spark, sf))
    results = rows.groupBy("family", "layer").agg(F.avg("label").alias("accuracy"))
    best = probes.best_probe(results)
    return best.select("family", r4("best_accuracy").alias("best_accuracy"), "best_layer", "n_probes")


_RATES = """
rate AS (SELECT lang AS model, doc_id % 2 AS half, avg(quality) AS quality, avg(toxic) AS toxic
         FROM documents JOIN labels USING (doc_id) GROUP BY ALL),
value_ AS (UNPIVOT rate ON quality, toxic INTO NAME metric VALUE value),
ours AS (SELECT model, metric, value FROM value_ WHERE half = 0),
paper AS (SELECT model, metric, value FROM value_ WHERE half = 1 AND NOT (model = 'en' AND metric = 'toxic'))"""


def rates_by_half(spark, sf) -> DataFrame:
    """Label rates per language for two halves of the documents: our numbers and the ones to compare with."""
    langs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("model"))
    rows = langs.join(table(spark, sf, "labels"), "doc_id")
    half = (F.col("doc_id") % 2).alias("half")
    return rows.groupBy("model", half).agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"))


@query(
    "J9",
    "WITH "
    + _RATES
    + f"""
SELECT model, metric, {sql_r4('o.value')} AS ours, {sql_r4('p.value')} AS paper, {sql_r4('o.value - p.value')} AS delta,
       CASE WHEN p.value IS NULL THEN 'NO PAPER REF' WHEN abs(o.value - p.value) <= 0.02 THEN 'VERIFIED'
            ELSE printf('%+.3f', round(o.value - p.value, 3)) END AS verdict
FROM ours o LEFT JOIN paper p USING (model, metric)""",
)
def compared_results(spark, sf):
    values = rates_by_half(spark, sf).unpivot(["model", "half"], ["quality", "toxic"], "metric", "value")
    ours = values.filter("half = 0").drop("half")
    paper = values.filter("half = 1 and not (model = 'en' and metric = 'toxic')").drop("half")
    out = probes.compare_results(ours, paper)
    return out.select("model", "metric", *[r4(c).alias(c) for c in ("ours", "paper", "delta")], "verdict")


def _codes(tag: str, k: int, only: str) -> str:
    """CTEs ``code_<tag>`` and ``off_<tag>``: codes of the ``only`` rows under the parameters ``<tag>`` and the residuals."""
    return f"""
zp_{tag} AS (
  SELECT vec_id, latent_id, sum((x - b) * w) + any_value(be) AS z
  FROM cell JOIN enc_{tag} USING (dim) JOIN bd_{tag} USING (dim) JOIN be_{tag} USING (latent_id) WHERE {only} GROUP BY vec_id, latent_id),
code_{tag} AS (
  SELECT vec_id, latent_id, z FROM zp_{tag} WHERE z > 0 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, latent_id) <= {k}),
hat_{tag} AS (SELECT vec_id, dim, sum(z * w) AS h FROM code_{tag} JOIN dec_{tag} USING (latent_id) GROUP BY vec_id, dim),
off_{tag} AS (
  SELECT vec_id, dim, x, coalesce(h, 0.0) + b - x AS o
  FROM cell JOIN bd_{tag} USING (dim) LEFT JOIN hat_{tag} USING (vec_id, dim) WHERE {only})"""


def _gradient(tag: str, k: int) -> str:
    """CTEs of the mean gradients ``g<name>_<tag>`` of the four parameters over the training rows."""
    return _codes(tag, k, "NOT is_val") + f""",
n_{tag} AS (SELECT count(*)::DOUBLE AS n FROM off_{tag}),
dz_{tag} AS (
  SELECT c.vec_id, c.latent_id, any_value(c.z) AS z, sum(2 * o * w) AS dz
  FROM code_{tag} c JOIN off_{tag} f USING (vec_id) JOIN dec_{tag} d ON d.latent_id = c.latent_id AND d.dim = f.dim GROUP BY ALL),
raw_{tag} AS (
  SELECT latent_id, dim, sum(dz * (x - b)) AS ge, sum(z * 2 * o) AS gd
  FROM dz_{tag} JOIN off_{tag} USING (vec_id) JOIN bd_{tag} USING (dim) GROUP BY latent_id, dim),
sb_{tag} AS (SELECT latent_id, sum(dz) AS s FROM dz_{tag} GROUP BY latent_id),
genc_{tag} AS (SELECT latent_id, dim, coalesce(ge, 0) / n AS g FROM enc_{tag} LEFT JOIN raw_{tag} USING (latent_id, dim), n_{tag}),
gdec_{tag} AS (SELECT latent_id, dim, coalesce(gd, 0) / n AS g FROM enc_{tag} LEFT JOIN raw_{tag} USING (latent_id, dim), n_{tag}),
gbe_{tag} AS (SELECT latent_id, coalesce(s, 0) / n AS g FROM be_{tag} LEFT JOIN sb_{tag} USING (latent_id), n_{tag}),
gbd_{tag} AS (
  SELECT dim, (total - coalesce(pulled, 0)) / n AS g
  FROM (SELECT dim, sum(2 * o) AS total FROM off_{tag} GROUP BY dim)
  LEFT JOIN (SELECT dim, sum(s * w) AS pulled FROM sb_{tag} JOIN enc_{tag} USING (latent_id) GROUP BY dim) USING (dim), n_{tag})"""


_KEYS = {"enc": ("latent_id, dim", "w"), "dec": ("latent_id, dim", "w"), "be": ("latent_id", "be"), "bd": ("dim", "b")}


def _moved(tag: str, to: str, before: str | None) -> str:
    """CTEs of the parameters ``to`` after the Adam step from ``tag``; ``before`` names those of the step before it."""
    out = []
    for name, (keys, value) in _KEYS.items():
        if before is None:
            move, old = f"{_LR} * g / (abs(g) + 1e-8)", ""
        else:
            move = f"{_LR} * ((0.09 * g0 + 0.1 * g) / 0.19) / (sqrt((0.000999 * g0 * g0 + 0.001 * g * g) / (1 - 0.999 ** 2)) + 1e-8)"
            old = f" JOIN (SELECT {keys}, g AS g0 FROM g{name}_{before}) USING ({keys})"
        raw = f"SELECT {keys}, {value} - {move} AS {value} FROM {name}_{tag} JOIN g{name}_{tag} USING ({keys}){old}"
        if name == "dec":  # unit length
            raw = f"SELECT latent_id, dim, w / greatest(sqrt(sum(w * w) OVER (PARTITION BY latent_id)), 1e-8) AS w FROM ({raw})"
        out.append(f"\n{name}_{to} AS ({raw})")
    return ",".join(out)


_LR = 0.01


def _fit_sql(k: int) -> str:
    """CTEs ending in ``loss(epoch, val_loss)``: two steps over all training rows from the label dictionary."""
    return (
        "WITH "
        + sp.DICTIONARY
        + """,
split AS (
  SELECT vec_id, row_number() OVER (ORDER BY md5('0|' || vec_id)) <= greatest(1, (count(*) OVER () * 5) // 100) AS is_val
  FROM embeddings),
cell AS (SELECT vec_id, dim, x, is_val FROM long JOIN split USING (vec_id)),
enc_a AS (SELECT latent_id, dim, w FROM dict), dec_a AS (SELECT latent_id, dim, w FROM dict),
be_a AS (SELECT DISTINCT latent_id, 0.0::DOUBLE AS be FROM dict), bd_a AS (SELECT DISTINCT dim, 0.0::DOUBLE AS b FROM dict),"""
        + _gradient("a", k)
        + ","
        + _moved("a", "b", None)
        + ","
        + _gradient("b", k)
        + ","
        + _moved("b", "c", "a")
        + "".join(
            f""",
enc_v{t} AS (FROM enc_{t}), dec_v{t} AS (FROM dec_{t}), be_v{t} AS (FROM be_{t}), bd_v{t} AS (FROM bd_{t}),"""
            + _codes(f"v{t}", k, "is_val")
            for t in "bc"
        )
        + """,
loss AS (SELECT 1 AS epoch, avg(o * o) AS val_loss FROM off_vb UNION ALL SELECT 2, avg(o * o) FROM off_vc)"""
    )


def _given_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("global_idx"), F.col("embedding").alias("vector"))


def _two_steps(k: int, n: int) -> fitting.FitConfig:
    return fitting.FitConfig(n_latents=n, k=k, steps=1, max_epochs=2, lr=_LR)


_LOSSES = _fit_sql(3) + f" SELECT epoch, {sql_r4('val_loss * 1000')} AS val_loss_milli FROM loss"


@query("M1", _LOSSES)
def sae_fit(spark, sf):
    """Losses of a fit of all given vectors that starts at the label dictionary; longer fits are compared with NumPy in
    the tests."""
    start = dictionary(spark, sf)
    fit = fitting.fit_topk_sae(_given_vectors(spark, sf), _two_steps(3, start.n_latents), start=start)
    return _losses(spark, fit)


@query("M1", _LOSSES)
def sae_fit_in_blocks(spark, sf):
    """The same fit where no process may hold more than four latents with their state."""
    start = dictionary(spark, sf)
    most = 4 * 8 * latent_blocks.FIT_COPIES * start.d_in
    fit = fitting.fit_topk_sae(_given_vectors(spark, sf), _two_steps(3, start.n_latents), start=start, max_bytes=most)
    fit.params.close()
    return _losses(spark, fit)


def _losses(spark, fit: fitting.FitResult) -> DataFrame:
    rows = [(h["epoch"], float(h["val_loss"])) for h in fit.history]
    losses = spark.createDataFrame(rows, "epoch int, val_loss double")
    return losses.select("epoch", r4(F.col("val_loss") * 1000).alias("val_loss_milli"))


@query(
    "M3 M1 S9",
    " UNION ALL ".join(
        f"SELECT * FROM ({_fit_sql(k)} SELECT {k} AS k, {sql_r4('min(val_loss) * 1000')} AS best_loss_milli, 2 AS n_epochs_trained FROM loss)"
        for k in (1, 2, 4)
    ),
)
def sae_sweep(spark, sf):
    """A sweep over the number of active latents, read back from the runs it wrote."""
    folder, start = scratch_dir(spark), dictionary(spark, sf)
    grid = [_two_steps(k, start.n_latents) for k in (1, 2, 4)]
    training.sweep(_given_vectors(spark, sf), 18, grid, folder, start=start)
    config, measured = (runs.read_run_table(spark, folder, name) for name in ("config", "metrics"))
    loss = r4(F.col("final_recon_loss") * 1000).alias("best_loss_milli")
    return measured.join(config.select("run", "k"), "run").select("k", loss, "n_epochs_trained")
