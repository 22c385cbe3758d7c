"""Declared schemas of the tables that the operators exchange."""

from pyspark.sql import types as T

STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
FLOAT, DOUBLE, BOOLEAN = T.FloatType(), T.DoubleType(), T.BooleanType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])

PROMPT = _struct(
    dataset=STRING, row_id=STRING, prompt_col=STRING, text=STRING,
)

GENERATION = _struct(
    dataset=STRING, row_id=STRING, prompt_col=STRING, prompt=STRING, sample_idx=INT, response=STRING,
    model=STRING,
)

SENTENCE = _struct(
    response_id=STRING, dataset=STRING, row_id=STRING, prompt_col=STRING, sample_idx=INT, sent_idx=LONG,
    text=STRING, char_start=LONG, char_end=LONG, tok_start=LONG, tok_end=LONG, n_tokens=LONG,
    global_idx=LONG, response_idx=LONG,
)

RESPONSE = _struct(
    response_idx=LONG, response_id=STRING, dataset=STRING, row_id=STRING, prompt_col=STRING, sample_idx=INT,
    model=STRING, n_sentences=LONG, n_tokens_full_text=LONG, resp_tok_start=LONG, resp_tok_end=LONG,
)

SKIP = _struct(
    response_id=STRING, reason=STRING, detail=STRING,
)

TOKEN_VECTOR = _struct(
    response_id=STRING, layer=INT, tok_idx=LONG, vector=T.ArrayType(FLOAT),
)

ACTIVATION = _struct(
    layer=INT, global_idx=LONG, vector=T.ArrayType(FLOAT),
)

SAE_PARAMS = _struct(
    latent_id=INT, w_enc=T.ArrayType(DOUBLE), w_dec=T.ArrayType(DOUBLE), b_enc=DOUBLE,
)

ASSIGNMENT = _struct(
    run=STRING, global_idx=LONG, latent_id=INT, strength=DOUBLE, topk=T.ArrayType(INT),
)

RUN_CONFIG = _struct(
    layer=INT, n_latents=INT, k=INT, centered=BOOLEAN, seed=INT, lr=DOUBLE, batch_size=INT, max_epochs=INT,
    patience=INT, val_frac=DOUBLE, d_in=INT, n_epochs_trained=INT, activations_input_hash=STRING,
    timestamp=STRING,
)

RUN_METRICS = _struct(
    final_recon_loss=DOUBLE, explained_variance=DOUBLE, firing_rate=T.ArrayType(DOUBLE),
    dead_latent_count=INT, mean_l0=DOUBLE, n_epochs_trained=INT, early_stopped=BOOLEAN,
)

LABEL = _struct(
    latent_id=INT, cluster_size=LONG, n_exemplars_used=INT, judge_model=STRING, title=STRING,
    description=STRING, status=STRING, error=STRING,
)

PROBE_EXAMPLE = _struct(
    text=STRING, label=INT, question=STRING, initial_answer=STRING, alternative=STRING, follow_up=STRING,
    disagree_type=STRING, first_correct=BOOLEAN, second_correct=BOOLEAN,
)

PROBE_ACTIVATION = _struct(
    family=STRING, layer=INT, head=INT, example_id=LONG, vector=T.ArrayType(FLOAT),
)

PAPER_RESULTS = T.MapType(
    T.StringType(),
    _struct(
    mha_best_accuracy=DOUBLE, mlp_best_accuracy=DOUBLE, residual_best_accuracy=DOUBLE,
),
)

CODE = "array<struct<latent_id:int,strength:double>>"

#: Digest of a run of lines of a file.
BLOCK_DIGEST = _struct(name=STRING, length=LONG, modified=T.TimestampType(), block=LONG, digest=STRING)
