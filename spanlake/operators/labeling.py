"""Labels for clusters through a user-supplied judge."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake import fixed
from spanlake.functions.replies import check_label, first_json_object


def is_transient(error: Exception) -> bool:
    """Server and connection errors may pass; client errors (status 4xx) and all others do not."""
    status = getattr(error, "status_code", None)
    if status is not None:
        return not 400 <= status < 500
    return isinstance(error, (ConnectionError, TimeoutError))


def call_with_retry(call: Callable[[], str], attempts: int, pause: Callable[[float], None] = time.sleep) -> str:
    """``call()``, tried again after 1, 2, 4, … seconds while its errors are transient."""
    for attempt in range(attempts):
        try:
            return call()
        except Exception as error:
            if not is_transient(error):
                raise
            last = error
            if attempt + 1 < attempts:
                pause(2**attempt)
    raise last


def finished(labels: DataFrame) -> DataFrame:
    """Labels that a rerun keeps."""
    return labels.filter(F.col("status").isin(fixed.STATUS_OK, fixed.STATUS_EMPTY))


def pending(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are not done yet."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def progress(every: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """One row: keys in all, done, remaining, complete."""
    marked = every.select(key).distinct().join(
        done.select(key).distinct().withColumn("_done", F.lit(True)), key, "left"
    )
    counts = marked.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col("_done")).alias("n_done"))
    return counts.withColumn("n_remaining", F.col("n_total") - F.col("n_done")).withColumn(
        "complete", F.col("n_remaining") == 0
    )


#: The fields that an answer fills; without exemplars nobody is asked.
_OUTCOME = ("title", "description", "status", "error")
_NOT_ASKED = (None, None, fixed.STATUS_EMPTY, None)


def outcome_of(ask: Callable[[], str]) -> tuple[str | None, str | None, str, str | None]:
    """Title, description, status and error of one reply, or of the failure to get or to read it."""
    try:
        return (*check_label(first_json_object(ask())), fixed.STATUS_OK, None)
    except Exception as problem:
        return None, None, fixed.STATUS_ERROR, f"{type(problem).__name__}: {problem}"


def label_clusters(
    prompts: DataFrame,
    judge_fn: Callable[..., str],
    judge_model: str,
    existing: DataFrame | None = None,
    force: bool = False,
    attempts: int = 3,
    by: Sequence[str] = ("latent_id",),
    parallelism: int | None = None,
    system: str | None = None,
) -> DataFrame:
    """A label record per latent.

    Latents without exemplars are recorded without a call; a failing call or reply becomes a record with
    status ``error`` and leaves the others alone; labels that are finished in ``existing`` are taken over as
    they are unless ``force``. ``judge_fn`` gets the prompt, and the system message as a second argument when there
    is one, and returns the reply.

    ``parallelism`` is the number of tasks that call the judge, as many as the session has cores by default.
    Write the result before using it twice: each evaluation calls the judge.
    """
    names = [*by, *[f for f in _RECORD if f not in by]]
    todo = prompts
    kept = None
    if existing is not None and not force:
        kept = finished(existing)
        todo = pending(prompts, kept, by)
    todo = todo.repartition(parallelism or prompts.sparkSession.sparkContext.defaultParallelism, *by)
    extra = () if system is None else (system,)
    schema = T.StructType(
        [T.StructField(k, prompts.schema[k].dataType) for k in by]
        + [T.StructField(n, t) for n, t in _RECORD.items() if n not in by]
    )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            asks = (partial(call_with_retry, partial(judge_fn, prompt, *extra), attempts) for prompt in frame["prompt"])
            answers = [outcome_of(ask) if used else _NOT_ASKED for ask, used in zip(asks, frame["n_exemplars_used"])]
            found = pd.DataFrame(answers, columns=list(_OUTCOME), dtype=object, index=frame.index)
            yield frame.assign(judge_model=judge_model).join(found)[names]

    made = todo.mapInPandas(run, schema)
    return made if kept is None else kept.select(*names).unionByName(made)


_RECORD = {
    "cluster_size": T.LongType(),
    "n_exemplars_used": T.IntegerType(),
    "judge_model": T.StringType(),
    "title": T.StringType(),
    "description": T.StringType(),
    "status": T.StringType(),
    "error": T.StringType(),
}
