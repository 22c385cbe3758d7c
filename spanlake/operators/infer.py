"""The batch surface for models: user functions over lists of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def infer(
    df: DataFrame,
    make_fn: Callable[[], Callable[[list[str]], list[str]]],
    batch_size: int = 8,
    text_col: str = "text",
    out_col: str = "response",
) -> DataFrame:
    """Adds ``out_col``: the trimmed outputs of a user function ``list[str] -> list[str]``, in order.

    ``make_fn`` runs once per task, and only when the task has rows, so that is where a model is loaded. How
    many tasks run is the partitioning of ``df``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = None
        for frame in frames:
            for at in range(0, len(frame), batch_size):
                fn = fn or make_fn()
                part = frame.iloc[at : at + batch_size]
                outputs = fn(part[text_col].tolist())
                if len(outputs) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(outputs)} outputs")
                yield part.assign(**{out_col: [o.strip() for o in outputs]})

    return df.mapInPandas(run, schema)
