"""Prompt tables: melt, combine, replicate, render, look up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.functions import text


def melt_prompts(df: DataFrame, dataset: str | Column, id_col: str, prompt_cols: Sequence[str]) -> DataFrame:
    """One row per (row, prompt column) with text; null and blank cells are dropped, texts are trimmed.

    ``dataset`` is a name, or a column that holds it.
    """
    wide = df.select(
        (F.lit(dataset) if isinstance(dataset, str) else dataset).alias("dataset"),
        F.col(id_col).cast("string").alias("row_id"),
        *[F.col(c).cast("string").alias(c) for c in prompt_cols],
    )
    long = wide.unpivot(["dataset", "row_id"], list(prompt_cols), "prompt_col", "text")
    kept = long.filter(~text.is_blank(F.col("text")))
    return kept.withColumn("text", text.strip(F.col("text")))


def all_prompts(frames: Sequence[DataFrame]) -> DataFrame:
    """Prompts of several sources in one table."""
    return reduce(DataFrame.unionByName, frames)


def replicate(df: DataFrame, n: int) -> DataFrame:
    """Each prompt ``n`` times, told apart by ``sample_idx``."""
    return df.withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))) if n > 0 else df.withColumn(
        "sample_idx", F.lit(0)
    ).limit(0)


def with_response_id(df: DataFrame) -> DataFrame:
    """Adds the response id built from dataset, row, prompt column and sample."""
    parts = [F.col(c) for c in ("dataset", "row_id", "prompt_col", "sample_idx")]
    return df.withColumn("response_id", text.response_id(*parts))


@dataclass(frozen=True)
class ChatTemplate:
    """How turns are written. ``generation`` opens the reply."""

    system: str = "<|system|>\n{}\n"
    user: str = "<|user|>\n{}\n"
    generation: str = "<|assistant|>\n"

    def _turn(self, pattern: str, body: Column) -> Column:
        before, after = pattern.split("{}")
        return F.concat(F.lit(before), body, F.lit(after))

    def prefix(self, user: Column, system: Column | None = None) -> Column:
        """System message (when there is one), user message, opening of the reply."""
        parts = [self._turn(self.user, user), F.lit(self.generation)]
        if system is not None:
            parts.insert(0, F.when(system != "", self._turn(self.system, system)).otherwise(""))
            parts[0] = F.coalesce(parts[0], F.lit(""))
        return F.concat(*parts)


def render_chat(
    df: DataFrame,
    template: ChatTemplate,
    user_col: str = "prompt",
    system_col: str | None = None,
    response_col: str | None = None,
) -> DataFrame:
    """Adds ``chat_prefix`` and, when there is a response, ``full_text`` = prefix + response."""
    system = F.col(system_col) if system_col else None
    out = df.withColumn("chat_prefix", template.prefix(F.col(user_col), system))
    if response_col:
        out = out.withColumn("full_text", F.concat("chat_prefix", F.coalesce(F.col(response_col), F.lit(""))))
    return out


def attach_text(df: DataFrame, generations: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds ``prompt`` and ``response`` by response id (null for an unknown one); of a repeated id the last in ``order`` counts.

    Repeated ids are reduced by an aggregate, which combines before the shuffle, so they cannot pile up.
    """
    last = generations.groupBy("response_id").agg(
        F.max_by(F.struct("prompt", "response"), F.struct(*order)).alias("_t")
    )
    return df.join(last, "response_id", "left").select(df["*"], "_t.prompt", "_t.response")


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """User turns with the assistant turn that follows, joined on conversation and turn number."""
    user = conversations.filter(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("prompt"), (F.col("turn") + 1).alias("_next")
    )
    reply = conversations.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_conv"), F.col("turn").alias("_turn"), F.col("text").alias("response")
    )
    return user.join(reply, (F.col("conv_id") == F.col("_conv")) & (F.col("_next") == F.col("_turn"))).select(
        "conv_id", "turn", "prompt", "response"
    )


def expand_challenges(questions: DataFrame, challenges: Mapping[str, str] | None = None) -> DataFrame:
    """Each question once per challenge type, the wrong answer put into the message that asks for it.

    The few challenges are a constant array of the row, so this is an explode and not a join.
    """
    items = (challenges or fixed.CHALLENGES).items()
    pairs = F.array(*[F.struct(F.lit(k).alias("disagree_type"), F.lit(v).alias("_m")) for k, v in items])
    out = questions.select("*", F.inline(pairs))
    message = F.replace(F.col("_m"), F.lit("{incorrect_answer}"), F.col("incorrect_answer"))
    needs = F.contains(F.col("_m"), F.lit("{incorrect_answer}"))
    return out.withColumn("follow_up", F.when(needs, message).otherwise(F.col("_m"))).drop("_m")
