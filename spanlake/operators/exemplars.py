"""Exemplar sentences of clusters and the prompts made from them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.functions.text import hash_order

#: Parts of a group that are cut down before they meet.
SALTS = 32


def members_with_text(assign: DataFrame, sentences: DataFrame, key: str = "global_idx") -> DataFrame:
    """Assignments with the text of their sentence, by key."""
    return assign.join(sentences.select(key, "text"), key)


def _members(assign: DataFrame) -> DataFrame:
    return assign.filter(F.col("latent_id") >= 0)


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each group with their ``rank``, in two levels: by salt, then by group. Each task keeps ``n``
    rows per group and salt before the first shuffle, and the second brings at most ``SALTS`` times ``n`` rows of a group
    together, however many tasks there were."""
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS))
    some = Window.partitionBy(*by, "_salt").orderBy(*order)
    salted = df.withColumn("_salt", salt).withColumn("rank", F.row_number().over(some)).filter(F.col("rank") <= n)
    every = Window.partitionBy(*by).orderBy(*order)
    return salted.drop("_salt").withColumn("rank", F.row_number().over(every)).filter(F.col("rank") <= n)


def top_exemplars(assign: DataFrame, n: int, by: Sequence[str] = ("latent_id",), key: str = "global_idx") -> DataFrame:
    """The ``n`` strongest members of each latent, equal strengths by lower key."""
    return _first(_members(assign), by, [F.col("strength").desc(), key], key, n)


def random_exemplars(
    assign: DataFrame,
    n_top: int,
    n_random: int,
    seed: int = 0,
    by: Sequence[str] = ("latent_id",),
    key: str = "global_idx",
) -> DataFrame:
    """``n_random`` members of each latent outside its top ``n_top``, chosen by seed, latent and key.

    The first ``n_top + n_random`` members in hash order hold at least ``n_random`` members outside the top, or
    all of them; so a bounded number of rows per latent is enough to choose from, whatever the size of the
    cluster, and the choice equals the one over the whole rest.
    """
    h = hash_order(seed, *[F.col(c) for c in by], F.col(key))
    order = Window.partitionBy(*by).orderBy("_h", key)
    pool = _first(_members(assign).withColumn("_h", h), by, ["_h", key], key, n_top + n_random).drop("rank")
    top = top_exemplars(assign, n_top, by, key).select(*by, key)
    rest = pool.join(top, [*by, key], "left_anti")
    return rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_random).drop("_h")


def exemplars(
    assign: DataFrame,
    n_top: int = 100,
    n_random: int = 100,
    seed: int = 0,
    by: Sequence[str] = ("latent_id",),
    key: str = "global_idx",
) -> DataFrame:
    """Top and random members of each latent, told apart by ``kind``; ``rank`` counts within the kind."""
    cols = [*by, key, "strength", "rank"]
    top = top_exemplars(assign, n_top, by, key).select(*cols).withColumn("kind", F.lit("top"))
    rest = random_exemplars(assign, n_top, n_random, seed, by, key).select(*cols).withColumn("kind", F.lit("random"))
    return top.unionByName(rest)


@dataclass(frozen=True)
class PromptTemplate:
    """What a judge is told: the system message, the question before the numbered sentences, and the form of the answer."""

    system: str | None = "You read numbered sentences and say in JSON what they share."
    question: str = "What do these sentences share?"
    answer: str = 'Reply with {"title": "...", "description": "..."}.'


def build_prompts(
    chosen: DataFrame, sizes: DataFrame, by: Sequence[str] = ("latent_id",), template: PromptTemplate = PromptTemplate()
) -> DataFrame:
    """``by, cluster_size, n_exemplars_used, prompt`` for every latent in ``sizes``; no prompt for an empty one.

    ``chosen`` holds the exemplars with their text, a bounded number per latent.
    """
    is_top = F.col("kind") == "top"
    line = F.struct(
        F.when(is_top, 0).otherwise(1).alias("part"),
        F.col("rank").alias("rank"),
        F.when(is_top, fixed.TOP_TAG).otherwise(fixed.RANDOM_TAG).alias("tag"),
        F.col("text").alias("text"),
    )
    grouped = chosen.groupBy(*by).agg(
        F.array_sort(F.collect_list(line)).alias("_lines"),
        F.count_if(is_top).alias("_n_top"),
        F.count_if(~is_top).alias("_n_random"),
    )
    numbered = F.array_join(
        F.transform(
            "_lines", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["tag"], F.lit(" "), e["text"])
        ),
        "\n",
    )
    counts = F.concat(
        F.lit("("), F.col("_n_top").cast("string"), F.lit(" strongest, "), F.col("_n_random").cast("string"), F.lit(" random)")
    )
    prompt = F.concat_ws("\n\n", F.concat_ws(" ", F.lit(template.question), counts), numbered, F.lit(template.answer))
    used = (F.col("_n_top") + F.col("_n_random")).cast("int")
    made = grouped.select(*by, used.alias("n_exemplars_used"), prompt.alias("prompt"))
    return sizes.join(made, list(by), "left").select(
        *by, "cluster_size", F.coalesce("n_exemplars_used", F.lit(0)).alias("n_exemplars_used"), "prompt"
    )
