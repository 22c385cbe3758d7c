"""From generations to the frozen sentence, response and skip tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.operators import prompts as pr
from spanlake.operators import segment
from spanlake.operators.index import dense_index
from spanlake.schemas import RESPONSE, SENTENCE
from spanlake.session import cut_lineage


@dataclass(frozen=True)
class CorpusTables:
    sentences: DataFrame
    responses: DataFrame
    skips: DataFrame


def tables_of(
    generations: DataFrame,
    template: pr.ChatTemplate = pr.ChatTemplate(),
    max_length: int = fixed.MAX_LENGTH,
    order: tuple[str, ...] | None = None,
    token_col: str | None = None,
    first_sentence: int = 0,
    first_response: int = 0,
) -> CorpusTables:
    """Sentences, responses and skip events of a generation table.

    Cutting and aligning happen inside each row. The only step over the whole table is the numbering: responses
    are numbered once, and a sentence's number is its response's first number plus its place. ``order`` is the
    input order when the rows carry their ``_place``, else the response id; equal ones are numbered as they come.
    ``first_*`` let a later batch go on counting.
    """
    order = order or (("_place",) if "_place" in generations.columns else ("response_id",))
    named = generations if "response_id" in generations.columns else pr.with_response_id(generations)
    chat = pr.render_chat(named, template)
    cut = segment.segment(chat, "chat_prefix", "response", max_length, token_col)
    carried = [f.name for f in RESPONSE if f.name in cut.columns]
    # cut once: the three tables are read from here, and the texts of prompt and response stay behind
    cut = cut.withColumn("_row", F.monotonically_increasing_id())
    cut = cut_lineage(cut.select(*dict.fromkeys([*carried, *order, "_row", "spans", "skips"])))
    valid, skips = segment.route_skips(cut)
    valid = valid.withColumn("n_sentences", F.size("spans").cast("long"))
    # the stored row number tells equal keys apart and joins the numbers back
    places = _places(valid.select(*order, "_row", "n_sentences"), [*order, "_row"]).select("_row", "_number", "_first")
    numbered = valid.join(places, "_row").withColumn("response_idx", F.col("_number") + first_response)
    responses = numbered.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESPONSE])
    keys = ["response_id", "dataset", "row_id", "prompt_col", "sample_idx", "response_idx", "_first"]
    rows = segment.sentence_rows(numbered, keys)
    rows = rows.withColumn("global_idx", F.col("_first") + F.col("sent_idx") + first_sentence)
    sentences = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SENTENCE])
    return CorpusTables(sentences, responses, skips)


def _places(counts: DataFrame, order: list[str], width: int = 20_000) -> DataFrame:
    """Each response's number and, as ``_first``, how many sentences the responses before it have.

    Works on keys and counts only. The running sum has two levels, so that no task sees the whole table: inside
    ranges of ``width`` responses, and over the ranges.
    """
    numbered = dense_index(counts, order, "_number").withColumn("_range", F.floor(F.col("_number") / width))
    inside = Window.partitionBy("_range").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = numbered.groupBy("_range").agg(F.sum("n_sentences").alias("_n"))
    bases = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = numbered.withColumn("_within", F.coalesce(F.sum("n_sentences").over(inside), F.lit(0)))
    first = (F.col("_base") + F.col("_within")).alias("_first")
    return within.join(bases, "_range").select(*order, "_number", first)


def conversation_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given conversations as generations: a user turn is the prompt, the next assistant turn the response."""
    pairs = pr.turn_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return pairs.select(
        F.lit("conversations").alias("dataset"),
        F.col("conv_id").cast("string").alias("row_id"),
        F.lit("text").alias("prompt_col"),
        "prompt",
        F.col("turn").cast("int").alias("sample_idx"),
        "response",
        F.lit("stand-in").alias("model"),
    )
