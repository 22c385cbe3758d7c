"""The corpus pipeline: stages over documents, each written as Parquet and read again by its successor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanlake.llm import decontaminate, mixing, near_copies, quality, sharding
from spanlake.llm.storage import stored

#: Documents with a lower quality score are rejected.
LEAST_SCORE = 0.3
MIX = mixing.Mix()
SHARDS = [f"shard-{i:02d}" for i in range(32)]
#: The first stage learns from labels, which SQL cannot express.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labelled ones among them, does not reject."""
    model = quality.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.with_score(docs, model, out="__score").where(f"__score >= {LEAST_SCORE}").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SimHash groups and MinHash bands of five-word shingles, Jaccard 0.8): the
    one with the smallest id."""
    return near_copies.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of the benchmark."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their source draws them."""
    return mixing.draws(docs, MIX).select(*docs.columns)


def on_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their slot and shard."""
    return sharding.with_shard(docs, SHARDS)


STAGES = [
    ("quality", good_documents),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed_sources),
    ("sharding", on_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
