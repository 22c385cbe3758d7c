"""Newly arrived generation files become sentence, response and skip rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from spanlake import fixed
from spanlake.operators import prompts as pr
from spanlake.plans.corpus import tables_of
from spanlake.schemas import GENERATION
from spanlake.sources.tables import exists

TABLES = ("sentences", "responses", "skips")
#: Folders that the ids taken so far are dealt to, and the batches after which their folders become one.
ID_BUCKETS, MERGE_EVERY = 64, 32


def _counted(spark: SparkSession, out_dir: str, batch_id: int) -> tuple[int, int]:
    """Sentences and responses of the batches before, from the one row that each batch leaves."""
    if not exists(spark, f"{out_dir}/counts"):
        return 0, 0
    before = spark.read.parquet(f"{out_dir}/counts").filter(F.col("batch") < batch_id)
    row = before.agg(F.sum("sentences").alias("s"), F.sum("responses").alias("r")).first()
    return row["s"] or 0, row["r"] or 0


def _taken(spark: SparkSession, out_dir: str, batch_id: int, merge_every: int, schema: T.StructType) -> DataFrame:
    """``response_id, bucket`` of the batches before, from the last merged folder and those of the batches since."""
    since = batch_id // merge_every * merge_every
    merged = [f"{out_dir}/ids_merged/upto={since}"] if since else []
    paths = [*merged, *(f"{out_dir}/ids/batch={i}" for i in range(since, batch_id))]
    parts = [spark.read.schema(schema).parquet(path) for path in paths]
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))


def ingest_stream(
    spark: SparkSession,
    in_dir: str,
    out_dir: str,
    checkpoint: str,
    template: pr.ChatTemplate = pr.ChatTemplate(),
    max_length: int = fixed.MAX_LENGTH,
    done: DataFrame | None = None,
    glob: str = "*.jsonl",
    id_buckets: int = ID_BUCKETS,
    merge_every: int = MERGE_EVERY,
) -> StreamingQuery:
    """Processes what has arrived in ``in_dir`` since the last call, then stops.

    A response id is taken once. The stream keeps no state: the ids taken so far lie in tables beside the output, dealt to
    ``id_buckets`` folders by hash, and a batch reads only the folders that its own ids fall into. Every ``merge_every``
    batches these become one set of folders. Both numbers have to stay the same for an output. Of the rows of one id in
    a batch the least one counts. Ids that were done elsewhere come in as ``done``. Each batch is written to its own folder, overwriting what a failed attempt may have left there, and its rows
    are numbered after those of the batches before.
    """
    arrived = (
        spark.readStream.schema(GENERATION)
        .option("mode", "FAILFAST")
        .option("pathGlobFilter", glob)
        .json(in_dir)
    )
    fresh = pr.with_response_id(arrived)
    ids = T.StructType([T.StructField("response_id", fresh.schema["response_id"].dataType), T.StructField("bucket", T.IntegerType())])
    bucket = F.pmod(F.xxhash64("response_id"), F.lit(id_buckets)).cast("int")
    if done is not None:
        fresh = fresh.join(done.select("response_id").distinct(), "response_id", "left_anti")

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        touched = [r["b"] for r in batch.select(bucket.alias("b")).distinct().collect()]  # at most id_buckets numbers
        taken = _taken(session, out_dir, batch_id, merge_every, ids)
        row = F.min(F.struct(*(c for c in batch.columns if c != "response_id"))).alias("row")  # the same one in every pass
        batch = batch.groupBy("response_id").agg(row).select("response_id", "row.*").join(taken.where(F.col("bucket").isin(touched)), "response_id", "left_anti")
        sentences, responses = _counted(session, out_dir, batch_id)
        tables = tables_of(batch, template, max_length, first_sentence=sentences, first_response=responses)
        for name in TABLES:
            getattr(tables, name).write.mode("overwrite").parquet(f"{out_dir}/{name}/batch={batch_id}")
        written = [session.read.parquet(f"{out_dir}/{name}/batch={batch_id}").count() for name in ("sentences", "responses")]
        # a failed attempt has left at most what this one overwrites: each reads the batches before it only
        own = batch.select("response_id", bucket.alias("bucket")).repartition("bucket")
        own.write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/ids/batch={batch_id}")
        if (batch_id + 1) % merge_every == 0:
            written_ids = session.read.schema(ids).parquet(f"{out_dir}/ids/batch={batch_id}")
            every = taken.unionByName(written_ids).repartition("bucket")
            every.write.mode("overwrite").partitionBy("bucket").parquet(f"{out_dir}/ids_merged/upto={batch_id + 1}")
        counts = session.createDataFrame([tuple(written)], "sentences long, responses long")
        counts.write.mode("overwrite").parquet(f"{out_dir}/counts/batch={batch_id}")

    return (
        fresh.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_ingested(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The tables of all batches."""
    return {name: spark.read.parquet(f"{out_dir}/{name}").drop("batch") for name in TABLES}
