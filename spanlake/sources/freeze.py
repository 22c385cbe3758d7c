"""Fingerprints, the freeze-and-reuse guard and the completion marker."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.operators.labeling import progress
from spanlake.session import remove
from spanlake.sources.tables import exists, read_json, write_json


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: a SHA-256 over all rows that does not depend on their order.

    Rows are hashed, equal ones counted together, and the hashes folded by prefix in three levels (six hex
    digits, three, none). A fold joins some thousand hashes at most, and copies of one row are one entry.
    """
    cells = [F.coalesce(F.sha2(F.col(c).cast("string"), 256), F.lit("null")) for c in df.columns]
    row = F.concat_ws(",", *cells)
    leaves = df.select(F.sha2(row, 256).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return _fold(leaves.select(F.substring("h", 1, 6).alias("p"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("item")))


def _fold(items: DataFrame) -> DataFrame:
    def joined(c: str) -> Column:
        return F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ","), 256)

    six = items.groupBy("p").agg(joined("item").alias("d"))
    six = six.select(F.substring("p", 1, 3).alias("q"), F.concat_ws(":", "p", "d").alias("item"))
    three = six.groupBy("q").agg(joined("item").alias("d")).select(F.concat_ws(":", "q", "d").alias("item"))
    return three.agg(joined("item").alias("fingerprint"))


def fingerprint_files(spark: SparkSession, folder: str, glob: str = "*.jsonl") -> DataFrame:
    """One row: a SHA-256 over the names, sizes and lines, in their order, of the text files of a folder.

    A file is read in splits, so its size does not matter: lines are numbered inside a split, and a split's first number
    is the number of lines in those before it.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    listed = files.select(name.alias("name"), F.lit(-1).cast("long").alias("line"), F.col("length").cast("string").alias("digest"))
    lines = spark.read.option("pathGlobFilter", glob).text(folder).select(
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),  # grows within a block
        F.sha2("value", 256).alias("digest"),
    )
    blocks = lines.groupBy("name", "block").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("name", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = lines.join(offsets, ["name", "block"])
    line = (F.col("row") - F.col("first") + F.col("offset")).alias("line")
    return fingerprint(numbered.select("name", line, "digest").unionByName(listed))


def freeze(
    build: Callable[[], Mapping[str, DataFrame]],
    spark: SparkSession,
    folder: str,
    params: Mapping[str, Any],
    input_hash: str,
    force: bool = False,
) -> dict[str, DataFrame]:
    """Builds tables once and reuses them as long as input and parameters are the same.

    The manifest is written after the tables. With a manifest of other values this raises; ``force`` rebuilds. A rebuild
    first removes the manifest, so that one that stops half-way leaves tables that nobody takes for finished.
    """
    manifest_path = f"{folder}/manifest"
    wanted = {**params, "input_hash": input_hash}
    if not force and exists(spark, manifest_path):
        manifest = read_json(spark, manifest_path)
        differing = sorted(k for k in wanted if manifest["params"].get(k) != wanted[k])
        if differing or set(manifest["params"]) != set(wanted):
            raise RuntimeError(f"{folder} was built with other values of {differing or 'its parameters'}; use force")
        return {name: spark.read.parquet(f"{folder}/{name}") for name in manifest["rows"]}
    remove(spark, manifest_path)
    rows = {}
    for name, df in build().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        rows[name] = spark.read.parquet(f"{folder}/{name}").count()
    write_json(spark, {"params": wanted, "rows": rows}, manifest_path)
    return {name: spark.read.parquet(f"{folder}/{name}") for name in rows}


def write_meta(every: DataFrame, done: DataFrame, key: str, meta: Mapping[str, Any], folder: str) -> bool:
    """Writes the completion marker when every key is done; says whether it did."""
    if not progress(every, done, key).first()["complete"]:
        return False
    write_json(every.sparkSession, meta, f"{folder}/meta")
    return True
