"""A tree of digests over the text files of a folder: lines make blocks, blocks parts, parts files, files the folder.

The blocks are kept as a table, so that a later check reads only the files whose size or time differs and names the blocks
that changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanlake.schemas import BLOCK_DIGEST
from spanlake.sources.freeze import fingerprint

#: Lines of a block, and blocks of a part; a cell holds as many digests at most.
LINES, BLOCKS = 1 << 14, 1 << 12


def _joined(place: str) -> Column:
    """One digest of those of a group, in the order of ``place``."""
    ordered = F.array_sort(F.collect_list(F.struct(place, "digest")))
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ","), 256)


def listing(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, name, length, modified)`` of the files of a folder; no file is opened. Files without a byte are left out by Spark's
    scans, so that they are never part of a manifest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("modified"))


def _lines_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(name, line, digest)`` with lines numbered from 0 in each file, which is read in splits."""
    lines = spark.read.text(list(paths)).select(
        F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("name"),  # a listing has it unescaped
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),  # grows within a split
        F.sha2("value", 256).alias("digest"),
    )
    splits = lines.groupBy("name", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = Window.partitionBy("name").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select("name", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    line = (F.col("row") - F.col("first") + F.col("offset")).alias("line")
    return lines.join(offsets, ["name", "split"]).select("name", line, "digest")


def block_digests(files: DataFrame, lines: int = LINES) -> DataFrame:
    """``(name, length, modified, block, digest)``: a SHA-256 per ``lines`` lines of each file of a :func:`listing`.

    The paths go to the driver, which lists them for the scan anyway.
    """
    spark = files.sparkSession
    paths = [r.path for r in files.select("path").toLocalIterator()]
    if not paths:
        return spark.createDataFrame([], BLOCK_DIGEST)
    cut = _lines_of(spark, paths).withColumn("block", F.floor(F.col("line") / lines))
    made = cut.groupBy("name", "block").agg(_joined("line").alias("digest"))
    return files.select("name", "length", "modified").join(made, "name")


def write_manifest(blocks: DataFrame, path: str) -> None:
    """Keeps the blocks of a folder."""
    blocks.select(*BLOCK_DIGEST.fieldNames()).write.mode("overwrite").parquet(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`write_manifest` wrote."""
    return spark.read.schema(BLOCK_DIGEST).parquet(path)


def file_digests(blocks: DataFrame) -> DataFrame:
    """``(name, digest)`` of each file, from its blocks by way of parts of ``BLOCKS`` blocks."""
    parts = blocks.groupBy("name", F.floor(F.col("block") / BLOCKS).alias("part")).agg(_joined("block").alias("digest"))
    return parts.groupBy("name").agg(_joined("part").alias("digest"))


def root_digest(blocks: DataFrame) -> DataFrame:
    """One row, ``fingerprint``, over the names and digests of all files."""
    return fingerprint(file_digests(blocks))


def recheck(spark: SparkSession, folder: str, manifest: DataFrame, glob: str = "*", lines: int = LINES) -> tuple[DataFrame, DataFrame]:
    """``(changes, blocks)``: what differs from a manifest made with the same ``lines``, and the blocks as they are now.

    ``changes`` has a row for each block that was added, changed or removed: ``name, state, block``, the state being that of the
    file: ``added``, ``removed`` or ``changed``. A file that is ``touched`` (another time, the same lines) has one row without a
    block; files as they were have none. Only files that are new or whose size or time differs are read.
    """
    now = listing(spark, folder, glob)
    known = manifest.select("name", "length", "modified").distinct()
    unread = now.join(known, ["name", "length", "modified"], "left_anti")
    fresh = block_digests(unread, lines)
    kept = manifest.join(now.select("name", "length", "modified"), ["name", "length", "modified"], "left_semi")
    old = manifest.join(kept.select("name").distinct(), "name", "left_anti")
    a = old.select("name", F.col("block").alias("_b"), F.col("digest").alias("_old"), F.lit(True).alias("_was"))
    b = fresh.select(F.col("name").alias("_n"), "block", "digest", F.lit(True).alias("_is"))
    both = a.join(b, (F.col("name") == F.col("_n")) & (F.col("_b") == F.col("block")), "full")
    rows = both.select(
        F.coalesce("name", "_n").alias("name"), F.coalesce("_b", "block").alias("block"), "_was", "_is", (~F.col("_old").eqNullSafe(F.col("digest"))).alias("_differs")
    )
    files = rows.groupBy("name").agg(F.max("_was").alias("was"), F.max("_is").alias("is"), F.max("_differs").alias("differs"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(F.col("differs"), "changed").otherwise("touched")
    told = rows.join(files.select("name", state.alias("state")), "name")
    shown = told.where((F.col("state") != "touched") & (F.col("_differs") | F.col("_was").isNull() | F.col("_is").isNull()))
    touched = files.where(state == "touched").select("name", F.lit("touched").alias("state"), F.lit(None).cast("long").alias("block"))
    return shown.select("name", "state", "block").unionByName(touched), kept.unionByName(fresh)
