"""Dense indices, exact seeded samples and splits over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanlake.functions.text import hash_order
from spanlake.session import cut_lineage, remove, scratch_dir

_FIXED_SIZE = (T.NumericType, T.BooleanType, T.DatetimeType)
_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits


def _numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """Rows with their place: range-partitioned and sorted, written to the checkpoint folder with their place in the partition,
    to which the row counts of the partitions before are added. A window without a key would put the table in one task; here
    the only table-wide step runs over one number per partition."""
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id().bitwiseAND((1 << _ROW_BITS) - 1))
    )
    placed = cut_lineage(placed)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    # one row per partition, so its size does not depend on the rows
    joined = placed.join(F.broadcast(offsets), "_part")
    return joined.withColumn(out, F.col("_pos") + F.col("_before")).drop("_part", "_pos", "_before")


def dense_index(df: DataFrame, order: Sequence[str | Column], out: str = "global_idx") -> DataFrame:
    """0, 1, 2, … over the whole table in the given order; rows that the order does not tell apart stand in any order.

    Where the order is a list of columns and the rows hold texts or vectors beside them, only the order's columns are ranged,
    sorted and written: the numbers of the keys are joined to the rows afterwards, so what is large is moved once and never
    written. Keys that repeat cannot be joined; then, and where the order holds expressions, whole rows are numbered.
    """
    names = [c for c in order if isinstance(c, str)]
    large = [f.name for f in df.schema if f.name not in names and not isinstance(f.dataType, _FIXED_SIZE)]
    if len(names) < len(order) or not large:
        return _numbered(df, order, out)
    spark, folder = df.sparkSession, scratch_dir(df.sparkSession)
    keys = df.select(*[F.col(c).alias(f"_key{i}") for i, c in enumerate(names)])
    keys.write.parquet(folder)  # the sampling of the ranges and the sort read it here
    columns = keys.columns
    numbers = _numbered(spark.read.schema(keys.schema).parquet(folder), columns, "_number")
    remove(spark, folder)
    if numbers.groupBy(*columns).count().where("count > 1").limit(1).count():
        return _numbered(df, order, out)
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(names, columns)])
    kept = [c for c in df.columns if c != out]
    return df.select(*kept).join(numbers, same).select(*kept, F.col("_number").alias(out))


def with_batch_id(df: DataFrame, size: int, order: Sequence[str | Column], out: str = "batch_id") -> DataFrame:
    """Batches of ``size`` rows in the given order; the last one may be short."""
    indexed = dense_index(df, order, "_row")
    return indexed.withColumn(out, F.floor(F.col("_row") / size)).withColumn("batch_pos", F.col("_row") % size).drop("_row")


def longest_first(df: DataFrame, length_col: str, tie: str, size: int) -> DataFrame:
    """Pending work in batches of similar length, longest first."""
    return with_batch_id(df, size, [F.col(length_col).desc(), F.col(tie)])


def limit_per(df: DataFrame, keys: Sequence[str], n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of each group. Catalyst cuts each task's share to ``n`` per group before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def limit_total(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """The first ``n`` rows of the table in the given order."""
    return df.orderBy(*order).limit(n)


def sample_n(df: DataFrame, n: int, seed: int, id_cols: Sequence[str]) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by the seed and the ids."""
    ids = [F.col(c) for c in id_cols]
    return df.orderBy(hash_order(seed, *ids), *ids).limit(n)


def hash_cutoff(keys: DataFrame, rank_of: Callable[[int], int], digits: int = 3, small: int = 10_000) -> str | None:
    """The value of the given rank (1-based, from the number of rows) of the hex column ``h`` in ascending order.

    Null when the rank is 0 or beyond the last row. A search by prefix: each round counts the rows by their next
    hex digits and goes on inside the one prefix that holds the wanted rank, so the driver sees at most
    ``16 ** digits`` counts or ``small`` hashes, and no row is sorted as a whole.
    """
    prefix, rank = "", None
    while True:
        inside = keys.filter(F.col("h").startswith(prefix))
        part = F.substring("h", 1, len(prefix) + digits)
        counts = inside.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        total = sum(row["n"] for row in counts)
        rank = rank_of(total) if rank is None else rank
        if not 0 < rank <= total:
            return None
        for row in counts:
            if rank <= row["n"]:
                break
            rank -= row["n"]
        prefix = row["p"]
        if row["n"] <= small or len(prefix) >= 32:
            rows = keys.filter(F.col("h").startswith(prefix)).orderBy("h").limit(rank).collect()
            return rows[-1]["h"]


def val_rule(df: DataFrame, frac: float, id_cols: Sequence[str], split_seed: int = 0) -> Column:
    """The condition that marks exactly ``max(1, int(n * frac))`` rows of ``df`` as validation, by their ids.

    As a condition on the ids it also applies to tables in which the ids occur many times, without a join.
    """
    h = hash_order(split_seed, *[F.col(c) for c in id_cols])
    cutoff = hash_cutoff(df.select(h.alias("h")), lambda n: max(1, int(n * frac)))
    return F.lit(False) if cutoff is None else h <= F.lit(cutoff)


def train_val_split(
    df: DataFrame, frac: float, id_cols: Sequence[str], split_seed: int = 0, out: str = "is_val"
) -> DataFrame:
    """Marks exactly ``max(1, int(n * frac))`` rows as validation, the same ones for every run seed."""
    return df.withColumn(out, val_rule(df, frac, id_cols, split_seed))
