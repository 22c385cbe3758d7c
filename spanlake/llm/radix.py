"""Distributed LSD radix sort of narrow rows, in DataFrame functions.

A key is a list of non-negative integers with their widths in bits, the least significant first; its bits, laid end to end,
are cut into digits. A pass over one digit is a stable counting sort: rows are counted by (digit, part), where a part is a
bounded run of positions; a prefix sum over digits, then parts, gives the first destination of each pair; a row's
destination adds how many rows of its pair stand before it in the part. Rows are shuffled by part, never by digit, so a
digit that most rows share makes no task larger. Each pass is written to the shared folder, so a lost executor repeats a
part of one pass only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.storage import stored

#: Bits of a digit: a pass has at most 2^DIGIT different digits.
DIGIT = 11
#: Positions of a part, as powers of two: the fewest and the most.
PART_BITS = (8, 16)

Key = list[tuple[Column, int]]


def _bits(value: Column, low: int, n: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << n) - 1)) if low else value.bitwiseAND(F.lit((1 << n) - 1))


def digits_of(key: Key) -> list[Column]:
    """The digits of a composite key, the least significant first; a digit may hold bits of two integers."""
    out: list[Column] = []
    used = DIGIT
    for value, width in key:
        at = 0
        while at < width:
            if used == DIGIT:
                out.append(F.lit(0).cast("long"))
                used = 0
            take = min(width - at, DIGIT - used)
            out[-1] = out[-1] + F.shiftleft(_bits(value, at, take), used)
            used += take
            at += take
    return out


def nth_largest(rows: DataFrame, value: Column, width: int, n: int) -> int:
    """The ``n``-th largest of a column of non-negative integers (``n`` from 1 to the number of rows), digit by digit from the
    top. Each step counts the rows by one digit; at most 2^DIGIT counts come to the driver."""
    found = 0
    for low in range((max(width, 1) - 1) // DIGIT * DIGIT, -1, -DIGIT):
        above = low + DIGIT
        inside = rows if above >= width else rows.where(F.shiftrightunsigned(value, above) == found)
        counts = {r.d: r["count"] for r in inside.groupBy(_bits(value, low, DIGIT).alias("d")).count().collect()}
        for digit in sorted(counts, reverse=True):
            if counts[digit] >= n:
                found = found << DIGIT | digit
                break
            n -= counts[digit]
    return found


def _counting_pass(rows: DataFrame, digit: Column, part_bits: int, out: str) -> DataFrame:
    columns = [c for c in rows.columns if c != out]
    placed = rows.withColumns({"__part": F.shiftright(F.col(out), part_bits), "__digit": digit})
    counts = placed.groupBy("__digit", "__part").agg(F.count("*").alias("__n"))
    totals = counts.groupBy("__digit").agg(F.sum("__n").alias("__n"))
    before = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # no more rows than there are digits
    smaller = totals.select("__digit", before(Window.orderBy("__digit")).alias("__smaller"))
    earlier = counts.select("__digit", "__part", before(Window.partitionBy("__digit").orderBy("__part")).alias("__earlier"))
    first = earlier.join(smaller, "__digit").select("__digit", "__part", (F.col("__smaller") + F.col("__earlier")).alias("__first"))
    inside = F.row_number().over(Window.partitionBy("__part", "__digit").orderBy(out)) - 1
    ranked = placed.repartition("__part").withColumn("__inside", inside)
    return ranked.join(first, ["__part", "__digit"]).select(*columns, (F.col("__first") + F.col("__inside")).alias(out))


def with_position(rows: DataFrame, key: Key, n: int, out: str = "position") -> DataFrame:
    """``rows`` with their place in the ascending order of the key, 0, 1, 2, …; ``n`` is about how many rows there are and sets
    the size of the parts, not the result. Rows with equal keys are in no defined order. A column ``out`` is replaced."""
    wanted = 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_bits = min(max((max(n, 1) // wanted).bit_length(), PART_BITS[0]), PART_BITS[1])
    # written at once, so that the first positions stay what they are
    sorted_rows = stored(rows.drop(out).withColumn(out, F.monotonically_increasing_id()))
    digits = digits_of(key) or [F.lit(0).cast("long")]
    for digit in digits:
        sorted_rows = stored(_counting_pass(sorted_rows, digit, part_bits, out))
    return sorted_rows
