"""Connected components by alternating stars: every step is a grouped minimum and a join, so no node's edges meet in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node that has an edge to another; the root is the smallest node of its component.

    Edges may repeat, point either way or join a node with itself; edges with a null end are left out. No edge gives
    no row. Each round is cut off with a checkpoint in the shared folder. After ``most_rounds`` rounds without an
    end it raises (the number of rounds grows with the logarithm of the nodes).
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = cut_lineage(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("a"), low.alias("b")).where("a <> b").distinct()
    )
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        # AQE may find one side empty; a distinct keeps the star's edges single
        now = cut_lineage(_small_star(_large_star(now).distinct()).distinct())
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
