"""Registry of named queries over the test tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanlake.sources.tables import spread

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    covers: tuple[str, ...]
    run: QueryFn
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(covers: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Registers a function under its own name; ``covers`` lists the inventory ids it exercises."""

    def register(fn: QueryFn) -> QueryFn:
        name = fn.__name__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, tuple(covers.split()), fn, sql)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents, dealt out to all cores before they are cut."""
    return spread(table(spark, sf_dir, "documents").select(*columns) if columns else table(spark, sf_dir, "documents"))


def r4(c: Column | str) -> Column:
    """Four decimals, without a negative zero."""
    rounded = F.round(c, 4)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded)


def sql_r4(expr: str) -> str:
    """The SQL form of :func:`r4`."""
    return f"CASE WHEN round({expr}, 4) = 0 THEN 0.0::DOUBLE ELSE round({expr}, 4) END"


def load_all() -> dict[str, Query]:
    """All registered queries."""
    from spanlake.plans import cluster_queries, io_queries, probe_queries, prompt_queries, text_queries, vector_queries  # noqa: F401

    return QUERIES
