"""Runs a query in Spark and its SQL twin in DuckDB over the same files and compares all rows."""

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def product_join(df):
    """The product join in a plan, if there is one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next((name for name in ("CartesianProduct", "BroadcastNestedLoopJoin") if name in plan), None)


def compare(spark, con, sf_dir, query):
    """None when equal, else a message."""
    df = query.run(spark, sf_dir)
    if product_join(df):
        return f"plan holds a {product_join(df)}"
    names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(query.sql)
    sql_names = [d[0] for d in cursor.description]
    want_names, want = _rows(sql_names, cursor.fetchall())
    if names != want_names:
        return f"columns differ: {names} and {want_names}"
    if len(got) != len(want):
        return f"row counts differ: {len(got)} and {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"first difference:\n  spark  {a}\n  duckdb {b}"
        for name, x, y in zip(names, a, b):
            if type(x) is not type(y):
                return f"types differ in {name}: {type(x).__name__} and {type(y).__name__}"
    return None
