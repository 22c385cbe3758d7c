"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own order of preference over the slots of a prime-sized table: ``offset + k * skip`` for k = 0, 1, ...
The shards take turns, each claiming the first free slot of its order, until the table is full. Every shard then owns as
many slots as any other, give or take one, and few slots change hands when shards come or go. A row's slot is a hash of
its key; the table, whose size depends on the number of shards only, is broadcast.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots per shard at least: shares then differ by less than a hundredth.
SLOTS_PER_SHARD = 100
#: The largest table, and so the bound of what is broadcast.
MOST_SLOTS = 1 << 22


def table_size(n_shards: int) -> int:
    """The smallest prime that gives every shard its slots."""
    n = max(2, n_shards * SLOTS_PER_SHARD)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int | None = None) -> list[int]:
    """The owner (place in ``shards``) of every slot. Names must be distinct and at least one; their order decides ties."""
    size = size or table_size(len(shards))
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not len(shards) <= size <= MOST_SLOTS:
        raise ValueError(f"{size} slots for {len(shards)} shards")
    place = [_number(f"offset|{s}") % size for s in shards]
    skip = [_number(f"skip|{s}") % (size - 1) + 1 for s in shards]
    owner = [-1] * size
    for turn in range(size):
        i = turn % len(shards)
        while owner[place[i]] >= 0:
            place[i] = (place[i] + skip[i]) % size
        owner[place[i]] = i
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: the first 60 bits of its MD5, modulo the size. A null key counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size


def with_shard(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int | None = None) -> DataFrame:
    """``docs`` with ``slot`` and ``shard`` (the name). Columns of these names are replaced; equal keys share a shard.

    One narrow pass: each row looks its slot up in the broadcast table. A hot key costs no more than others here; its
    rows are on one shard by definition.
    """
    owner = lookup_table(shards, size)
    spark = docs.sparkSession
    # a literal, so that no Python runs on the executors; the list is bounded by MOST_SLOTS
    at = lambda values, i: F.element_at(F.split(F.lit(values), ","), i.cast("int") + 1)
    names = F.array(*map(F.lit, shards))
    slots = spark.range(len(owner)).select(F.col("id").alias("slot"), at(",".join(map(str, owner)), F.col("id")).cast("int").alias("owner"))
    table = F.broadcast(slots.select("slot", F.element_at(names, F.col("owner") + 1).alias("shard")))
    rest = docs.drop("slot", "shard")
    return rest.withColumn("slot", slot_of(F.col(key), len(owner))).join(table, "slot").select(*rest.columns, "slot", "shard")
