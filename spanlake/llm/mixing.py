"""Mixing sources by temperature, in DataFrame functions only.

A source with token share p gets the weight p^a / sum(p^a). The exponent a is found by bisection on a grid of 2^-20: the
largest whose weights reach a target entropy, raised as far as needed to keep every source within a repetition limit. A
budget of tokens times the weight is a source's quota: whole epochs, then a part of one. An epoch is a permutation of the
source's blocks, and of the rows in each block, by seeded hashes; the part takes whole blocks in that order, then rows of
one more block while they fit. The cut of a source is one row (a block key and a row key), so each document decides for
itself and no text is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanlake.llm.storage import stored

GRID = 1 << 20
#: Exponents tried in one pass over the sources; each pass adds five bits.
FAN = 32


@dataclass(frozen=True)
class Mix:
    """Parameters: the target entropy as a share of that of equal weights, the most epochs of a source, tokens of a block,
    the seed, and the budget in tokens (None: as many as there are)."""

    evenness: float = 0.95
    most_epochs: float = 4.0
    block_tokens: int = 1 << 20
    seed: int = 1
    budget: int | None = None


def n_tokens(text: str) -> Column:
    """Runs of non-blanks; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \t-\r]+")), F.lit(0)).cast("long")


def _key(*parts: Column | int | str) -> Column:
    return F.md5(F.concat_ws("|", *(p if isinstance(p, Column) else F.lit(str(p)) for p in parts)))


def _tag(source: str) -> Column:
    """A source as a string that tells null from empty."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _search(sources: DataFrame, holds: Column, last_true: bool) -> int:
    """The last (or first) point of the grid 0..GRID where the condition holds, which is true up to (or from) some point.

    Each pass tries ``FAN`` - 1 points between the bounds at once; sources stay rows.
    """
    low, high = (0, GRID) if last_true else (-1, GRID)
    while high - low > 1:
        step = max(1, (high - low) // FAN)
        points = [p for p in range(low + step, high, step)]
        tried = sources.select("*", F.explode(F.array(*map(F.lit, points))).alias("k"))
        power = F.exp(F.col("k") / GRID * F.col("log_share"))
        sums = tried.groupBy("k").agg(
            F.sum(power).alias("z"), F.sum(power * F.col("k") / GRID * F.col("log_share")).alias("s"), F.max(power / F.col("tokens")).alias("m")
        )
        true = {r.k for r in sums.where(holds).select("k").collect()}  # at most as many rows as points
        if last_true:
            good = [p for p in points if p in true]
            low, high = (good[-1] if good else low), min([p for p in points if p not in true], default=high)
        else:
            good = [p for p in points if p in true]
            low, high = max([p for p in points if p not in true], default=low), (good[0] if good else high)
    return low if last_true else high


def weights(docs: DataFrame, mix: Mix, source: str = "source", text: str = "text") -> DataFrame:
    """``(__s, tokens, exponent, weight, quota)`` per source that has tokens; ``__s`` is the source's tag.

    The entropy does not fall below the target where a = 0 can reach it; the repetition limit goes first. No tokens at
    all give no row.
    """
    counted = stored(docs.groupBy(_tag(source).alias("__s")).agg(F.sum(n_tokens(text)).alias("tokens")).where("tokens > 0"))
    row = counted.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    total = row.t or 0
    budget = mix.budget if mix.budget is not None else total
    sources = counted.withColumn("log_share", F.ln(F.col("tokens") / F.lit(float(max(total, 1)))))
    k = GRID
    if total:
        entropy = F.ln("z") - F.col("s") / F.col("z")
        even = entropy >= F.lit(mix.evenness) * F.ln(F.lit(float(row.n))) - 1e-12
        within = F.col("m") / F.col("z") * float(budget) <= mix.most_epochs
        at_one = sources.agg(F.sum(F.exp("log_share")).alias("z"), F.sum(F.exp("log_share") * F.col("log_share")).alias("s"))
        k = GRID if at_one.where(even).count() else _search(sources, even, True)
        k = max(k, _search(sources, within, False))
    power = F.exp(F.lit(k / GRID) * F.col("log_share"))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    weight = power / F.lit(z)
    # with exponent 1 the product is a whole number but for its last digits
    quota = F.floor(F.round(weight * float(budget), 3))
    return sources.select("__s", "tokens", F.lit(k / GRID).alias("exponent"), weight.alias("weight"), quota.alias("quota"))


def draws(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """``docs`` repeated as the mix takes them, with ``epoch`` (from 0), ``block`` and ``n_tokens``.

    Sorting a source by epoch, ``_key(seed, epoch, source tag, block)`` and ``_key(seed, epoch, id)`` gives its permutation.
    Rows with equal ids and texts of one source are drawn together. Rows without tokens cost nothing: they go with their block;
    those of a source without any token are taken once. Columns of these three names are replaced.
    """
    docs = docs.drop("epoch", "block", "n_tokens")
    shares = weights(docs, mix, source, text)
    whole = F.floor(F.col("quota") / F.col("tokens"))
    n_blocks = F.ceil(F.col("tokens") / F.lit(mix.block_tokens))
    # stored, so that its size is known and Spark joins it without a shuffle of the documents where it is small
    plan = stored(shares.select("__s", whole.alias("__whole"), (F.col("quota") - whole * F.col("tokens")).alias("__rest"), n_blocks.alias("__n_blocks")))
    # a null id has the empty key
    row_key = F.md5(F.concat_ws("|", F.lit(str(mix.seed)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    block = F.conv(F.substring(row_key, 1, 12), 16, 10).cast("long") % F.coalesce("__n_blocks", F.lit(1))
    keyed = docs.withColumns({"__s": _tag(source), "n_tokens": n_tokens(text)}).join(plan, "__s", "left").withColumn("block", block)
    block_key = _key(mix.seed, F.col("__whole"), F.col("__s"), F.col("block"))
    id_key = _key(mix.seed, F.col("__whole"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    narrow = keyed.where("__rest > 0").select("__s", "__rest", "block", "n_tokens", block_key.alias("bk"), id_key.alias("dk"))
    blocks = narrow.groupBy("__s", "__rest", "block", "bk").agg(F.sum("n_tokens").alias("t"))
    so_far = F.sum("t").over(Window.partitionBy("__s").orderBy("bk"))
    cut = blocks.withColumn("end", so_far).where("end > __rest").groupBy("__s").agg(F.min_by(F.struct("bk", (F.col("__rest") - F.col("end") + F.col("t")).alias("left")), "bk").alias("c"))
    cut = stored(cut.select("__s", F.col("c.bk").alias("__cut_bk"), F.col("c.left").alias("left")))
    # ties of the row key share one running sum, so equal rows stay together
    inside = narrow.join(cut, (narrow["__s"] == cut["__s"]) & (F.col("bk") == F.col("__cut_bk"))).select(narrow["__s"], "dk", "n_tokens", "left")
    taken = inside.groupBy("__s", "dk", "left").agg(F.sum("n_tokens").alias("t"))
    filled = F.sum("t").over(Window.partitionBy("__s").orderBy("dk"))
    last = taken.withColumn("end", filled).where("end <= left").groupBy("__s").agg(F.max("dk").alias("__cut_dk"))
    cuts = stored(plan.join(cut, "__s", "left").join(last, "__s", "left").select("__s", "__cut_bk", "__cut_dk"))
    found = keyed.join(cuts, "__s", "left")
    part = (F.col("__rest") > 0) & (
        F.col("__cut_bk").isNull() | (block_key < F.col("__cut_bk")) | ((block_key == F.col("__cut_bk")) & F.coalesce(id_key <= F.col("__cut_dk"), F.lit(False)))
    )
    copies = F.when(F.col("__whole").isNull(), 1).otherwise(F.col("__whole") + part.cast("int")).cast("int")
    found = found.withColumn("__copies", copies).where("__copies > 0")
    return found.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)).alias("epoch"), "block", "n_tokens")
