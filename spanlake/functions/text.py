"""String, hash and naming expressions. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanlake.fixed import TEXT_WS, WS, WS_CHARS


def strip(c: Column) -> Column:
    """Text without outer white space (any Unicode white space)."""
    return F.trim(c, F.lit(WS_CHARS))


def is_blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | ~c.rlike(WS.replace("[", "[^", 1))


def normalize_ws(c: Column) -> Column:
    """Outer white space removed, inner runs collapsed to one space."""
    return F.trim(F.regexp_replace(c, f"{WS}+", " "))


def trim_span(raw: Column, start: Column) -> Column:
    """``raw`` found at ``start``: its trimmed text with the offsets that belong to the trimmed text."""
    no_lead = F.regexp_replace(raw, rf"^{TEXT_WS}+", "")
    text = F.regexp_replace(no_lead, rf"{TEXT_WS}+\z", "")
    first = start + F.length(raw) - F.length(no_lead)
    return F.struct(
        text.alias("text"),
        first.cast("long").alias("char_start"),
        (first + F.length(text)).cast("long").alias("char_end"),
    )


def ellipsize(c: Column, n: int = 45) -> Column:
    """The first ``n`` characters, with an ellipsis when something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def truncate_noted(c: Column, n: int = 8000) -> Column:
    """At most ``n`` characters, the closing note about the full length included."""
    note = F.concat(F.lit("\n...[truncated, "), F.length(c).cast("string"), F.lit(" chars total]"))
    kept = F.substring(c, F.lit(1), F.lit(n) - F.length(note))
    return F.when(F.length(c) > n, F.concat(kept, note)).otherwise(c)


def response_id(dataset: Column, row_id: Column, prompt_col: Column, sample_idx: Column) -> Column:
    """``dataset__row__column__sample``; a missing part reads ``None``."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (dataset, row_id, prompt_col, sample_idx)]
    return F.concat_ws("__", *parts)


def hash_order(seed: int | str, *ids: Column) -> Column:
    """A seeded pseudo-random sort key that depends on the ids only, never on where a row is stored."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def run_name(layer: Column, n_latents: Column, k: Column, centered: Column, seed: Column) -> Column:
    """Name of a run, e.g. ``L18_n20_k3_uncentered_s0``."""
    tag = F.when(centered, "centered").otherwise("uncentered")
    return F.format_string("L%02d_n%d_k%d_%s_s%d", layer, n_latents, k, tag, seed)


def parse_run_name(c: Column) -> Column:
    """The parts of a run name as a struct; all null when the name has another form."""
    pattern = r"^L(\d+)_n(\d+)_k(\d+)_(centered|uncentered)_s(\d+)\z"

    def part(i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    def number(i: int) -> Column:
        return F.when(part(i) != "", part(i)).cast("int")

    return F.struct(
        number(1).alias("layer"),
        number(2).alias("n_latents"),
        number(3).alias("k"),
        F.when(part(4) != "", part(4) == "centered").alias("centered"),
        number(5).alias("seed"),
    )


def latent_caption(run: Column, latent_id: Column, title: Column) -> Column:
    """Short row label such as ``n20 L3: Hedging``; the title is cut to 30 characters."""
    return F.concat(
        F.split_part(run, F.lit("_"), F.lit(2)),
        F.lit(" L"),
        latent_id.cast("string"),
        F.lit(": "),
        F.substring(title, 1, 30),
    )
