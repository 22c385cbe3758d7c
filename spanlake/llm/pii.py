"""Personal data and the terms that give it away, in DataFrame functions only.

Protected entities are e-mail and IP addresses, card and phone numbers. A term is a word of letters between blanks
(closing punctuation taken off) near an entity. The corpus says how much a term discloses: with the information of an entity
IC(c) = -log2 p(c) and the pointwise mutual information PMI(c; t) = IC(c) + log2 p(c | t), a term whose PMI reaches
``disclosure`` times IC would let a reader infer the removed entity. Such a term
is generalised near that entity, or removed if it never occurs without it (PMI = IC).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlake.functions.spans import once
from spanlake.llm.storage import stored

KINDS = ("email", "ip", "card", "phone")
#: Share of an entity's information that a term may not give away, and the different texts that must show it: one, since most
#: entities stand in one text only.
DISCLOSURE, SUPPORT = 0.9, 1
#: Characters on either side of an entity whose whole words are its terms.
CONTEXT = 64
#: Elements of an array whose running sums are made in one go.
CHUNK = 256

_LOCAL, _PART = "A-Za-z0-9._%+-", "[0-9]++"
#: Possessive forms of the patterns: the same matches, without backtracking or recursion. A run of characters that can
#: begin a match is entered at its start or where the match before ended, so long runs are passed once.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?:(?<![0-9])|\G){_PART}\.{_PART}\.{_PART}\.{_PART}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
SIGNS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    digits = F.reverse(_digits(v))
    at = lambda i: F.substr(digits, i, F.lit(1))
    # fixed value: the digit sums of doubled digits
    doubled = lambda i: F.translate(at(i), "0123456789", "0246813579")
    value = lambda i: F.when(i % 2 == 0, doubled(i)).otherwise(at(i)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + value(i))
    return F.when(F.length(digits).between(13, 19), total % 10 == 0).otherwise(False)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": _luhn,
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _short_running(a: Column) -> Column:
    return F.slice(F.aggregate(a, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 2, 1 << 30)


def running(a: Column) -> Column:
    """Running sums of an int array, chunk by chunk."""
    chunk = lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK))
    numbers = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / CHUNK).cast("int"))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x)
    before = F.concat(F.array(F.lit(0)), _short_running(F.transform(numbers, lambda i: total(chunk(i)))))
    parts = F.zip_with(F.transform(numbers, lambda i: _short_running(chunk(i))), F.slice(before, F.lit(1), F.size(numbers)), lambda c, b: F.transform(c, lambda x: x + b))
    return F.when(F.size(a) <= CHUNK, _short_running(a)).otherwise(F.flatten(parts))


_SPAN = "array<struct<kind:string,start:int,end:int,value:string,terms:array<struct<term:string,start:int,end:int>>>>"


def _terms(side: Column, whole: Column, at: Column, left: bool) -> Column:
    """Terms with their places in a side of at most ``CONTEXT`` characters that begins at ``at``; the word that touches the
    entity and a word that may be cut at the far end are left out."""
    words = F.split(side, "[ \t-\r]", -1)
    sized = F.transform(words, lambda w: F.length(w) + 1)
    placed = F.zip_with(words, _short_running(sized), lambda w, e: F.struct(w.alias("w"), (at + e - F.length(w) - 1).alias("s")))
    cut = F.length(whole) > CONTEXT
    skip = (F.when(cut, 1).otherwise(0) if left else F.lit(1)).cast("int")
    drop = (F.lit(1) if left else F.when(cut, 1).otherwise(0)).cast("int")
    placed = F.slice(placed, skip + 1, F.greatest(F.size(placed) - skip - drop, F.lit(0)))
    term = F.transform(placed, lambda p: F.struct(F.regexp_extract(p["w"], r"^(\p{L}{3,})[.,;:!?)]*$", 1).alias("t"), p["s"].alias("s")))
    return F.transform(
        F.filter(term, lambda p: p["t"] != ""),
        lambda p: F.struct(F.lower(p["t"]).alias("term"), p["s"].alias("start"), (p["s"] + F.length(p["t"])).alias("end")),
    )


def _spans_of(kind: str) -> Column:
    """Valid spans of a kind with the terms near them, from its matches and the pieces between them."""
    found, pieces = F.col(f"__m_{kind}"), F.col(f"__p_{kind}")
    lengths = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
    ends = running(lengths)
    numbered = F.transform(
        F.arrays_zip(found.alias("v"), ends.alias("e"), F.slice(pieces, F.lit(1), F.size(found)).alias("l"), F.slice(pieces, F.lit(2), F.size(found)).alias("r")),
        lambda s: F.struct(s["v"].alias("v"), s["e"].alias("e"), s["l"].alias("l"), s["r"].alias("r")),
    )
    good = F.filter(numbered, lambda s: VALID[kind](s["v"]))
    value = (lambda v: F.lower(v)) if kind == "email" else (lambda v: v) if kind == "ip" else _digits

    def span(s: Column) -> Column:
        start = s["e"] - F.length(s["v"])
        left = F.right(s["l"], F.lit(CONTEXT))
        right = F.left(s["r"], F.lit(CONTEXT))
        terms = F.concat(_terms(left, s["l"], start - F.length(left), True), _terms(right, s["r"], s["e"], False))
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), s["e"].alias("end"), value(s["v"]).alias("value"), terms.alias("terms"))

    return F.when(F.size(found) > 0, F.transform(good, span)).otherwise(F.array()).cast(_SPAN)


def text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _base(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    source = docs.select(F.col(id_col).alias("id"), text_key(text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    empty = F.array().cast("array<string>")
    found = once(source, **{f"__m_{k}": F.when(F.col("text").rlike(SIGNS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0))).otherwise(empty) for k in KINDS})
    split = once(found, **{f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(empty) for k in KINDS})
    spans = once(split, **{k: _spans_of(k) for k in KINDS})
    n_words = F.regexp_count("text", F.lit("[^ \t-\r]+")).cast("long")
    return spans.select("id", "key", n_words.alias("n_words"), F.concat(*KINDS).alias("spans"))


def disclosing_terms(base: DataFrame, docs: DataFrame, text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``(kind, value, term, removed)``: terms whose mutual information with an entity near them passes the threshold.

    Pairs are counted per occurrence of an entity, terms over all texts. Everything is summed up in the tasks first, so a
    term, an entity or a source with most rows is no heavier than another.
    """
    near = base.select("key", F.explode("spans").alias("s")).select("key", "s.kind", "s.value", "s.terms")
    entities = near.groupBy("kind", "value").agg(F.count("*").alias("n_entity"))
    terms = near.select("key", "kind", "value", F.explode(F.array_distinct(F.transform("terms", lambda t: t["term"]))).alias("term"))
    per_text = terms.groupBy("kind", "value", "term", "key").agg(F.count("*").alias("n"))
    pairs = per_text.groupBy("kind", "value", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("n_texts")).where(F.col("n_texts") >= support)
    pairs = stored(pairs)
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), "[ \t-\r]+")).alias("w")).where(F.length("w") >= 3)
    counts = words.select(F.rtrim("w", F.lit(".,;:!?)")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    counts = counts.join(pairs.select("term").distinct(), "term", "left_semi")
    total = base.agg(F.sum("n_words")).first()[0] or 0
    rated = pairs.join(counts, "term").join(entities, ["kind", "value"])
    share = F.col("n_both") / F.col("n_term")
    ic = F.log2(F.lit(float(total)) / F.col("n_entity"))
    kept = rated.where(ic + F.log2(share) >= disclosure * ic)
    return kept.select("kind", "value", "term", (F.col("n_both") >= F.col("n_term")).alias("removed"))


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``(id, key, spans, terms)`` for every row of ``docs``: ``spans`` are the base spans by kind and start, ``terms`` the
    spans of disclosing terms ``(start, end, removed)`` by start. ``key`` is the hash of the text.

    Places count code points, ends are exclusive. Null texts count as empty and have no span. Repeated rows have equal
    results. Matches of a kind do not overlap; those of different kinds may. The base part is stored in the shared folder.
    """
    base = stored(_base(docs, id_col, text))
    pairs = disclosing_terms(base, docs, text, disclosure, support)
    places = base.select("id", "key", F.explode("spans").alias("s")).select("id", "key", "s.kind", "s.value", F.explode("s.terms").alias("t"))
    places = places.select("id", "key", "kind", "value", "t.term", "t.start", "t.end").join(pairs, ["kind", "value", "term"])
    one = places.groupBy("id", "key", "start", "end").agg(F.max("removed").alias("removed"))
    per_row = one.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "removed"))).alias("terms"))
    none = F.array().cast("array<struct<start:int,end:int,removed:boolean>>")
    joined = base.join(per_row, F.col("id").eqNullSafe(F.col("__id")) & (F.col("key") == F.col("__key")), "left")
    bare = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select("id", "key", bare.alias("spans"), F.coalesce("terms", none).alias("terms"))


def written(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text: str = "text", disclosure: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """``docs`` with its text sanitised: entities become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``, disclosing terms
    ``[TERM]`` or, where they occur with the entity only, nothing. Of overlapping spans the first stands for all. Null
    texts stay null; texts without a span stay as they are; other columns too."""
    found = find(docs, id_col, text, disclosure, support).where((F.size("spans") > 0) | (F.size("terms") > 0)).dropDuplicates(["id", "key"])
    marks = F.concat(
        F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put"))),
        F.transform("terms", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), F.when(t["removed"], "").otherwise("[TERM]").alias("put"))),
    )
    found = found.select(F.col("id").alias("__id"), F.col("key").alias("__key"), F.array_sort(marks).alias("__marks"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def put(state: Column, m: Column) -> Column:
        piece = F.concat(F.substr(text, state["at"] + 1, m["start"] - state["at"]), m["put"])
        moved = F.struct(m["end"].alias("at"), F.concat(state["parts"], F.array(piece)).alias("parts"))
        beyond = F.struct(F.greatest(state["at"], m["end"]).alias("at"), state["parts"].alias("parts"))
        return F.when(m["start"] >= state["at"], moved).otherwise(beyond)

    end = lambda s: F.concat(F.array_join(s["parts"], ""), F.substr(text, s["at"] + 1))
    made = F.when(F.col("__marks").isNull(), F.col(text)).otherwise(F.aggregate("__marks", start, put, end))
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("__id")) & (text_key(text) == F.col("__key")), "left")
    return joined.withColumn(text, made).select(*docs.columns)
