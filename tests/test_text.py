"""Spans, tokens and text expressions against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanlake import fixed
from spanlake.functions import text as tx
from spanlake.operators import prompts as pr
from spanlake.operators import segment

TRICKY = [
    "Plain one. And two!  Three?",
    "2. a list\n3. **bold**\n\n",
    "pi is 3.14, e is 2.71. Done",
    "  leading and trailing  ",
    "Éclair à la carte… Oui! Ça va? Non.",
    "no terminator at all",
    "a.\n\nb.\t c.\r\nd",
    "mark \u0001 inside. Next \u0001. Last",
    "😀 wide. Chars 😀😀! x",
    ".",
    "... !!! ???",
    "x" * 3000 + ". " + "word " * 5000,
]

_SPACE = " \t\n\f\r"


def plain_sentences(text):
    rows, at = [], 0
    pieces = re.sub(r"([.!?]+)([ \t\n\f\r]+)", lambda m: m.group(0) + "\x00", text).split("\x00")
    for piece in pieces:
        core = piece.strip(_SPACE)
        if core:
            start = at + len(piece) - len(piece.lstrip(_SPACE))
            rows.append((len(rows), core, start, start + len(core)))
        at += len(piece)
    return rows


def plain_tokens(text):
    return [(m.start(1), m.end(1)) for m in re.finditer(r"[ \t\n\f\r]*(\w+|[^\w \t\n\f\r])", text)]


def plain_range(tokens, start, end):
    hit = [i for i, (a, b) in enumerate(tokens) if a < b and b > start and a < end]
    return (hit[0], hit[-1] + 1) if hit else (None, None)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string").repartition(3)


def test_sentences(docs):
    got = {}
    for r in segment.split_sentences(docs).orderBy("doc_id", "sent_idx").collect():
        got.setdefault(r.doc_id, []).append((r.sent_idx, r.text, r.char_start, r.char_end))
        assert TRICKY[r.doc_id][r.char_start : r.char_end] == r.text
    assert got == {i: plain_sentences(t) for i, t in enumerate(TRICKY)}


def test_tokens(docs):
    got = {}
    for r in segment.tokenize(docs).orderBy("doc_id", "tok_idx").collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
    assert got == {i: plain_tokens(t) for i, t in enumerate(TRICKY)}


def test_repeated_ids_do_not_mix(spark):
    twice = spark.createDataFrame([(1, "One. Two."), (1, "Three. Four. Five.")], "doc_id long, text string")
    rows = segment.split_sentences(twice).orderBy("sent_idx", "text").collect()
    assert [(r.sent_idx, r.text) for r in rows] == [(0, "One."), (0, "Three."), (1, "Four."), (1, "Two."), (2, "Five.")]


def test_segment_agrees_with_joins_and_plain_python(docs):
    sents, toks = segment.split_sentences(docs), segment.tokenize(docs)
    columns = ["doc_id", "sent_idx", "char_start", "char_end", "tok_start", "tok_end"]
    joined = sorted(map(tuple, segment.align_spans(sents, toks, width=16).select(columns).collect()))
    plain = sorted(map(tuple, segment.align_spans_plain(sents, toks).select(columns).collect()))
    cut = segment.segment(docs, None, "text", max_length=10**9)
    nested = sorted(map(tuple, segment.sentence_rows(cut, ["doc_id"]).select(columns).collect()))
    assert joined == plain == nested
    for doc_id, _, a, b, lo, hi in nested:
        assert (lo, hi) == plain_range(plain_tokens(TRICKY[doc_id]), a, b)


def test_foreign_tokens_straddling_and_zero_width(spark):
    # "Hi there. Bye": a zero-width special token in front, one token over both sentences
    tokens = [(0, 0), (0, 2), (2, 8), (8, 10), (10, 13), (13, 13)]
    rows = [("r", "Hi there. Bye", tokens)]
    df = spark.createDataFrame(rows, "response_id string, response string, tokens array<struct<start:long,end:long>>")
    cut = segment.segment(df, None, "response", token_col="tokens").first()
    assert [(s.text, s.tok_start, s.tok_end) for s in cut.spans] == [("Hi there.", 1, 4), ("Bye", 4, 5)]
    assert (cut.resp_tok_start, cut.resp_tok_end, cut.n_tokens_full_text) == (1, 5, 6)
    assert cut.skips == []
    long = df.select("response_id", F.posexplode("tokens").alias("tok_idx", "t")).select("response_id", "tok_idx", "t.*")
    sents = segment.split_sentences(df, "response", ["response_id"])
    got = segment.align_spans(sents, long, ["response_id"]).orderBy("sent_idx").collect()
    assert [(r.tok_start, r.tok_end) for r in got] == [(1, 4), (4, 5)]


def test_sweep_of_any_intervals(spark):
    pick = random.Random(7)
    spans_, tokens = [], []
    for doc in ["a", "b", "hot", None]:
        for i in range(600 if doc == "hot" else 40):
            at = pick.randrange(400)
            tokens.append((doc, i, at, at + pick.choice([0, 1, 1, 3, 20, 300])))
            at = pick.randrange(-20, 450)
            spans_.append((doc, i, at, at + pick.choice([-2, 0, 1, 7, 60, 500])))
    spans_ += [("hot", 600, None, 5), ("hot", 601, 5, None), ("no tokens", 0, 0, 9), ("a", None, 0, 500), *spans_[:3]]
    tokens += [("hot", 900, None, 5), ("hot", None, 0, 500), ("no spans", 0, 0, 9), *tokens[:3]]
    pick.shuffle(tokens)
    spans_df = spark.createDataFrame(spans_, "doc_id string, sent_idx int, char_start int, char_end int")
    toks = spark.createDataFrame(tokens, "doc_id string, tok_idx int, start long, end long")
    want = Counter()
    for span in set(spans_):
        doc, _, a, b = span
        known = None not in (doc, a, b)
        hit = [i for d, i, s, e in tokens if known and d == doc and None not in (i, s, e) and s < e and e > a and s < b]
        want[(*span, min(hit, default=None), max(hit) + 1 if hit else None)] += 1
    for width in (1, 16, 128, 1 << 16):
        assert Counter(map(tuple, segment.align_spans(spans_df, toks, width=width).collect())) == want
    assert segment.align_spans(spans_df, toks.limit(0)).where("tok_start IS NOT NULL").count() == 0
    assert segment.align_spans(spans_df.limit(0), toks).count() == 0


def test_sweep_over_many_batches(spark):
    """Documents of a few tokens and one that fills many Arrow batches, in one stretch and over many."""
    n = F.when(F.col("id") % 50 == 7, 9000).otherwise(F.col("id") % 5)
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab cd. "), n.cast("int")).alias("text"))
    sents, toks = segment.split_sentences(docs), segment.tokenize(docs)
    for width in (1 << 10, 1 << 16):
        rows = segment.align_spans(sents, toks, width=width).select(
            F.sum((F.col("tok_start") == 3 * F.col("sent_idx")).cast("int")).alias("right"), F.sum(F.col("tok_end") - F.col("tok_start")).alias("n"), F.count("*").alias("spans")
        )
        got = rows.first()
        assert got.spans == sents.count() == got.right and got.n == toks.count()


def test_skip_routing(spark):
    tokens = [(0, 2), (2, 3)]  # nothing for the second sentence
    rows = [
        ("empty", None, tokens),
        ("blank", " \n ", tokens),
        ("long", "a b c d e f", [(i, i + 1) for i in range(7)]),
        ("lost", "Hi. Bye now", tokens),
        ("none", "Hi. Bye now", [(0, 0)]),
        ("fine", "Hi.", tokens),
    ]
    df = spark.createDataFrame(rows, "response_id string, response string, tokens array<struct<start:long,end:long>>")
    valid, skips = segment.route_skips(segment.segment(df, None, "response", max_length=6, token_col="tokens"))
    assert sorted(r.response_id for r in valid.collect()) == ["fine", "lost"]
    assert sorted(((r.response_id, r.reason, r.detail) for r in skips.collect()), key=str) == sorted(
        [
            ("empty", fixed.EMPTY_RESPONSE, None),
            ("blank", fixed.EMPTY_RESPONSE, None),
            ("long", fixed.TOO_LONG, "7"),
            ("lost", fixed.DEGENERATE_SPAN, "Bye now"),
            ("none", fixed.DEGENERATE_SPAN, "Hi."),
            ("none", fixed.DEGENERATE_SPAN, "Bye now"),
            ("none", fixed.NO_VALID_SENTENCES, None),
        ],
        key=str,
    )
    kept = segment.sentence_rows(valid.filter("response_id = 'lost'")).collect()
    assert [(r.sent_idx, r.text) for r in kept] == [(0, "Hi.")]


def test_response_span_falls_back_to_token_count(spark):
    rows = [("a", 3, 0, 0, 2), ("a", 3, 1, 3, 5), ("a", 3, 2, 5, 5), ("b", 9, 0, 0, 4), ("b", 9, 1, 4, 4)]
    toks = spark.createDataFrame(rows, "doc_id string, prefix_len int, tok_idx long, start long, end long")
    got = {r.doc_id: (r.resp_tok_start, r.resp_tok_end) for r in segment.response_span(toks).collect()}
    assert got == {"a": (1, 2), "b": (2, 2)}


def test_normalize_matches_python(spark):
    texts = ["  a   b\n\nc\x1c", "　x y", "", "one"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.normalize_ws(F.col("t"))).collect()]
    assert got == [" ".join(t.split()) for t in texts]
    assert [r[0] for r in df.select(tx.strip(F.col("t"))).collect()] == [t.strip() for t in texts]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab .!?\n\té1_-", max_size=60), min_size=1, max_size=20))
def test_any_text(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = segment.segment(df, None, "text").collect()
    for r in cut:
        toks = plain_tokens(texts[r.doc_id])
        want = [(t, a, b, *plain_range(toks, a, b)) for _, t, a, b in plain_sentences(texts[r.doc_id])]
        assert [tuple(s) for s in r.spans] == want


def test_truncate_noted_has_exact_length(spark):
    df = spark.createDataFrame([("y" * 9000,), ("y" * 8000,)], "t string")
    cut, whole = [r[0] for r in df.select(tx.truncate_noted(F.col("t"))).collect()]
    assert len(cut) == 8000 and cut.endswith("\n...[truncated, 9000 chars total]")
    assert whole == "y" * 8000


def test_response_id_keeps_missing_parts(spark):
    df = spark.createDataFrame([("d", None, "text", 0)], "dataset string, row_id string, prompt_col string, sample_idx int")
    assert pr.with_response_id(df).first().response_id == "d__None__text__0"


def test_melt_drops_blank_and_trims(spark):
    df = spark.createDataFrame([("7", " a ", None), ("8", " \n", "b")], "id string, x string, y string")
    rows = pr.melt_prompts(df, "d", "id", ["x", "y"]).collect()
    assert sorted(tuple(r) for r in rows) == [("d", "7", "x", "a"), ("d", "8", "y", "b")]


def test_last_generation_of_an_id_counts(spark):
    gens = spark.createDataFrame(
        [("a", "p1", "r1", "f1", 0), ("a", "p2", "r2", "f2", 0), ("b", "p3", "r3", "f1", 1)],
        "response_id string, prompt string, response string, file string, line int",
    )
    got = pr.attach_text(gens.select("response_id").distinct(), gens, ["file", "line"])
    assert sorted(tuple(r) for r in got.collect()) == [("a", "p2", "r2"), ("b", "p3", "r3")]


def test_offsets_in_parts(spark, monkeypatch):
    """A batch of many offsets is cut a few rows at a time, with the same result; no part has more values than asked."""
    from spanlake.functions import arrays

    lists = pa.array([[1, 2, 3], [4], [], None, [5] * 9, [6], [7]])
    assert list(arrays.row_parts(lists)) == [(0, 7)]
    monkeypatch.setattr(arrays, "UNPACKED", 5)
    assert list(arrays.row_parts(lists)) == [(0, 4), (4, 5), (5, 7)]


def test_groups_are_dealt_packed():
    """Neighbours of a group are one row in the shuffle; behind it the single rows are back, sorted, a few groups at a time."""
    from spanlake.functions import arrays

    made = []

    def count(batch, group):
        made.append(batch.num_rows)
        return batch

    rows = [pa.RecordBatch.from_pydict({"g": [g] * 3, "x": [3, 1, 2]}) for g in (1, 1, 2, 3)]
    packed = list(arrays.packed_groups(["g"])(iter(rows)))
    assert [b.num_rows for b in packed] == [1] * 4
    found = list(arrays.whole_groups(["g"], arrays.unpacked(["g"], ["x"], count, 3))(iter(packed)))
    assert made == [6, 3, 3]
    assert [(r["g"], r["x"]) for b in found for r in b.to_pylist()] == [(1, v) for v in (1, 1, 2, 2, 3, 3)] + [(g, v) for g in (2, 3) for v in (1, 2, 3)]
